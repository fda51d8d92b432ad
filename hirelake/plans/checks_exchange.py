"""Registered queries: whole runs over html pages and browser cards with a model.

Every given page is an html source of its own, and fifty parts are the cards of a
shop.  The first run asks; answers are made from what it asked and nothing else,
and the same pages and cards come in a second cycle, so all answers serve twice.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.plans.run import Reading, Run, answered_run, read_payloads
from hirelake.plans.views import AS_OF, PARTS, Inputs
from hirelake.schema import LANDED_PAYLOAD, POSTING_FIELDS
from hirelake.session import written
from hirelake.sources.landing import with_fetch_errors

SHOP = 10_000_000
SITE = "https://www.metacareers.com/jobs"
CYCLES = 2


def _sources(inputs: Inputs) -> DataFrame:
    none = F.lit(None).cast("string")
    html = inputs.table("pages").select(
        F.col("page_id").cast("bigint").alias("src_idx"),
        F.concat(F.lit("site "), F.col("page_id").cast("string")).alias("name"),
        "url",
        F.lit("career_page").alias("type"),
        F.lit("html").alias("provider"),
    )
    shops = inputs.parts().select(
        (F.floor(F.col("k") / 50) + SHOP).alias("src_idx"),
        F.concat(F.lit("Shop "), F.floor(F.col("k") / 50).cast("string")).alias("name"),
        F.lit(SITE).alias("url"),
        F.lit("browser").alias("type"),
        F.lit("browser").alias("provider"),
    )
    empty = {"error": none, "base_url": none, "site_number": none}
    return html.unionByName(shops.distinct()).withColumns(empty)


def _in_cycles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("run_id", F.explode(F.array(*(F.lit(n).cast("bigint") for n in range(CYCLES)))))


def _fetched(inputs: Inputs) -> DataFrame:
    """Pages as they came: some not found, some without text."""
    key = F.col("page_id")
    pages = inputs.table("pages").select(
        F.concat(F.lit("site "), key.cast("string")).alias("source"),
        "url",
        F.lit(True).alias("success"),
        F.when(key % 10 == 1, 404).otherwise(200).alias("status_code"),
        F.lit("").alias("error"),
        F.when(key % 9 != 0, F.concat(F.lit("Jobs of page "), key.cast("string"))).alias("html"),
    )
    return _in_cycles(
        with_fetch_errors(pages, "html", F.concat(F.lit("HTTP 404 for "), F.col("url")))
    )


def _cards(inputs: Inputs) -> DataFrame:
    return _in_cycles(
        inputs.parts().select(
            F.concat(F.lit("Shop "), F.floor(F.col("k") / 50).cast("string")).alias("source"),
            F.col("k").alias("item_no"),
            "title",
            F.concat(F.lit("https://shop.example.com/"), F.col("k").cast("string")).alias("url"),
            F.lit("Remote").alias("location"),
        )
    )


def answered(asks: DataFrame) -> DataFrame:
    """What the model says, from the request alone: to a page two jobs, to a batch
    its rows as contracts.  Some calls fail, some answers cannot be read."""
    site = F.regexp_extract("request", r"Source: site (\d+)\n", 1).try_cast("bigint")
    page = F.format_string(
        '```json\n[{"title":"A %d","company":"C","url":"https://site.example.com/%d"}, 5, {"title":"B %d","job_type":null}]\n```',
        site, site, site,
    )
    first = F.regexp_extract("request", r"https://[a-z]+\.example\.com/(\d+)", 1).try_cast("bigint")
    rows = F.regexp_extract("request", r"(?s)\n(\[.*\])\n", 1)
    rows = F.regexp_replace(rows, '"job_type":("[^"]*"|null)', '"job_type":"Contract"')
    kind = F.coalesce(first, F.lit(0)) % 5
    batch: Column = (
        F.when(kind == 2, F.lit("I cannot do that {"))
        .when(kind == 3, F.concat(F.lit("Sure:\n```json\n"), rows, F.lit("\n```\nDone.")))
        .otherwise(F.regexp_replace(rows, r"\]$", ", null]"))
    )
    extract = F.col("kind") == "extract"
    failed = F.when(extract & (site % 7 == 3), F.lit("no memory")).when(~extract & (kind == 1), F.lit("timed out"))
    text = F.when(extract, page).otherwise(batch)
    return asks.filter(extract | (kind != 0)).select(
        "ask_id", F.when(failed.isNull(), text).alias("text"), failed.alias("error")
    )


def _read(inputs: Inputs) -> Reading:
    fetched = _fetched(inputs)
    readable = fetched.filter("success").select("run_id", "source", "url", F.coalesce("html", F.lit("")).alias("context"))
    return read_payloads(
        inputs.spark.createDataFrame([], LANDED_PAYLOAD), _sources(inputs), AS_OF, cards=_cards(inputs),
        html_pages=fetched, contexts=readable,
    )


class _Pages:
    """What there is to read: read when a run first needs it, and once for all runs."""

    def __init__(self, inputs: Inputs):
        self.inputs = inputs

    @cached_property
    def reading(self) -> Reading:
        return _read(self.inputs)


def _run(pages: _Pages, answers: DataFrame | None) -> Run:
    return answered_run(pages.reading, answers, skip_normalization=False)


def _answers(pages: _Pages, first: DataFrame | None = None) -> DataFrame:
    """Answers to what is open after each of two runs: pages first, then batches.

    ``first`` are the asks of the first run, where the caller has made it."""
    told = written(answered(_run(pages, None).asks if first is None else first), "answers")
    more = answered(_run(pages, told).asks).join(told, "ask_id", "left_anti")
    return written(told.unionByName(more), "answers")


def _final_run(inputs: Inputs) -> Run:
    pages = _Pages(inputs)
    return _run(pages, _answers(pages))


def normalized_run(inputs: Inputs) -> DataFrame:
    return _final_run(inputs).postings.select("run_id", "provider", *POSTING_FIELDS)


def page_errors(inputs: Inputs) -> DataFrame:
    return _final_run(inputs).errors.select("run_id", "src_idx", "source", "error")


def model_run_status(inputs: Inputs) -> DataFrame:
    return _final_run(inputs).status


def open_asks(inputs: Inputs) -> DataFrame:
    """By kind: requests of the first run, and those still open after the answers."""
    pages = _Pages(inputs)
    before = written(_run(pages, None).asks, "first-asks")
    after = _run(pages, _answers(pages, before)).asks
    counted = [
        rows.groupBy("kind").agg(F.count("*").alias("n_asks")).withColumn("state", F.lit(state))
        for state, rows in (("first", before), ("open", after))
    ]
    return counted[0].unionByName(counted[1]).select("state", "kind", "n_asks")


_ROWS = f"""
read AS (
  SELECT page_id, url, page_id % 10 = 1 AS lost, page_id % 9 = 0 AS blank FROM pages),
extracted AS (
  SELECT page_id, 'site ' || page_id AS source, unnest([0, 1]) AS pos, page_id % 5 AS kind, url
  FROM read WHERE NOT lost AND NOT blank AND page_id % 7 <> 3),
html AS (
  SELECT 'html' AS provider, (CASE pos WHEN 0 THEN 'A ' ELSE 'B ' END) || page_id AS title,
    CASE pos WHEN 0 THEN 'C' END AS company, NULL AS location,
    CASE pos WHEN 0 THEN 'https://site.example.com/' || page_id ELSE url END AS url,
    NULL AS description, NULL AS date_posted, source,
    CASE WHEN kind IN (3, 4) THEN 'Contract' ELSE '' END AS job_type
  FROM extracted),
shown AS (
  SELECT k, k // 50 AS shop, trim(title) AS title,
    row_number() OVER (PARTITION BY k // 50 ORDER BY k) - 1 AS pos
  FROM ({PARTS}) AS p WHERE coalesce(title, '') <> ''),
batches AS (SELECT *, min(k) OVER (PARTITION BY shop, pos // 3) % 5 AS kind FROM shown),
cards AS (
  SELECT 'browser' AS provider, title, 'Shop ' || shop AS company, 'Remote' AS location,
    'https://shop.example.com/' || k AS url, '' AS description, '' AS date_posted,
    'Shop ' || shop AS source, CASE WHEN kind IN (3, 4) THEN 'Contract' ELSE 'Full-time' END AS job_type
  FROM batches),
cycles AS (SELECT unnest([0, 1])::bigint AS run_id)"""

QUERIES = {
    "normalized_run": (
        normalized_run,
        f"""WITH {_ROWS}
        SELECT run_id, rows.* FROM (SELECT * FROM html UNION ALL SELECT * FROM cards) AS rows, cycles""",
    ),
    "page_errors": (
        page_errors,
        f"""WITH {_ROWS},
        told AS (
          SELECT page_id, 'Scraper failed for site ' || page_id || ': HTTP 404 for ' || url AS error
            FROM read WHERE lost
          UNION ALL SELECT page_id, 'No text content to parse for site ' || page_id FROM read WHERE blank AND NOT lost
          UNION ALL SELECT page_id, 'LLM call failed for site ' || page_id || ': no memory'
            FROM read WHERE NOT lost AND NOT blank AND page_id % 7 = 3)
        SELECT run_id, page_id AS src_idx, 'site ' || page_id AS source, error FROM told, cycles""",
    ),
    "model_run_status": (
        model_run_status,
        f"""WITH {_ROWS},
        found AS (SELECT source, count(*) * {CYCLES} AS jobs
          FROM (SELECT source FROM html UNION ALL SELECT source FROM cards) AS r GROUP BY source),
        sites AS (SELECT page_id AS src_idx, 'site ' || page_id AS name, 'CAR' AS type_label,
            CASE WHEN lost THEN 'HTTP 404 for ' || url WHEN blank THEN 'No text content to parse for site ' || page_id
              WHEN page_id % 7 = 3 THEN 'no memory' ELSE '' END AS error FROM read),
        shops AS (SELECT DISTINCT k // 50 + {SHOP} AS src_idx, 'Shop ' || k // 50 AS name, 'BRO' AS type_label,
            '' AS error FROM ({PARTS}) AS p)
        SELECT s.src_idx, s.name, s.type_label, CASE WHEN s.error <> '' THEN 'error' ELSE 'done' END AS state,
          coalesce(f.jobs, 0) AS jobs, left(s.error, 120) AS error,
          CAST(0 AS bigint) AS pages_landed, CAST(0 AS bigint) AS pages_kept
        FROM (SELECT * FROM sites UNION ALL SELECT * FROM shops) AS s LEFT JOIN found AS f ON s.name = f.source""",
    ),
    "open_asks": (
        open_asks,
        f"""WITH {_ROWS},
        asked AS (SELECT DISTINCT shop, pos // 3 AS batch, kind FROM batches),
        sites AS (SELECT DISTINCT page_id, kind FROM extracted)
        SELECT 'first' AS state, 'extract' AS kind, count(*) AS n_asks FROM read WHERE NOT lost AND NOT blank
        UNION ALL SELECT 'first', 'normalize', count(*) FROM asked
        UNION ALL SELECT 'open', 'extract', count(*) FROM read WHERE NOT lost AND NOT blank AND page_id % 7 = 3
        UNION ALL SELECT 'open', 'normalize', (SELECT count(*) FROM asked WHERE kind < 2)
          + (SELECT count(*) FROM sites WHERE kind < 2)""",
    ),
}
