"""Registered queries: the tables exchanged with an offline model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators import model_tables, pages
from hirelake.plans.checks_pages import PATTERN
from hirelake.plans.views import PARTS, POSTINGS, Inputs
from hirelake.schema import POSTING_FIELDS
from hirelake.session import BUCKETS, bucketed, join_in_place

_ORDER = ["src_idx", "page_no", "item_no", "order_url"]
# Rows of a source are numbered in chunks of this many orders.
_CHUNK_ORDERS = 4096


def _sent(inputs: Inputs) -> DataFrame:
    """Postings as they go out: some without an address."""
    return inputs.postings().withColumn("order_url", F.col("url")).withColumn(
        "url", F.when(F.col("job_type") != "", F.col("url")).otherwise(F.lit(""))
    )


def batches(inputs: Inputs, size: int = model_tables.BATCH_SIZE, tasks: int | None = None) -> DataFrame:
    return model_tables.model_batches(
        _sent(inputs), F.floor(F.col("page_no") / _CHUNK_ORDERS), _ORDER, size, tasks=tasks
    )


def batch_rows(inputs: Inputs, size: int) -> DataFrame:
    sent = F.from_json("jobs_json", model_tables.POSTING_LIST)
    return (
        batches(inputs, size)
        .select("source", "batch_id", "n", F.posexplode(sent).alias("item_no", "job"))
        .withColumn("item_no", F.col("item_no").cast("bigint"))
        .select("source", "batch_id", "n", "item_no", "job.title", "job.location", "job.url")
    )


def responses(inputs: Inputs, made: DataFrame | None = None) -> DataFrame:
    """Answers to the batches: four ways of wrapping an array, and garbage.
    Some answers are empty lists, some calls failed, some are missing."""
    kind = F.col("batch_id") % 5
    answer = F.replace("jobs_json", F.lit('"company":"Supplier'), F.lit('"company":"Vendor'))
    answer = F.when(F.col("batch_id") % 7 == 6, F.lit("[]")).otherwise(answer)
    text = (
        F.when(kind == 0, F.concat(F.lit(" \n"), answer))
        .when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), answer, F.lit("\n```\nDone.")))
        .when(kind == 2, F.concat(F.lit("```\n"), answer, F.lit("\n``` more ``` [1]")))
        .when(kind == 3, F.concat(F.lit("Here they are: "), answer, F.lit(" That is all.")))
        .otherwise(F.concat(F.lit("No list {"), F.col("n").cast("string")))
    )
    failed = F.when(F.col("batch_id") % 11 == 10, F.lit("timed out"))
    made = batches(inputs) if made is None else made
    return made.filter(F.col("batch_id") % 13 != 12).select(
        "source", "batch_id", text.alias("text"), failed.alias("error"),
        *(["place"] if "place" in made.columns else []),
    )


def _sites(inputs: Inputs) -> DataFrame:
    return inputs.table("nation").select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example.com")).alias("url"),
    )


def applied(inputs: Inputs) -> DataFrame:
    # Batches are made once and written where they were numbered, so that answers meet them in place.
    made = bucketed(batches(inputs, tasks=BUCKETS), ["place"], "batches", dealt=True)
    applied_to = model_tables.apply_responses(made, responses(inputs, made), "place")
    return join_in_place(applied_to.select(*POSTING_FIELDS, "batch_id", "item_no"))


def requests(inputs: Inputs) -> DataFrame:
    """Pages and empty pages; sources with events on file count as flattened."""
    contexts = pages.page_context(inputs.table("pages"), PATTERN).select(
        F.concat(F.lit("user "), (F.col("page_id") * 7).cast("string")).alias("source"),
        "url",
        F.when(F.col("page_id") % 9 != 0, F.col("context")).otherwise(F.lit("")).alias("context"),
    )
    flattened = inputs.table("events").select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source")
    )
    made = model_tables.extract_requests(contexts, flattened)
    return made.select("source", "url", (F.length("request") > 0).alias("asked"), "error")


def records(inputs: Inputs) -> DataFrame:
    """Parts as loosely typed JSON records."""
    k = F.col("k") % 8
    quoted = F.to_json(F.struct(F.coalesce("title", F.lit("none")).alias("title")))
    head = F.when(k == 0, F.concat(F.lit('{"title":'), F.col("k").cast("string"))).otherwise(
        F.regexp_replace(quoted, r"\}$", "")
    )
    tail = (
        F.when(k == 1, F.lit("}"))
        .when(k == 2, F.lit(',"company":null}'))
        .when(k == 3, F.lit(',"company":"C","date_posted":null}'))
        .when(k == 4, F.lit(',"company":"C","location":null,"source":"given"}'))
        .when(k == 5, F.lit(',"company":"C","job_type":7,"url":"u"}'))
        .when(k == 6, F.lit(',"company":"C","description":["a"],"job_type":"x"}'))
        .otherwise(F.lit(',"company":"C","date_posted":"2024-01-01","other":{"a":1}}'))
    )
    return inputs.parts().select("k", F.col("source").alias("page"), F.concat(head, tail).alias("record"))


def validated(inputs: Inputs) -> DataFrame:
    return model_tables.validate(records(inputs), F.col("page")).select(
        "k", "title", "company", "location", "source", "job_type", "date_posted", "is_valid"
    )


def normalized(inputs: Inputs) -> DataFrame:
    raw = inputs.postings().withColumn(
        "location",
        F.when(F.col("location") == "Remote", F.lit(" nyc"))
        .when(F.col("location") == "Berlin, DE", F.lit("SF"))
        .otherwise(F.col("location")),
    )
    return model_tables.normalize_rules(raw).select(*POSTING_FIELDS)


def unioned(inputs: Inputs) -> DataFrame:
    """Rows of even sources as flattened ones, rows of all as parsed ones."""
    rows = inputs.postings().select(*POSTING_FIELDS, "src_idx")
    return model_tables.api_or_model(
        rows.filter("src_idx % 2 = 0 AND job_type <> ''"), rows
    ).select("source", "title", "url", "job_type")


SQL_SENT = f"""
sent AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY src_idx, page_no, item_no, url) - 1
    AS position FROM ({POSTINGS}) AS p),
batched AS (
  SELECT title, company, location, CASE WHEN job_type <> '' THEN url ELSE '' END AS url,
    description, date_posted, source, job_type, position // 3 AS batch_id, position % 3 AS item_no
  FROM sent)"""


def _sql_batches(size: int) -> str:
    return f"""WITH {SQL_SENT}
    SELECT source, position // {size} AS batch_id,
      count(*) OVER (PARTITION BY source, position // {size}) AS n, position % {size} AS item_no,
      title, location, CASE WHEN job_type <> '' THEN url ELSE '' END AS url
    FROM sent"""


_ANSWERED = """(batch_id % 13 <> 12 AND batch_id % 5 <> 4 AND batch_id % 11 <> 10)"""

def bypassed(inputs: Inputs) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["api", "browser", "html"])), F.col("n_nationkey") % 3 + 1)
    sites = _sites(inputs).join(
        inputs.table("nation").select(
            F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name"),
            kind.alias("type"),
        ),
        "name",
    )
    return model_tables.with_bypass(inputs.postings(), sites).select("source", "url", "bypass")


QUERIES = {
    "model_bypass": (
        bypassed,
        f"""WITH postings AS ({POSTINGS})
        SELECT source, url, src_idx % 3 = 0 AS bypass FROM postings""",
    ),
    "extract_requests": (
        requests,
        """SELECT 'user ' || (page_id * 7) AS source, url,
          CASE WHEN page_id % 9 <> 0 THEN true END AS asked,
          CASE WHEN page_id % 9 = 0 THEN 'No text content to parse for user ' || (page_id * 7) END AS error
        FROM pages WHERE page_id * 7 NOT IN (SELECT user_id FROM events)""",
    ),
    "model_batches": (lambda i: batch_rows(i, 3), _sql_batches(3)),
    "model_batches_of_ten": (lambda i: batch_rows(i, 10), _sql_batches(10)),
    "parse_responses": (
        lambda i: model_tables.parse_responses(responses(i), _sites(i)).select(
            *POSTING_FIELDS, "batch_id", "item_no"
        ),
        f"""WITH {SQL_SENT}
        SELECT title, replace(company, 'Supplier', 'Vendor') AS company, location,
          CASE WHEN url = '' THEN 'https://' || lower(n_name) || '.example.com' ELSE url END AS url,
          description, date_posted, source, job_type, batch_id, item_no
        FROM batched JOIN nation ON source = 'src' || n_nationkey
        WHERE batch_id % 13 <> 12 AND batch_id % 5 <> 4 AND batch_id % 7 <> 6""",
    ),
    "apply_responses": (
        applied,
        f"""WITH {SQL_SENT}
        SELECT title, CASE WHEN {_ANSWERED} THEN replace(company, 'Supplier', 'Vendor')
            ELSE company END AS company,
          location, url, description, date_posted, source, job_type, batch_id, item_no
        FROM batched WHERE NOT ({_ANSWERED} AND batch_id % 7 = 6)""",
    ),
    "validate": (
        validated,
        f"""SELECT k, CASE WHEN k % 8 = 0 THEN k::varchar ELSE coalesce(title, 'none') END AS title,
          CASE WHEN k % 8 IN (1, 2) THEN NULL ELSE 'C' END AS company, NULL::varchar AS location,
          CASE WHEN k % 8 = 4 THEN 'given' ELSE source END AS source,
          CASE k % 8 WHEN 5 THEN '7' WHEN 6 THEN 'x' ELSE '' END AS job_type,
          CASE WHEN k % 8 IN (0, 7) THEN '2024-01-01' END AS date_posted,
          k % 8 IN (3, 7) AS is_valid
        FROM ({PARTS}) AS p""",
    ),
    "normalize_rules": (
        normalized,
        f"""WITH postings AS ({POSTINGS}),
        spaced AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM postings)
        SELECT array_to_string(list_transform(string_split(t, ' '),
            lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
          company,
          CASE location WHEN 'Remote' THEN 'New York, NY' WHEN 'Berlin, DE' THEN 'San Francisco, CA'
            ELSE coalesce(location, '') END AS location,
          url,
          CASE WHEN strpos(description, ' & more. ') > 0
            THEN left(description, strpos(description, ' & more. ') + 7)
            ELSE trim(description) END AS description,
          date_posted, source, job_type
        FROM spaced""",
    ),
    "api_or_model": (
        unioned,
        f"""WITH postings AS ({POSTINGS}),
        done AS (SELECT * FROM postings WHERE src_idx % 2 = 0 AND job_type <> '')
        SELECT source, title, url, job_type FROM done
        UNION ALL SELECT source, title, url, job_type FROM postings
        WHERE source NOT IN (SELECT source FROM done)""",
    ),
}
