"""Registered queries: whole runs over three fetch cycles of every payload shape.

Eleven sources share each name.  In cycle 1 the second page of some sources
timed out, in cycle 2 the first page of some is no JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators import payloads
from hirelake.plans.checks_catalog import SQL_LIMITS
from hirelake.plans.checks_payloads import _COLUMNS, _UNION, CLOCK, every_payload
from hirelake.plans.run import Run, run_payloads
from hirelake.plans.views import FETCH_PAGES, PARTS, Inputs
from hirelake.session import written

NAMES = list(payloads.SHAPES)


def landed(inputs: Inputs) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, NAMES)), F.col("provider")) - 1
    # Landed before they are read: a run reads its payloads more than once.
    rows = (
        written(every_payload(inputs), "payloads")
        .withColumn("src_idx", F.col("src_idx") * 16 + place)
        .withColumn("run_id", F.explode(F.array(*[F.lit(n).cast("bigint") for n in range(3)])))
    )
    late = (F.col("run_id") == 1) & (F.col("src_idx") % 5 == 0) & (F.col("page_no") == 2)
    page = (F.col("run_id") == 2) & (F.col("src_idx") % 7 == 0) & (F.col("page_no") == 1)
    return rows.withColumns(
        {
            "success": ~late,
            "error": F.when(late, F.lit("timeout")).otherwise(F.lit("")),
            "body": F.when(page, F.lit("<html>")).otherwise(F.col("body")),
        }
    )


def whole_run(inputs: Inputs) -> Run:
    rows = landed(inputs)
    sources = rows.select(
        "src_idx", F.col("source").alias("name"), F.lit("u").alias("url"), F.lit("api").alias("type"),
        "provider", F.lit(None).cast("string").alias("error"), "base_url", "site_number",
    ).distinct()
    return run_payloads(rows, sources, CLOCK)


_FETCHED = f"""
SELECT run_id || '/' || n.pos || '/' || p.src_idx AS source, run_id, p.source AS name,
  p.src_idx * 16 + n.pos AS src_no, n.provider, p.page_no,
  CASE WHEN run_id = 2 AND (p.src_idx * 16 + n.pos) % 7 = 0 AND p.page_no = 1 THEN 0
    ELSE count(*) FILTER (CASE n.provider WHEN 'amazon' THEN coalesce(country3 = 'USA', false)
      WHEN 'oracle_hcm' THEN coalesce(country2, '') IN ('', 'US') ELSE true END) END AS n_jobs,
  CASE WHEN n.provider = 'lever' THEN 0 ELSE 5000 END AS total,
  NOT (run_id = 1 AND (p.src_idx * 16 + n.pos) % 5 = 0 AND p.page_no = 2)
    AND NOT (run_id = 2 AND (p.src_idx * 16 + n.pos) % 7 = 0 AND p.page_no = 1) AS success,
  CASE run_id WHEN 1 THEN 'timeout' ELSE 'response is no JSON' END AS error
FROM ({PARTS}) AS p,
  (SELECT unnest([{", ".join(f"'{n}'" for n in NAMES)}]) AS provider, unnest(range({len(NAMES)})) AS pos) AS n,
  (SELECT unnest(range(3)) AS run_id) AS r
GROUP BY run_id, n.pos, n.provider, p.src_idx, p.source, p.page_no"""
_LIMITS = SQL_LIMITS.replace(f"fetched AS ({FETCH_PAGES})", f"fetched AS ({_FETCHED})") + f""",
failed AS (SELECT * FROM kept WHERE NOT success),
good AS (SELECT * FROM kept WHERE source NOT IN (SELECT source FROM failed)),
rows AS (
  SELECT u.* REPLACE (g.src_no AS src_idx), g.run_id
  FROM ({_UNION}) AS u JOIN good AS g
    ON u.provider = g.provider AND u.src_idx = g.src_no // 16 AND u.page_no = g.page_no)"""

QUERIES = {
    "run_postings": (
        lambda i: whole_run(i).postings.select("run_id", "provider", *_COLUMNS),
        f"WITH {_LIMITS} SELECT * FROM rows",
    ),
    "run_errors": (
        lambda i: whole_run(i).errors,
        f"""WITH {_LIMITS} SELECT run_id, src_no AS src_idx, name AS source,
          'API fetch failed for ' || name || ': ' || error AS error FROM failed""",
    ),
    "run_status": (
        lambda i: whole_run(i).status,
        f"""WITH {_LIMITS},
        jobs AS (SELECT src_idx, count(*) AS jobs FROM rows GROUP BY src_idx),
        pages AS (SELECT src_no, any_value(name) AS name, count(*) AS landed FROM fetched GROUP BY src_no),
        used AS (SELECT src_no, count(*) AS kept FROM good GROUP BY src_no),
        wrong AS (SELECT src_no, min(error) AS error FROM failed GROUP BY src_no)
        SELECT p.src_no AS src_idx, p.name, 'API' AS type_label,
          CASE WHEN j.jobs IS NULL AND w.error IS NOT NULL THEN 'error' ELSE 'done' END AS state,
          CAST(coalesce(j.jobs, 0) AS bigint) AS jobs,
          CASE WHEN j.jobs IS NULL THEN coalesce(w.error, '') ELSE '' END AS error,
          p.landed AS pages_landed, CAST(coalesce(u.kept, 0) AS bigint) AS pages_kept
        FROM pages AS p LEFT JOIN jobs AS j ON p.src_no = j.src_idx
        LEFT JOIN used AS u ON p.src_no = u.src_no LEFT JOIN wrong AS w ON p.src_no = w.src_no""",
    ),
}
