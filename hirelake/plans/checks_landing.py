"""Registered queries: landed rows through the readers.

Payloads are landed as JSON lines of envelopes, pages as they were fetched.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.operators import payloads
from hirelake.plans.checks_run import _FETCHED, landed
from hirelake.plans.views import Inputs
from hirelake.session import scratch_dir
from hirelake.sources import landing


def landed_payloads(inputs: Inputs):
    """Page statistics of three cycles of payloads that went through files."""
    path = scratch_dir(inputs.spark, "envelopes")
    rows = landed(inputs)
    landing.land_envelopes(rows, path)
    read = landing.read_envelopes(inputs.spark, path)
    told = rows.select("src_idx", "provider").distinct()
    stats = payloads.page_stats(read.join(told, "src_idx"), ["run_id", "src_idx", "source"])
    return stats.select("run_id", "src_idx", "source", "provider", "page_no", "success", "error", "n_jobs")


def landed_pages(inputs: Inputs):
    path = scratch_dir(inputs.spark, "pages")
    key = F.col("page_id")
    pages = inputs.table("pages").select(
        F.concat(F.lit("site "), (key % 50).cast("string")).alias("source"),
        key.cast("bigint").alias("page_no"),
        "url",
        (key % 6 != 5).alias("success"),
        F.when(key % 4 == 3, 503).otherwise(200).cast("int").alias("status_code"),
        F.when(key % 6 == 5, F.lit("timeout")).alias("error"),
        "html",
    )
    pages.write.parquet(path)
    return landing.read_pages(inputs.spark, path).select(
        "source", "page_no", "url", "success", "error", F.length("html").cast("bigint").alias("n_chars")
    )


QUERIES = {
    "landed_payloads": (
        landed_payloads,
        f"""WITH fetched AS ({_FETCHED})
        SELECT run_id, src_no AS src_idx, name AS source, provider, page_no, success,
          CASE WHEN success THEN '' ELSE error END AS error,
          CASE WHEN success THEN n_jobs ELSE 0 END AS n_jobs FROM fetched""",
    ),
    "landed_pages": (
        landed_pages,
        """SELECT 'site ' || (page_id % 50) AS source, page_id AS page_no, url,
          page_id % 6 <> 5 AND page_id % 4 <> 3 AS success,
          CASE WHEN page_id % 6 <> 5 AND page_id % 4 <> 3 THEN '' WHEN page_id % 6 = 5 THEN 'timeout'
            ELSE 'HTTP 503 for ' || url END AS error,
          CASE WHEN page_id % 6 <> 5 AND page_id % 4 <> 3 THEN length(html) END AS n_chars
        FROM pages""",
    ),
}
