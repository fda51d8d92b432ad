"""Registered queries: the tables of seen keys themselves, marked year by year."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators import cleaning
from hirelake.plans.checks_cleaning import WIDE_AGE, sql_tested
from hirelake.plans.views import AS_OF, Inputs
from hirelake.session import scratch_dir
from hirelake.sources.seen_levels import LevelledSeen

#: This year's mark is taken back at the end, and made again under this number.
TAKEN_BACK, AGAIN = 1997, 9999


def _table(inputs: Inputs) -> LevelledSeen:
    name = f"seen_{uuid.uuid4().hex[:8]}"
    # Small levels, so that the marks of a check are merged several times.
    return LevelledSeen(
        inputs.spark, name, scratch_dir(inputs.spark, "seen"), buckets=8, fanout=2, first_level_rows=10_000
    ).create()


def _years(inputs: Inputs) -> tuple[DataFrame, list[int]]:
    rows = cleaning.with_key(inputs.postings()).withColumn("year", F.year("fetched_at"))
    return rows, [r.year for r in rows.select("year").distinct().orderBy("year").collect()]


def _marked(inputs: Inputs) -> LevelledSeen:
    table = _table(inputs)
    rows, years = _years(inputs)
    for year in years:
        table.mark(rows.filter(F.col("year") == year), AS_OF, year)
    # A cycle that is tried again adds nothing.
    table.mark(rows.filter(F.col("year") == years[0]), AS_OF, years[0])
    return table


def seen_cycles(inputs: Inputs) -> DataFrame:
    table = _marked(inputs)
    table.unmark(TAKEN_BACK)
    rows, _ = _years(inputs)
    table.mark(rows.filter(F.col("year") == TAKEN_BACK), AS_OF, AGAIN)
    return table.read().withColumn("first_seen_at", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss"))


def seen_table_reset(inputs: Inputs) -> DataFrame:
    """Keys after all marks, after the reset, and after one year is marked again."""
    table = _marked(inputs)
    counts = [("marked", table.count().first()[0])]
    table.reset()
    counts.append(("reset", table.count().first()[0]))
    rows, years = _years(inputs)
    fresh = table.mark(rows.filter(F.col("year") == years[0]), AS_OF, years[0])
    counts.append(("again", fresh.count()))
    return inputs.spark.createDataFrame(counts, "state string, n_keys bigint")


_FIRSTS = f"""{sql_tested(WIDE_AGE)},
firsts AS (SELECT DISTINCT ON (dedup_key) *, year(fetched_at) AS first_year FROM tested
           ORDER BY dedup_key, year(fetched_at), src_idx, page_no, item_no, url)"""

QUERIES = {
    "seen_cycles": (
        seen_cycles,
        f"""WITH {_FIRSTS}
        SELECT dedup_key, title, company, url, '{AS_OF}' AS first_seen_at,
          CAST(CASE first_year WHEN {TAKEN_BACK} THEN {AGAIN} ELSE first_year END AS bigint) AS run_id
        FROM firsts""",
    ),
    "seen_table_reset": (
        seen_table_reset,
        f"""WITH {_FIRSTS}
        SELECT 'marked' AS state, count(*) AS n_keys FROM firsts
        UNION ALL SELECT 'reset', 0
        UNION ALL SELECT 'again', count(DISTINCT dedup_key) FROM tested
          WHERE year(fetched_at) = (SELECT min(year(fetched_at)) FROM tested)""",
    ),
}
