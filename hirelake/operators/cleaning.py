"""Which postings stay: title, age, location and first-wins duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions import dates
from hirelake.functions.location import is_us_location
from hirelake.functions.text import filled, posting_key, strip
from hirelake.schema import ORDINAL

# Fixed value: postings older than this many days are dropped.
MAX_AGE_DAYS = 2


def has_title() -> Column:
    return filled(strip(F.col("title")))


def is_too_old(as_of, max_age_days: int = MAX_AGE_DAYS) -> Column:
    """Only a date with an offset can be too old; all others are kept."""
    posted = dates.offset_instant(F.col("date_posted"))
    return F.coalesce(posted < dates.days_before(as_of, max_age_days), F.lit(False))


def drop_reason(as_of, max_age_days: int = MAX_AGE_DAYS) -> Column:
    """The first failing row test, NULL for rows that pass all of them."""
    return (
        F.when(~has_title(), F.lit("title"))
        .when(is_too_old(as_of, max_age_days), F.lit("date"))
        .when(~is_us_location(F.col("location")), F.lit("location"))
    )


def passing(postings: DataFrame, as_of, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    return postings.filter(
        has_title()
        & ~is_too_old(as_of, max_age_days)
        & is_us_location(F.col("location"))
    )


def with_key(postings: DataFrame) -> DataFrame:
    return postings.withColumn("dedup_key", posting_key())


def first_wins(
    postings: DataFrame, key: list[str] | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """The whole first row of each key in input order.

    The rank limit is also applied before the shuffle (one row per key and
    map task), so a key with very many copies costs no more than any other.
    """
    rank = Window.partitionBy(*(key or ["dedup_key"])).orderBy(*(order_by or ORDINAL))
    return postings.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def clean_postings(postings: DataFrame, as_of, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Row tests first, then duplicates; adds ``dedup_key``."""
    return first_wins(with_key(passing(postings, as_of, max_age_days)))


def drop_counters(postings: DataFrame, as_of, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """One row of counters.  Untitled rows also count as duplicates removed,
    because that number is what the other counters leave over.

    Rows are pre-aggregated by (reason, key) before the shuffle; no window.
    """
    reason = F.col("reason")
    groups = (
        postings.select(
            drop_reason(as_of, max_age_days).alias("reason"), posting_key().alias("dedup_key")
        )
        .select("reason", F.when(reason.isNull(), F.col("dedup_key")).alias("dedup_key"))
        .groupBy("reason", "dedup_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    counted = groups.agg(
        rows(F.lit(True)).alias("total"),
        rows(reason == "title").alias("missing_title"),
        rows(reason == "date").alias("filtered_by_date"),
        rows(reason == "location").alias("filtered_by_location"),
        F.count_if(reason.isNull()).alias("remaining"),
    )
    return counted.withColumn(
        "duplicates_removed",
        F.col("total")
        - F.col("remaining")
        - F.col("filtered_by_date")
        - F.col("filtered_by_location"),
    )


def stage_counts(postings: DataFrame, as_of, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Rows by outcome of the row tests: title, date, location or passed."""
    outcome = F.coalesce(drop_reason(as_of, max_age_days), F.lit("passed"))
    return postings.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n_rows"))
