"""What has not been seen before: semi and anti joins on the posting key.

Neither side is hinted or collected.  The seen table is only ever joined with
distinct keys: it is bucketed, and a join with a bucketed side is not split
when a key is hot.  Rows meet the keys that are left in a join of two shuffled
sides, which adaptive execution does split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions import dates
from hirelake.operators.cleaning import first_wins, with_key


def keyed(postings: DataFrame) -> DataFrame:
    return postings if "dedup_key" in postings.columns else with_key(postings)


def fresh_seen_rows(postings: DataFrame, seen: DataFrame, as_of, run_id) -> DataFrame:
    """The rows marking a batch as seen would insert: one per unseen key,
    taken from its first row, all with one ``first_seen_at``.

    Copies inside the batch go first, so the join carries one row per key.
    """
    run = run_id if isinstance(run_id, Column) else F.lit(run_id)
    firsts = first_wins(keyed(postings))
    return firsts.join(seen.select("dedup_key"), "dedup_key", "left_anti").select(
        "dedup_key",
        "title",
        "company",
        "url",
        dates.instant(as_of).alias("first_seen_at"),
        run.cast("bigint").alias("run_id"),
    )


def new_rows(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose key is unseen; copies inside the batch all stay.

    A row always has a key: missing fields count as empty in it.
    """
    rows = keyed(postings)
    unseen = rows.select("dedup_key").distinct().join(seen.select("dedup_key"), "dedup_key", "left_anti")
    return rows.join(unseen, "dedup_key", "left_semi")


def keep_new(final_postings: DataFrame, new_keys: DataFrame) -> DataFrame:
    """Final rows whose key is among the new keys."""
    return keyed(final_postings).join(new_keys.select("dedup_key"), "dedup_key", "left_semi")


def seen_count(seen: DataFrame) -> DataFrame:
    return seen.agg(F.count(F.lit(1)).alias("seen_count"))


def emptied(seen: DataFrame) -> DataFrame:
    """The seen table after a reset: its columns without rows."""
    return seen.limit(0)


def first_cycles(keyed_cycles: DataFrame) -> DataFrame:
    """Batch form of repeated runs: each key with the cycle that brought it."""
    return keyed_cycles.groupBy("dedup_key").agg(F.min("cycle").alias("cycle"))


def cycle_new(keyed_cycles: DataFrame) -> DataFrame:
    """Per cycle: distinct keys it had, and how many no earlier cycle had."""
    firsts = first_cycles(keyed_cycles)
    per_cycle = keyed_cycles.groupBy("cycle").agg(
        F.count_distinct("dedup_key").alias("n_keys")
    )
    fresh = firsts.groupBy("cycle").agg(F.count(F.lit(1)).alias("n_new"))
    return per_cycle.join(fresh, "cycle", "left").select(
        "cycle", "n_keys", F.coalesce("n_new", F.lit(0)).alias("n_new")
    )
