"""The table of keys seen so far.

Parquet, bucketed by ``dedup_key`` so that only the batch side of the anti-join
moves, and partitioned by ``run_id``: marking a batch overwrites that run's own
partition.  A replay of the same run therefore returns the same keys and adds
nothing, whatever happened to the first attempt.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.operators.novelty import fresh_seen_rows, seen_count
from hirelake.schema import SEEN


@contextmanager
def _overwriting(spark: SparkSession, partitions: str):
    """Table inserts take this mode from the session only, so set it there."""
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, partitions)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class SeenTable:
    """``buckets`` should be no fewer than ``spark.sql.shuffle.partitions``: with
    fewer, Spark moves the table to the keys of the batch instead of the other
    way round.  As the table grows, :meth:`compact` moves it to more.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def create(self) -> SeenTable:
        """Create the table if it is absent; runs already on disk are kept."""
        no_rows = self.spark.createDataFrame([], SEEN)
        no_rows.write.mode("append").partitionBy("run_id").parquet(self.path)
        self.spark.sql(
            f"""CREATE TABLE IF NOT EXISTS {self.name} (
                dedup_key STRING NOT NULL, title STRING, company STRING, url STRING,
                first_seen_at TIMESTAMP, run_id BIGINT)
            USING parquet PARTITIONED BY (run_id)
            CLUSTERED BY (dedup_key) INTO {self.buckets} BUCKETS
            LOCATION '{self.path}'"""
        )
        self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def mark(self, postings: DataFrame, as_of, run_id: int) -> DataFrame:
        """Insert the unseen keys of a batch; return exactly these rows.

        The returned frame reads the written partition, so the anti-join is
        not evaluated again against the grown table.
        """
        # A micro-batch has a session of its own; the write takes its settings.
        spark = postings.sparkSession
        before = spark.table(self.name).filter(F.col("run_id") != F.lit(run_id))
        fresh = fresh_seen_rows(postings, before, as_of, run_id)
        # First without the run's rows: an attempt that finds none leaves none.
        self.unmark(run_id, spark)
        # "dynamic": replace the partitions that are written, keep the others.
        with _overwriting(spark, "dynamic"):
            fresh.repartition(self.buckets, "dedup_key").write.mode("overwrite").insertInto(
                self.name
            )
        return spark.table(self.name).filter(F.col("run_id") == F.lit(run_id))

    def unmark(self, run_id: int, spark: SparkSession | None = None) -> None:
        """Forget the keys of a run; where it failed they are new to the next one."""
        spark = spark or self.spark
        spark.createDataFrame([], SEEN).drop("run_id").createOrReplaceTempView("_no_keys")
        # A named partition is replaced even when there is no row.
        spark.sql(
            f"INSERT OVERWRITE TABLE {self.name} PARTITION (run_id = {int(run_id)})"
            " SELECT dedup_key, title, company, url, first_seen_at FROM _no_keys"
        )
        spark.catalog.dropTempView("_no_keys")

    def compact(self, path: str, name: str, buckets: int | None = None) -> SeenTable:
        """A new table with the same rows, each run in one file per bucket.

        Runs of a bucketed table leave a file per bucket each; this also moves
        to another number of buckets as the table grows.  ``run_id`` stays, so
        replays go on to work.  The old table is left as it is.
        """
        grown = SeenTable(self.spark, name, path, buckets or self.buckets).create()
        with _overwriting(self.spark, "dynamic"):
            self.read().repartition(grown.buckets, "dedup_key").write.mode("overwrite").insertInto(name)
        return grown

    def count(self) -> DataFrame:
        return seen_count(self.read())

    def reset(self) -> None:
        """Overwrite all partitions with nothing."""
        with _overwriting(self.spark, "static"):
            self.spark.createDataFrame([], SEEN).write.mode("overwrite").insertInto(self.name)
