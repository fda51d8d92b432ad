"""Landed payloads that never move again.

Bodies are keyed by cycle and source and dealt into buckets once, when they
arrive; the one row per source and cycle that says what to keep is dealt the same
way.  Their join then needs no exchange, however many cycles there are, and
neither side has to be small.  A source with very many pages in a cycle is
several keys: the number of its chunk of pages is part of the bucket key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.schema import LANDED_PAYLOAD
from hirelake.session import scratch_dir

#: Pages of a source that share a bucket.
CHUNK_PAGES = 512
#: Cycles whose files share a folder, which readers of one cycle prune to.
CYCLES_A_BLOCK = 1_000
BUCKET_KEY = ["run_id", "src_idx", "chunk"]
SCHEMA = f"{LANDED_PAYLOAD}, provider STRING, base_url STRING, site_number STRING, chunk BIGINT"


def chunk_of(page_no: Column) -> Column:
    return F.floor((F.coalesce(page_no, F.lit(1)) - 1) / CHUNK_PAGES)


class BucketedLanding:
    """``buckets`` is fixed for a table; about as many as a cluster has cores."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def create(self) -> BucketedLanding:
        """Open the table; what has landed below the path is kept."""
        no_rows = self.spark.createDataFrame([], f"{SCHEMA}, block BIGINT")
        no_rows.write.mode("append").partitionBy("block").parquet(self.path)
        self.spark.sql(
            f"""CREATE TABLE IF NOT EXISTS {self.name} ({SCHEMA}, block BIGINT)
            USING parquet PARTITIONED BY (block)
            CLUSTERED BY ({", ".join(BUCKET_KEY)}) INTO {self.buckets} BUCKETS
            LOCATION '{self.path}'"""
        )
        self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return self

    def add(self, keyed: DataFrame) -> None:
        """Append payloads that have run_id, src_idx and the catalog's columns (``run.with_keys``).

        The one exchange that a body goes through.
        """
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        block = F.floor(F.col("run_id") / CYCLES_A_BLOCK)
        rows = keyed.withColumns({"chunk": chunk_of(F.col("page_no")), "block": block})
        for name in columns:
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None))
        dealt = rows.select(*columns, "block").repartition(self.buckets, *BUCKET_KEY)
        dealt.write.insertInto(self.name)

    def read(self, run_id: int | None = None) -> DataFrame:
        rows = self.spark.table(self.name)
        if run_id is not None:
            rows = rows.filter((F.col("block") == run_id // CYCLES_A_BLOCK) & (F.col("run_id") == run_id))
        return rows.drop("block")

    def beside(self, slim: DataFrame, purpose: str) -> DataFrame:
        """Write rows that have the bucket key into buckets like the landing's, and read them."""
        path = scratch_dir(self.spark, purpose)
        name = f"{self.name}_{path.rsplit('-', 1)[-1]}"
        dealt = slim.repartition(self.buckets, *BUCKET_KEY).write.option("path", path)
        dealt.bucketBy(self.buckets, *BUCKET_KEY).saveAsTable(name, format="parquet")
        return self.spark.table(name)

    def kept(self, pages: DataFrame, limits: DataFrame) -> DataFrame:
        """Pages of this landing up to the last of each source, none of a failed source.

        ``limits`` as of ``paging.page_limits`` by run_id and src_idx.  The
        limits of a bucket are its build side: bodies are not sorted either.
        """
        chunks = F.sequence(F.lit(0).cast("bigint"), chunk_of(F.col("last_page")))
        ends = limits.filter(~F.col("failed")).select(
            F.col("run_id").cast("bigint").alias("run_id"),
            F.col("src_idx").cast("bigint").alias("src_idx"),
            F.explode(chunks).alias("chunk"),
            "last_page",
        )
        told = self.beside(ends, "bucketed-limits").hint("shuffle_hash")
        return pages.join(told, BUCKET_KEY).filter(F.col("page_no") <= F.col("last_page")).drop("last_page", "chunk")
