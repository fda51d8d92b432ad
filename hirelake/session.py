"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Results depend on the first two; the others only shape the physical plan.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Long text expressions make methods that the JVM would refuse to compile
    # (over 8000 bytes); above that limit let Spark split them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Pages are large rows: small Arrow batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # Rows dealt by some of a join's keys are dealt anew: few values would be few tasks.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    # Short rows of a table become long ones: a task of 128 MB would sort several GB.
    "spark.sql.files.maxPartitionBytes": "16m",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "hirelake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Scratch folders that this process has named in the shared folder.
_SHARED: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the scratch folders of this process from the shared folder.

    To be called when results are written: what has been read from intermediate
    tables cannot be read again afterwards.  Returns how many there were; local
    ones go when the process ends.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    gone = 0
    while _SHARED:
        path = hadoop.Path(_SHARED.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder path for intermediate tables.

    On a cluster this lies in the shared folder named by
    ``spark.checkpoint.dir``; where that is unset a local temporary folder is
    made, but only for a local master: executors elsewhere would not share it.
    """
    leaf = f"{purpose}-{uuid.uuid4().hex}"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        path = f"{shared.rstrip('/')}/{leaf}"
        _SHARED.append(path)
        return path
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="hirelake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return os.path.join(folder, leaf)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The result has a known size, so that planning broadcasts it only where it
    is small, and it is computed once however often it is used.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Buckets of a table that is written by its key.
BUCKETS = 256


def bucketed(df: DataFrame, keys: list[str], purpose: str, dealt: bool = False) -> DataFrame:
    """:func:`written` in buckets of ``keys``: joins by them, also of what is made
    from the table row by row, move none of its rows.  Rows that are ``dealt`` by
    the keys in ``BUCKETS`` tasks already are written where they are."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, purpose)
    name = f"bucketed_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(BUCKETS, *keys)
    out = rows.write.option("path", path).option("compression", "zstd")
    out.bucketBy(BUCKETS, *keys).saveAsTable(name, format="parquet")
    return spark.table(name)


def join_in_place(df: DataFrame) -> DataFrame:
    """The frame, whose joins leave rows where they are that some of the keys deal
    out.  For frames planned until :func:`apply_settings` is called again; only
    their plans depend on it, not their results."""
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df
