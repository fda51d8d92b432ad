"""Writers of final postings and of the run history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import dates
from hirelake.schema import ORDINAL, POSTING, POSTING_FIELDS, RUN_HISTORY


def run_folder(base: str, extension: str, as_of: dt.datetime) -> str:
    """Timestamped output name, ``jobs_YYYYmmdd_HHMMSS.<extension>``."""
    return f"{base.rstrip('/')}/jobs_{as_of:%Y%m%d_%H%M%S}.{extension}"


def write_json(postings: DataFrame, path: str) -> str:
    """JSON lines, all eight fields always present."""
    (
        postings.select(*POSTING_FIELDS)
        .write.mode("overwrite")
        .option("ignoreNullFields", "false")
        .json(path)
    )
    return path


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTING).json(path).select(*POSTING_FIELDS)


def write_json_array(postings: DataFrame, path: str, order_by: list[str] | None = None) -> str:
    """Part files that make one JSON array when they are put end to end in name order.

    The first opens it, every element but the first begins with a comma, the last
    closes it; elements are in ``order_by`` (by default the input order), dealt
    by range, and no task writes more than its part.
    """
    order = order_by or ORDINAL
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    record = F.to_json(F.struct(*POSTING_FIELDS), {"ignoreNullFields": "false"})
    rows = postings.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Ranges are cut at rows, so the first partition has the first row.
    first = F.monotonically_increasing_id() == 0
    lines = rows.select(F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), record).alias("value"))
    ends = [postings.sparkSession.createDataFrame([(end,)], "value string").coalesce(1) for end in "[]"]
    ends[0].unionByName(lines).unionByName(ends[1]).write.mode("overwrite").text(path)
    return path


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """The elements of :func:`write_json_array`, without putting parts together."""
    schema = ", ".join(f"{name} STRING" for name in POSTING_FIELDS)
    lines = spark.read.text(path).filter(~F.col("value").isin("[", "]", ""))
    return lines.select(F.from_json(F.ltrim("value", F.lit(",")), schema).alias("x")).select("x.*")


def write_csv(postings: DataFrame, path: str) -> str:
    """CSV with header; an empty table still writes the header."""
    (
        postings.select(*POSTING_FIELDS)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(path)
    )
    return path


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{name} STRING" for name in POSTING_FIELDS)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .option("emptyValue", "")
        .option("nullValue", "\x00")
        .csv(path)
    )


def run_summary(
    final_postings: DataFrame, new_keys: DataFrame, errors: DataFrame, run_id: int, as_of
) -> DataFrame:
    """One row about a run: its counts and its last error, by cycle and source
    where the errors tell them, among equals by text."""
    place = [F.col(c).cast("bigint") if c in errors.columns else F.lit(0).cast("bigint") for c in ("run_id", "src_idx")]
    told = F.struct(*(F.coalesce(p, F.lit(-1)).alias(n) for p, n in zip(place, ("run", "source"))), "error")
    nothing = F.lit(None).cast("struct<run:bigint,source:bigint,error:string>").alias("error")
    marks = (
        final_postings.select(F.lit("job").alias("kind"), nothing)
        .unionByName(new_keys.select(F.lit("new").alias("kind"), nothing))
        .unionByName(errors.select(F.lit("error").alias("kind"), told.cast("struct<run:bigint,source:bigint,error:string>").alias("error")))
    )
    kind = F.col("kind")
    return marks.agg(
        F.count_if(kind == "job").alias("job_count"),
        F.count_if(kind == "new").alias("new_job_count"),
        F.count_if(kind == "error").alias("error_count"),
        F.max("error").getField("error").alias("last_error"),
    ).select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        dates.instant(as_of).alias("finished_at"),
        "job_count",
        "new_job_count",
        "error_count",
        "last_error",
    )


def append_run(summary: DataFrame, path: str) -> None:
    summary.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_HISTORY).parquet(path)


def latest_status(runs: DataFrame, seen: DataFrame) -> DataFrame:
    """The newest run and the number of seen keys."""
    total = seen.agg(F.count(F.lit(1)).alias("seen_count")).scalar()
    return runs.orderBy(F.desc("run_id")).limit(1).withColumn("seen_count", total)
