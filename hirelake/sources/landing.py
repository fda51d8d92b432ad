"""Readers of landed rows.  Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.schema import ARRIVAL, LANDED_PAGE, LANDED_PAYLOAD, RAW_CARD


def _read(spark: SparkSession, path: str, schema: str, file_format: str) -> DataFrame:
    return spark.read.schema(schema).format(file_format).load(path)


def read_payloads(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return with_fetch_errors(_read(spark, path, LANDED_PAYLOAD, file_format))


def read_pages(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    told = F.concat(
        F.lit("HTTP "), F.col("status_code").cast("string"), F.lit(" for "), F.coalesce("url", F.lit(""))
    )
    return with_fetch_errors(_read(spark, path, LANDED_PAGE, file_format), "html", told)


def read_cards(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    return _read(spark, path, RAW_CARD, file_format)


def with_fetch_errors(
    fetched: DataFrame, data: str = "body", told: Column | None = None
) -> DataFrame:
    """A failed fetch has an error text and no data.  Where the landing only
    kept the HTTP status, the text (``told``) is made from it."""
    ok, error = F.coalesce("success", F.lit(False)), F.coalesce("error", F.lit(""))
    if "status_code" in fetched.columns:
        status = F.col("status_code")
        bad = F.coalesce(status != 200, F.lit(False))
        if told is None:
            told = F.concat(F.lit("API returned HTTP "), status.cast("string"))
        ok = ok & ~bad
        error = F.coalesce(F.nullif("error", F.lit("")), F.when(bad, told), F.lit(""))
    return fetched.withColumns(
        {
            "success": ok,
            "error": F.when(ok, F.lit("")).otherwise(error),
            data: F.when(ok, F.col(data)),
        }
    )


# A line of a landed file: who was asked, and the envelope of the answer.
ENVELOPE = "source STRING, run_id BIGINT, src_idx BIGINT, page_no BIGINT, success BOOLEAN, data STRING, error STRING"


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of envelopes as ``LANDED_PAYLOAD`` rows.

    ``data`` is any JSON value and is kept as its text.  A text that came
    instead of JSON is landed as a string and stays what it was.
    """
    lines = spark.read.schema(ENVELOPE).json(path).withColumnRenamed("data", "body")
    for name, kind in (("fetched_at", "timestamp"), ("status_code", "int")):
        lines = lines.withColumn(name, F.lit(None).cast(kind))
    return with_fetch_errors(lines)


def land_envelopes(payloads: DataFrame, path: str) -> None:
    """Append payloads as JSON lines of envelopes, each task its own file, compressed."""
    quoted = F.get_json_object(F.to_json(F.struct(F.col("body").alias("b"))), "$")
    # The body stands in the line as JSON where it is that, else as a string.
    body = F.when(F.try_parse_json("body").isNotNull(), F.col("body")).otherwise(
        F.regexp_extract(quoted, r'(?s)^\{"b":(.*)\}$', 1)
    )
    names = ["source", "run_id", "src_idx", "page_no", "success", "error"]
    head = F.to_json(F.struct(*names))
    line = F.when(
        F.col("body").isNotNull(), F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"data":'), body, F.lit("}"))
    ).otherwise(head)
    payloads.select(F.regexp_replace(line, "[\r\n]+", " ").alias("value")).write.mode("append").text(path, compression="gzip")


def land_payloads(payloads: DataFrame, path: str) -> None:
    """Write payloads so that one shape's scan reads only its own files."""
    payloads.write.mode("append").partitionBy("provider").parquet(path)


def land_arrivals(arrivals: DataFrame, path: str) -> None:
    """Append arrivals so that reading a cycle back opens its own files only."""
    arrivals.write.mode("append").partitionBy("run_id").parquet(path)


def marks(sources: DataFrame, kind: str, run_id: int) -> DataFrame:
    """A ``begin`` or ``end`` mark of a cycle for every source, as ``ARRIVAL`` rows.

    One more mark, without a source, is for pages that no source of the catalog owns.
    """
    told = {"kind": F.lit(kind), "run_id": F.lit(run_id), "src_idx": F.col("src_idx"), "source": F.col("name")}
    columns = [c.split() for c in ARRIVAL.split(", ")]

    def rows(frame: DataFrame, values: dict) -> DataFrame:
        return frame.select(*(values.get(name, F.lit(None)).cast(kind_).alias(name) for name, kind_ in columns))

    nobody = {name: told[name] for name in ("kind", "run_id")}
    return rows(sources, told).unionByName(rows(sources.sparkSession.range(1), nobody))


def land_marks(sources: DataFrame, kind: str, run_id: int, path: str) -> None:
    """Land the marks of a cycle in one file, which a stream reads as one."""
    land_arrivals(marks(sources, kind, run_id).coalesce(1), path)


def read_arrivals(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    """What has landed for a cycle.  Cycle 0 includes rows without a cycle."""
    rows = spark.read.schema(ARRIVAL).parquet(path)
    mine = F.col("run_id") == run_id
    return rows.filter(mine | F.col("run_id").isNull() if run_id == 0 else mine)
