"""The run as a stream: every trigger is one cycle over what has landed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hirelake.functions.text import posting_key
from hirelake.operators.cleaning import MAX_AGE_DAYS, clean_postings
from hirelake.operators.novelty import keep_new
from hirelake.plans.run import run_payloads
from hirelake.schema import LANDED_PAYLOAD, POSTING
from hirelake.sources.landing import with_fetch_errors
from hirelake.sources.seen_table import SeenTable
from hirelake.sources.sinks import run_summary


def posting_stream(spark: SparkSession, folder: str, files_per_cycle: int | None = None) -> DataFrame:
    """Flattened postings arriving as Parquet files."""
    reader = spark.readStream.schema(POSTING)
    if files_per_cycle:
        reader = reader.option("maxFilesPerTrigger", files_per_cycle)
    return reader.parquet(folder)


def payload_stream(spark: SparkSession, folder: str, files_per_cycle: int | None = None) -> DataFrame:
    """Landed payloads arriving as Parquet files."""
    reader = spark.readStream.schema(LANDED_PAYLOAD)
    if files_per_cycle:
        reader = reader.option("maxFilesPerTrigger", files_per_cycle)
    return reader.parquet(folder)


def run_cycles(
    arrivals: DataFrame,
    seen: SeenTable,
    out: str,
    checkpoint: str,
    as_of: Callable[[int], object],
    sources: DataFrame | None = None,
    max_age_days: int = MAX_AGE_DAYS,
    every_minutes: int | None = None,
    keep_going: bool = False,
) -> StreamingQuery:
    """Clean each batch, mark it seen, write what is new and a history row.

    ``arrivals`` are postings or, with ``sources`` given, payloads; then the
    page cut-off, the flattening and the source status are part of a cycle.
    Below ``out`` a cycle writes final, new, status and runs.

    ``as_of`` gives the clock of a cycle from its batch number.  Every output
    of a batch replaces what an earlier attempt of that batch wrote, so a
    replay after a lost driver leaves the same tables.

    A failed cycle ends the query, and a restart tries it again.  With
    ``keep_going`` it is reported instead: its rows go to ``failed``, its error
    to the history, and the next cycle runs.
    """

    def cycle(batch: DataFrame, batch_id: int, done: dict | None = None) -> None:
        spark, moment = batch.sparkSession, as_of(batch_id)

        def write(df: DataFrame, name: str) -> DataFrame:
            path = f"{out}/{name}/batch={batch_id}"
            if done is not None:
                done[path] = df.schema
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        if sources is None:
            cleaned = clean_postings(batch, moment, max_age_days)
            errors = spark.createDataFrame([], "error string")
        else:
            run = run_payloads(with_fetch_errors(batch), sources, moment, max_age_days=max_age_days)
            write(run.status, "status")
            cleaned, errors = run.final, write(run.errors, "errors")
        # Written once and read back: marking, selecting and counting would
        # otherwise each clean the batch again.
        final = write(cleaned, "final")
        fresh = seen.mark(final, moment, batch_id)
        write(keep_new(final, fresh), "new")
        write(run_summary(final, fresh, errors, batch_id, moment), "runs")

    def reported(batch: DataFrame, batch_id: int) -> None:
        done: dict = {}
        try:
            cycle(batch, batch_id, done)
        except Exception as error:
            # Its keys may be marked already: they must be new to a later cycle,
            # and what it has shown of them must not be there twice then.
            seen.unmark(batch_id, batch.sparkSession)
            for path, schema in done.items():
                batch.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(path)
            batch.write.mode("overwrite").parquet(f"{out}/failed/batch={batch_id}")
            none = batch.sparkSession.createDataFrame([], "error string")
            told = batch.sparkSession.createDataFrame([(str(error),)], "error string")
            # No clock here: asking for it may be what failed.
            summary = run_summary(none, none, told, batch_id, F.lit(None).cast("timestamp"))
            summary.write.mode("overwrite").parquet(f"{out}/runs/batch={batch_id}")

    writer = arrivals.writeStream.foreachBatch(reported if keep_going else cycle)
    writer = writer.option("checkpointLocation", checkpoint)
    if every_minutes:
        return writer.trigger(processingTime=f"{every_minutes} minutes").start()
    return writer.trigger(availableNow=True).start()


def first_time_keys(postings: DataFrame) -> DataFrame:
    """Each key once ever, without a table: the state lives in the checkpoint.

    Keys never expire, as in the table form; for very long runs prefer
    :func:`run_cycles`, whose memory of keys is a bucketed table on disk.
    """
    return postings.withColumn("dedup_key", posting_key()).dropDuplicates(["dedup_key"])
