"""Cycles that close by themselves.

Fetchers land pages, cards and the marks of a cycle as they come, in any files
and order.  A stream turns each into a slim row and keeps those rows by cycle and
source in keyed state, until the cycle's end mark comes or its time is over; then
they are released.  Bodies are never in the state: a released cycle reads its
own landed files, and of these only the pages that were released, so the result
is that of a batch run over the same pages.

``land_marks`` lands a mark for every source of the catalog in one file, so all
sources of a cycle close in the same batch.  Time is counted from the begin
mark, or where none came, from the source's first page; sources without a begin
mark may then close in different batches, and each batch is cleaned by itself.
What comes for a source after its close is late: it is reported and not read.

The clock is the time at which a file was landed, so a replay sees the same
times, and pages are never too late for the watermark because a fetch was slow.
It goes on with every file of any cycle, such as the next cycle's begin mark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from hirelake.operators.cleaning import MAX_AGE_DAYS
from hirelake.operators.novelty import keep_new
from hirelake.plans.run import CATALOG, KEYS, arrival_stats, run_payloads, with_keys
from hirelake.schema import ARRIVAL, PAGE_STAT
from hirelake.session import written
from hirelake.sources.landing import read_arrivals, with_fetch_errors
from hirelake.sources.sinks import run_summary

STATS = [c.split()[0] for c in PAGE_STAT.split(", ")]
HELD = [c for c in STATS if c not in KEYS]
#: A slim row as it is held, and as it is released.
_HELD_SCHEMA = ", ".join(c for c in PAGE_STAT.split(", ") if c.split()[0] in HELD)
RELEASED = f"{PAGE_STAT}, closed_by STRING"
#: A closed source is remembered for so many times its time-out, to tell what is late.
REMEMBERED = 10
DELAY_MINUTES = 10


class SourcePages(StatefulProcessor):
    """Holds the slim rows of one source in one cycle and releases them at its close.

    A source that nothing came from is released as one row without a kind.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pages = handle.getListState("pages", _HELD_SCHEMA)
        self.cycle = handle.getValueState("cycle", "closed boolean, began boolean, deadline bigint")

    def _until(self, deadline: int | None, before: int | None) -> None:
        if before is not None:
            self.handle.deleteTimer(before)
        if deadline is not None:
            self.handle.registerTimer(deadline)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        marks, held, now = set(), [], 0
        for row in rows:
            now = max(now, row.at_ms)
            if row.kind in ("begin", "end"):
                marks.add(row.kind)
            else:
                held.append(tuple(row[c] for c in HELD))
        closed, began, deadline = self.cycle.get() if self.cycle.exists() else (False, False, None)
        if closed:
            yield from self._rows(key, held, "late")
            return
        if held:
            self.pages.appendList(held)
        if "end" in marks:
            yield from self._release(key, "end", deadline, now)
            return
        if deadline is None or ("begin" in marks and not began):
            self._until(now + self.timeout_ms, deadline)
            self.cycle.update((False, began or "begin" in marks, now + self.timeout_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed, _, deadline = self.cycle.get()
        if closed:
            self.cycle.clear()
            return
        yield from self._release(key, "timeout", None, deadline)

    def _release(self, key, why: str, timer: int | None, now: int) -> Iterator[Row]:
        held = list(self.pages.get()) if self.pages.exists() else []
        self.pages.clear()
        forget = now + (REMEMBERED + 1) * self.timeout_ms
        self._until(forget, timer)
        self.cycle.update((True, True, forget))
        yield from self._rows(key, held or [(None,) * len(HELD)], why)

    def _rows(self, key, held, why: str) -> Iterator[Row]:
        run_id, src_idx = key
        for values in held:
            told = dict(zip(HELD, values))
            yield Row(run_id=run_id, src_idx=src_idx, **told, closed_by=why)


def arrival_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """``ARRIVAL`` rows as they are landed (see ``land_arrivals``), with ``landed_at``."""
    reader = spark.readStream.schema(ARRIVAL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("landed_at", F.col("_metadata.file_modification_time"))


def slim(arrivals: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pages and cards as slim rows, and the marks of each source."""
    marks = with_keys(arrivals.filter(F.col("kind").isin("begin", "end")), catalog)
    numbers = {"n_jobs": F.lit(None).cast("bigint"), "total": F.lit(None).cast("bigint")}
    told = marks.withColumns(numbers).select(*STATS, "landed_at")
    return arrival_stats(arrivals, catalog, "landed_at").unionByName(told)


def released(slim_rows: DataFrame, timeout_minutes: float, delay_minutes: float = DELAY_MINUTES) -> DataFrame:
    """``RELEASED`` rows of the sources that close; needs the RocksDB state store.

    ``delay_minutes`` is by how much a file may be seen after a later one.
    """
    timed = slim_rows.withColumn("at_ms", F.unix_millis("landed_at"))
    return timed.withWatermark("landed_at", f"{int(delay_minutes * 60)} seconds").groupBy(*KEYS).transformWithState(
        statefulProcessor=SourcePages(int(timeout_minutes * 60_000)),
        outputStructType=RELEASED,
        outputMode="Append",
        timeMode="EventTime",
    )


#: State lives in RocksDB on the executors' disks; checkpoints hold what changed.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def run_closing_cycles(
    spark: SparkSession,
    landing: str,
    sources: DataFrame,
    seen,
    out: str,
    checkpoint: str,
    as_of: Callable[[int], object],
    timeout_minutes: float,
    max_age_days: int = MAX_AGE_DAYS,
    files_per_batch: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run each cycle when it closes.

    ``landing`` is the folder of ``land_arrivals``; ``as_of`` gives the clock of
    a cycle from its run_id.  Below ``out``, by cycle and batch: released, final,
    new, errors, status, runs; late rows by batch.  All outputs of a batch are
    replaced when it is tried again, and a released cycle reads only released
    pages, so a replay gives the same tables though more pages have landed.
    """
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    sources = written(sources, "stream-sources")
    catalog = sources.select(*CATALOG)

    def close(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession

        def write(df: DataFrame, name: str, cycle: int | None = None) -> DataFrame:
            part = f"batch={batch_id}" if cycle is None else f"cycle={cycle}/batch={batch_id}"
            path = f"{out}/{name}/{part}"
            df.write.mode("overwrite").parquet(path)
            return session.read.schema(df.schema).parquet(path)

        told = write(batch, "closed")
        cycles = told.filter("closed_by <> 'late'").select("run_id").distinct().orderBy("run_id").collect()
        late = told.filter("closed_by = 'late'")
        if not late.isEmpty():
            write(late, "late")
        # A batch closes few cycles; each is a run of its own.
        for place, row in enumerate(cycles):
            cycle, moment = row.run_id, as_of(row.run_id)
            stats = told.filter((F.col("run_id") == cycle) & (F.col("closed_by") != "late"))
            write(stats, "released", cycle)
            landed = read_arrivals(session, landing, cycle)

            def of_kind(kind: str) -> DataFrame:
                return landed.filter(F.col("kind") == kind).drop("kind")

            run = run_payloads(
                with_fetch_errors(of_kind("payload")),
                sources,
                moment,
                cards=of_kind("card").select(*KEYS, "source", "item_no", "title", "url", "location"),
                listings=with_fetch_errors(of_kind("listing").withColumnRenamed("body", "html"), "html"),
                max_age_days=max_age_days,
                run_id=cycle,
                stats=stats.drop("closed_by").filter("kind IS NOT NULL"),
            )
            write(run.status, "status", cycle)
            errors = write(run.errors, "errors", cycle)
            final = write(run.final, "final", cycle)
            fresh = seen.mark(final, moment, (batch_id << 20) + place)
            write(keep_new(final, fresh), "new", cycle)
            write(run_summary(final, fresh, errors, cycle, moment), "runs", cycle)

    rows = released(slim(arrival_stream(spark, landing, files_per_batch), catalog), timeout_minutes)
    writer = rows.writeStream.outputMode("append").foreachBatch(close).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
