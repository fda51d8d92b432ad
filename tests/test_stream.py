import json

import pytest
from pyspark.sql import functions as F

from hirelake.operators import cleaning
from hirelake.schema import CATALOG_ENTRY, RAW_PAYLOAD
from hirelake.sources import catalog, sinks
from hirelake.sources.seen_table import SeenTable
from hirelake.streaming import cycles
from hirelake.streaming.closing import STATE_SETTINGS

AS_OF = "2026-03-10 12:00:00"


def land(posting_rows, folder, cycle, *titles):
    rows = posting_rows(*[(t, "Acme", "Remote") for t in titles])
    rows.coalesce(1).write.parquet(f"{folder}/cycle={cycle}")


def test_cycles_surface_only_new_rows_and_resume(spark, posting_rows, tmp_path):
    landing = str(tmp_path / "landing")
    table = SeenTable(spark, "seen_stream", str(tmp_path / "seen"), buckets=4).create()

    def run():
        stream = cycles.posting_stream(spark, f"{landing}/*", files_per_cycle=1)
        cycles.run_cycles(
            stream, table, str(tmp_path / "out"), str(tmp_path / "checkpoint"), lambda _: AS_OF
        ).awaitTermination(120)

    land(posting_rows, landing, 1, "Dev", "Ops", "dev", "")
    land(posting_rows, landing, 2, "Ops", "QA")
    run()
    land(posting_rows, landing, 3, "QA", "Dev", "PM")
    run()
    new = spark.read.option("basePath", str(tmp_path / "out/new")).parquet(str(tmp_path / "out/new"))
    assert sorted(r.title for r in new.collect()) == ["Dev", "Ops", "PM", "QA"]
    history = sinks.read_runs(spark, str(tmp_path / "out/runs/*")).orderBy("run_id").collect()
    assert [r.new_job_count for r in history][-1] == 1 and sum(r.job_count for r in history) == 7
    assert table.count().first()[0] == 4
    spark.sql("DROP TABLE seen_stream")


def test_payload_cycles_report_failures_and_go_on(spark, tmp_path):
    entries = spark.createDataFrame(
        [(0, "Yelp Careers", "u", "api", "https://api.lever.co/v0/postings/yelp", None, None, None, None)],
        CATALOG_ENTRY,
    )
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    table = SeenTable(spark, "seen_payloads", str(tmp_path / "seen"), buckets=4).create()
    for n, titles in enumerate((["Dev"], ["Dev"], ["Dev", "Ops"])):
        body = json.dumps([{"text": t} for t in titles])
        rows = [("Yelp Careers", 1, n != 0, "timeout" if n == 0 else "", body, None)]
        spark.createDataFrame(rows, RAW_PAYLOAD).coalesce(1).write.parquet(f"{landing}/cycle={n}")

    def clock(batch_id):
        if batch_id == 1:
            raise ValueError("no clock")
        return AS_OF

    cycles.run_cycles(
        cycles.payload_stream(spark, f"{landing}/*", 1), table, out, str(tmp_path / "checkpoint"),
        clock, sources=catalog.build_sources(entries), keep_going=True,
    ).awaitTermination(120)
    runs = sinks.read_runs(spark, f"{out}/runs/*").orderBy("run_id").collect()
    assert [(r.job_count, r.new_job_count, r.error_count) for r in runs] == [(0, 0, 1), (0, 0, 1), (2, 2, 0)]
    assert runs[0].last_error == "API fetch failed for Yelp Careers: timeout"
    assert "no clock" in runs[1].last_error
    assert spark.read.parquet(f"{out}/failed/batch=1").count() == 1
    assert [r.state for r in spark.read.parquet(f"{out}/status/batch=0").collect()] == ["error"]
    spark.sql("DROP TABLE seen_payloads")


def test_a_late_failure_leaves_nothing_shown(spark, posting_rows, tmp_path, monkeypatch):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    table = SeenTable(spark, "seen_late", str(tmp_path / "seen"), buckets=4).create()
    summary, calls = cycles.run_summary, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("history is full")
        return summary(*args)

    monkeypatch.setattr(cycles, "run_summary", lambda *a: failing(*a) if len(calls) < 2 and a[0].columns != ["error"] else summary(*a))
    for n in (1, 2):
        land(posting_rows, landing, n, "Dev", "Ops")
    stream = cycles.posting_stream(spark, f"{landing}/*", files_per_cycle=1)
    cycles.run_cycles(
        stream, table, out, str(tmp_path / "checkpoint"), lambda _: AS_OF, keep_going=True
    ).awaitTermination(120)
    new = spark.read.option("basePath", f"{out}/new").parquet(f"{out}/new")
    assert sorted((r.batch, r.title) for r in new.collect()) == [(1, "Dev"), (1, "Ops")]
    runs = sinks.read_runs(spark, f"{out}/runs/*").orderBy("run_id").collect()
    assert [(r.new_job_count, r.last_error) for r in runs] == [(0, "history is full"), (2, None)]
    spark.sql("DROP TABLE seen_late")


@pytest.mark.parametrize("settings", [{}, STATE_SETTINGS])
def test_keys_once_ever_survive_a_restart(spark, posting_rows, tmp_path, settings):
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        keys_once_ever(spark, posting_rows, tmp_path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    if settings:
        # State on disk: files of the store, and the changes of each batch beside its snapshots.
        state = tmp_path / "checkpoint/state/0/0"
        assert list(state.glob("*.changelog")) and not list(state.glob("*.delta"))


def keys_once_ever(spark, posting_rows, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")

    def run():
        stream = cycles.first_time_keys(cycles.posting_stream(spark, f"{landing}/*"))
        (
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True).start(out).awaitTermination(120)
        )
        return spark.read.parquet(out)

    land(posting_rows, landing, 1, "Dev", "Ops", "DEV")
    assert run().count() == 2
    land(posting_rows, landing, 2, "dev", "QA")
    got = run()
    assert got.count() == 3
    # The stream has seen what a batch over everything would keep.
    batch = cleaning.with_key(spark.read.parquet(f"{landing}/*")).select("dedup_key").distinct()
    assert got.select("dedup_key").exceptAll(batch).count() == 0
    assert batch.filter(F.col("dedup_key") != "").count() == 3
