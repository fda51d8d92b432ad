import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hirelake.plans.run import run_payloads
from hirelake.schema import ARRIVAL, CATALOG_ENTRY
from hirelake.sources import catalog, landing, sinks
from hirelake.sources.seen_table import SeenTable
from hirelake.streaming import closing

AS_OF = "2026-03-10 12:00:00"
FIELDS = [c.split()[0] for c in ARRIVAL.split(", ")]
ENTRIES = [
    (0, "Yelp Careers", "u", "api", "https://api.lever.co/v0/postings/yelp", None, None, None, None),
    (1, "Lyft Careers", "u", "api", "https://api.lever.co/v0/postings/lyft", None, None, None, None),
    (2, "ServiceNow Careers", "u", "api", "https://careers.servicenow.com/jobs/", None, None, None, None),
    (3, "Meta Careers", "https://www.metacareers.com/jobs", "browser", None, None, None, None, None),
    (4, "Idle Careers", "u", "api", "https://api.lever.co/v0/postings/idle", None, None, None, None),
]


def listing(*titles):
    links = "".join(f'<p><i><a href="/jobs/{t}">{t}</a></i></p>' for t in titles)
    return f'<p class="count">1 to 2 of 3</p><div class="job-listing">{links}</div>'


def payload(*titles):
    return json.dumps([{"text": t} for t in titles] + [{"text": f"Filler {n}"} for n in range(100)])


def arrival(kind, run_id, source, **more):
    values = {"kind": kind, "run_id": run_id, "source": source, "success": True, "error": ""} | more
    return tuple(values.get(f) for f in FIELDS)


def pages(run_id):
    """Three micro-batches of a cycle, out of order."""
    return [
        [
            arrival("payload", run_id, "Yelp Careers", page_no=2, body=payload("Ops", "Dev")),
            arrival("card", run_id, "Meta Careers", item_no=2, title="Researcher", url="/j/2", location="Remote"),
            arrival("listing", run_id, "ServiceNow Careers", page_no=1, body=listing("A", "B"), url="u"),
        ],
        [
            arrival("payload", run_id, "Yelp Careers", page_no=1, body=payload("Dev", "QA")),
            arrival("payload", run_id, "Lyft Careers", page_no=1, body=payload("Driver")),
            arrival("payload", run_id, "Nobody", page_no=1, body=payload("Lost")),
            arrival("listing", run_id, "ServiceNow Careers", page_no=3, body=listing("Beyond"), url="u"),
        ],
        [
            arrival("payload", run_id, "Yelp Careers", page_no=3, body=json.dumps([{"text": "Last"}])),
            arrival("payload", run_id, "Yelp Careers", page_no=4, body=payload("Beyond")),
            arrival("payload", run_id, "Lyft Careers", page_no=2, success=False, error="timeout"),
            arrival("payload", run_id, "Lyft Careers", body=payload("No number")),
            arrival("card", run_id, "Meta Careers", item_no=1, title="Engineer", url="/j/1", location="Remote"),
            arrival("listing", run_id, "ServiceNow Careers", page_no=2, body=listing("C"), url="u"),
        ],
    ]


@pytest.fixture
def stage(spark, tmp_path):
    before = {name: spark.conf.get(name, None) for name in closing.STATE_SETTINGS}
    folder = str(tmp_path / "landing")

    class Stage:
        sources = catalog.build_sources(spark.createDataFrame(ENTRIES, CATALOG_ENTRY))
        out, seen = str(tmp_path / "out"), SeenTable(spark, "closing_seen", str(tmp_path / "seen"), 4).create()

        def land(self, rows):
            landing.land_arrivals(spark.createDataFrame(rows, ARRIVAL).coalesce(1), folder)

        def mark(self, kind, run_id, hours=0):
            before = set(Path(folder).rglob("*.parquet"))
            landing.land_marks(self.sources, kind, run_id, folder)
            for file in set(Path(folder).rglob("*.parquet")) - before:
                os.utime(file, (time.time() + 3600 * hours,) * 2)

        def start(self, timeout_minutes=60, **more):
            return closing.run_closing_cycles(
                spark, folder, self.sources, self.seen, self.out, str(tmp_path / "checkpoint"),
                lambda run_id: AS_OF, timeout_minutes, files_per_batch=1, **more,
            )

        def run(self, **more):
            query = self.start(**more)
            done = query.awaitTermination(200)
            query.stop()
            assert done

        def read(self, name):
            path = f"{self.out}/{name}"
            return spark.read.option("basePath", path).parquet(path)

        def batch(self, run_id, rows):
            """The same cycle as a batch over all its pages."""
            df = spark.createDataFrame([r for part in rows for r in part], ARRIVAL)
            kind = {k: df.filter(F.col("kind") == k).drop("kind") for k in ("payload", "listing", "card")}
            return run_payloads(
                kind["payload"], self.sources, AS_OF, cards=kind["card"],
                listings=kind["listing"].withColumnRenamed("body", "html"), run_id=run_id,
            )

    yield Stage()
    spark.sql("DROP TABLE IF EXISTS closing_seen")
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def as_rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_split_cycles_give_the_batch_result_over_restarts(stage):
    parts = {7: pages(7), 8: pages(8)}
    stage.mark("begin", 7)
    stage.land(parts[7][0])
    stage.run()
    # Stopped in the middle of a cycle; another begins before it ends.
    stage.mark("begin", 8)
    for n in (1, 2):
        stage.land(parts[7][n])
        stage.land(parts[8][n])
    stage.run()
    assert stage.read("closed").count() == 0
    stage.mark("end", 7)
    stage.run()
    stage.land(parts[8][0])
    stage.land([arrival("payload", 7, "Yelp Careers", page_no=2, body=payload("Too late"))])
    stage.mark("end", 8)
    stage.run()
    for run_id, rows in parts.items():
        expected = stage.batch(run_id, rows)
        for name, df in (("final", expected.final), ("errors", expected.errors), ("status", expected.status)):
            got = stage.read(name).filter(F.col("cycle") == run_id)
            assert as_rows(got, *df.columns) == as_rows(df, *df.columns)
    titles = {r.title for r in stage.read("final").collect()}
    assert {"Dev", "Ops", "QA", "Last", "Engineer", "A", "B", "C"} <= titles
    assert not titles & {"Beyond", "Too late", "Lost", "No number", "Driver"}
    runs = {r.cycle: r for r in stage.read("runs").collect()}
    assert runs[7].new_job_count == runs[7].job_count > 100 and runs[8].new_job_count == 0
    errors = {r.error for r in stage.read("errors").collect()}
    assert errors == {
        "API fetch failed for Lyft Careers: timeout", "No readable source in the catalog: Nobody",
        "Pages without a number from Lyft Careers",
    }
    late = stage.read("late").collect()
    assert [(r.run_id, r.src_idx, r.page_no) for r in late] == [(7, 0, 2)]


def test_a_cycle_without_an_end_closes_when_its_time_is_over(stage):
    rows = pages(3)
    stage.mark("begin", 3)
    for part in rows:
        stage.land(part)
    stage.run()
    assert stage.read("closed").count() == 0
    # Two hours later the next cycle begins.
    stage.mark("begin", 4, hours=2)
    stage.run()
    expected = stage.batch(3, rows)
    assert as_rows(stage.read("final"), *expected.final.columns) == as_rows(expected.final, *expected.final.columns)
    assert {(r.run_id, r.closed_by) for r in stage.read("released").collect()} == {(3, "timeout")}
    assert sinks.read_runs(stage.seen.spark, f"{stage.out}/runs/*/*").count() == 1
    stage.mark("end", 4, hours=60)
    stage.run()
    assert {(r.run_id, r.closed_by) for r in stage.read("released").collect()} == {(3, "timeout"), (4, "end")}
