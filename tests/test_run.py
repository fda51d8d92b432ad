import json

from pyspark.sql import functions as F

from hirelake.plans import run as plan
from hirelake.operators import paging, payloads
from hirelake.plans import checks_payloads, checks_run
from hirelake.plans.views import Inputs
from hirelake.schema import CATALOG_ENTRY, LANDED_PAYLOAD
from hirelake.session import written
from hirelake.sources import catalog

AS_OF = "2026-03-10 12:00:00"
LEVER = "https://api.lever.co/v0/postings/x"


def page(*titles):
    return json.dumps([{"text": t} for t in titles])


def inputs(spark):
    entries = [
        (n, name, "u", kind, api, None, None, None, None)
        for n, (name, kind, api) in enumerate(
            [("Same", "api", LEVER), ("Same", "api", LEVER), ("Bad", "api", LEVER),
             ("Page", "career_page", None), ("Shop", "browser", None), ("Idle", "browser", None)]
        )
    ]
    rows = [
        ("Same", 1, True, "", page("A"), None, None, 1, 0),
        ("Same", 1, True, "", page("B"), None, None, 1, 1),
        ("Same", 1, False, "timeout", None, None, None, 2, 0),
        ("Bad", 1, True, "", "<html>", None, None, 1, None),
        ("Nobody", 1, True, "", page("C"), None, None, 1, None),
        (None, None, None, None, None, None, None, None, None),
    ]
    sources = catalog.build_sources(spark.createDataFrame(entries, CATALOG_ENTRY))
    return spark.createDataFrame(rows, LANDED_PAYLOAD), sources


def test_cycles_and_namesakes_stay_apart(spark):
    landed, sources = inputs(spark)
    pages = spark.createDataFrame([("Page", False, "HTTP 404 for u")], "source string, success boolean, error string")
    tries = spark.createDataFrame([("Shop", None)], "source string, error string")
    run = plan.run_payloads(landed, sources, AS_OF, html_pages=pages, attempts=tries)
    assert sorted((r.run_id, r.src_idx, r.title) for r in run.postings.collect()) == [(1, 0, "A"), (1, 1, "B")]
    assert {r.src_idx: (r.state, r.pages_landed, r.pages_kept) for r in run.status.collect()} == {
        0: ("done", 2, 1), 1: ("done", 1, 1), 2: ("error", 1, 0),
        3: ("error", 0, 0), 4: ("done", 0, 0), 5: ("waiting", 0, 0),
    }
    assert sorted(r.error for r in run.errors.collect()) == [
        "API fetch failed for Bad: response is no JSON",
        "API fetch failed for Same: timeout",
        "No readable source in the catalog: ",
        "No readable source in the catalog: Nobody",
        "Scraper failed for Page: HTTP 404 for u",
    ]


def test_bodies_are_not_shuffled(spark, tmp_path):
    landed, sources = inputs(spark)
    landed.write.parquet(str(tmp_path / "landed"))
    rows = plan.with_keys(
        spark.read.parquet(str(tmp_path / "landed")), written(sources.select(*plan.CATALOG), "sources")
    )
    limits = written(
        spark.createDataFrame([(1, 0, 1, False)], "run_id bigint, src_idx bigint, last_page bigint, failed boolean"),
        "limits",
    )
    kept = paging.drop_failed(rows, limits, plan.KEYS)
    told = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in told
    assert not any("Exchange" in line and "body" in line for line in told.splitlines())
    assert kept.count() == 1


def test_payloads_are_built_once(spark, tmp_path):
    parts = [(n, f"part {n % 7}", f"brand {n % 3}", f"type {n % 5}", n % 9) for n in [*range(45), 3]]
    parts.append((None, "none", None, "type", 1))
    columns = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"
    spark.createDataFrame(parts, columns).write.parquet(str(tmp_path / "part.parquet"))
    inputs = Inputs(spark, str(tmp_path))
    built, rows = checks_payloads.every_payload(inputs), checks_run.landed(inputs)
    # Facts are shuffled, not eleven jobs that repeat them; a run reads what was landed.
    assert "job_github" not in built._jdf.queryExecution().optimizedPlan().toString()
    told = rows._jdf.queryExecution().executedPlan().toString()
    assert "to_json" not in told and "Exchange" not in told
    keys = ["provider", "src_idx", "page_no", "body"]
    first = sorted(map(str, rows.filter("run_id = 0").withColumn("src_idx", F.expr("src_idx div 16")).select(keys).collect()))
    assert first == sorted(map(str, built.select(keys).collect())) and len(first) == 4 * len(payloads.SHAPES)
