import json
import re

from pyspark.sql import functions as F

from hirelake.operators import paging
from hirelake.plans import run as plan
from hirelake.schema import CATALOG_ENTRY, LANDED_PAYLOAD
from hirelake.session import written
from hirelake.sources import catalog
from hirelake.sources.bucketed import CHUNK_PAGES, BucketedLanding

AS_OF = "2026-03-10 12:00:00"
LEVER = "https://api.lever.co/v0/postings/x"


def inputs(spark, cycles=3, sources=5, pages=4):
    entries = [(n, f"S{n}", "u", "api", LEVER, None, None, None, None) for n in range(sources)]
    body = json.dumps([{"text": f"Job {k}"} for k in range(100)])
    rows = [
        (f"S{s}", p, (s + p + c) % 7 > 0, "late", body if p < 3 else body[:0] + '[{"text": "Last"}]', None, None, c, s)
        for c in range(cycles) for s in range(sources) for p in range(1, pages + 1)
    ]
    landed = spark.createDataFrame([*rows, ("Nobody", 1, True, "", body, None, None, 1, None)], LANDED_PAYLOAD)
    return landed, catalog.build_sources(spark.createDataFrame(entries, CATALOG_ENTRY))


def table(spark, tmp_path, name, landed, sources, buckets=4):
    landing = BucketedLanding(spark, name, str(tmp_path / name), buckets).create()
    known = written(sources.select(*plan.CATALOG), "sources")
    for cycle in (0, 1, 2):
        landing.add(plan.with_keys(landed, known, cycle))
    return landing


def exchanged(df) -> list[str]:
    """Outputs of all exchanges in the plan that hold the body."""
    plan_text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    parts = re.split(r"\n\n(?=\(\d+\) )", plan_text)
    return [p for p in parts if re.match(r"\(\d+\) \w*Exchange", p) and "body" in p]


def test_runs_agree_with_frames_and_read_one_cycle(spark, tmp_path):
    landed, sources = inputs(spark)
    landing = table(spark, tmp_path, "bucketed_runs", landed, sources)
    for run_id in (None, 1):
        got = plan.run_payloads(landing, sources, AS_OF, run_id=run_id)
        expected = plan.run_payloads(landed, sources, AS_OF, run_id=run_id)
        for name in ("postings", "final", "errors", "status"):
            a, b = getattr(got, name), getattr(expected, name)
            assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect())), name
    spark.sql("DROP TABLE bucketed_runs")


def test_millions_of_limits_move_no_body(spark, tmp_path):
    landed, sources = inputs(spark)
    landing = table(spark, tmp_path, "bucketed_plan", landed, sources, buckets=16)
    numbers = spark.range(3_000_000)
    limits = numbers.select(
        F.floor(F.col("id") / 100).alias("run_id"), (F.col("id") % 100).alias("src_idx"),
        F.lit(2).cast("bigint").alias("last_page"), (F.col("id") % 11 == 0).alias("failed"),
    )
    kept = landing.kept(landing.read(), limits)
    told = kept._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in told and "Broadcast" not in told
    assert exchanged(kept) == [] and "Exchange" not in told
    expected = landing.read().join(limits.filter("NOT failed"), ["run_id", "src_idx"]).filter("page_no <= last_page")
    assert kept.count() == expected.count() > 0
    # The same join of a frame does move them.
    plain = paging.drop_failed(landed, written(limits, "limits"), plan.KEYS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanged(plain) != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("DROP TABLE bucketed_plan")


def test_a_source_of_many_pages_is_many_keys(spark, tmp_path):
    landing = BucketedLanding(spark, "bucketed_hot", str(tmp_path / "hot"), 8).create()
    pages = spark.range(5 * CHUNK_PAGES).select(
        F.lit("S").alias("source"), (F.col("id") + 1).alias("page_no"), F.lit("[]").alias("body"),
        F.lit(1).cast("bigint").alias("run_id"), F.lit(0).cast("bigint").alias("src_idx"),
    )
    landing.add(pages.withColumn("page_no", F.when(F.col("page_no") != 7, F.col("page_no"))))
    limits = spark.createDataFrame(
        [(1, 0, 4 * CHUNK_PAGES + 3, False)], "run_id bigint, src_idx bigint, last_page bigint, failed boolean"
    )
    kept = landing.kept(landing.read(1), limits)
    assert kept.count() == 4 * CHUNK_PAGES + 2
    used = landing.read().withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert used > 1
    # Another session finds what has landed.
    spark.sql("DROP TABLE bucketed_hot")
    assert BucketedLanding(spark, "bucketed_hot", str(tmp_path / "hot"), 8).create().read().count() == 5 * CHUNK_PAGES
    spark.sql("DROP TABLE bucketed_hot")
