import pytest

from hirelake.operators import novelty
from hirelake.sources.seen_table import SeenTable

AS_OF = "2026-03-10 12:00:00"


@pytest.fixture
def seen(spark, tmp_path):
    name = "seen_" + tmp_path.name.replace("-", "_")
    table = SeenTable(spark, name, str(tmp_path / "seen"), buckets=4).create()
    yield table
    spark.sql(f"DROP TABLE {name}")


def keys(df):
    return sorted(r.dedup_key for r in df.collect())


SWE, PM, QA = (("SWE", "Acme", "New York, NY"), ("PM", "Acme", "Remote"), ("QA", "Beta", ""))


def test_only_new_keys_are_returned(seen, posting_rows):
    assert len(keys(seen.mark(posting_rows(SWE, PM), AS_OF, 1))) == 2
    assert keys(seen.mark(posting_rows(SWE, PM), AS_OF, 2)) == []
    assert keys(seen.mark(posting_rows(SWE, PM, QA), AS_OF, 3)) == ["qa|beta|"]
    assert seen.count().first()[0] == 3


def test_empty_batch_and_reset(seen, posting_rows):
    assert keys(seen.mark(posting_rows(SWE).filter("false"), AS_OF, 1)) == []
    assert seen.count().first()[0] == 0
    seen.mark(posting_rows(SWE), AS_OF, 2)
    seen.reset()
    assert seen.count().first()[0] == 0
    assert keys(seen.mark(posting_rows(SWE), AS_OF, 3)) == ["swe|acme|new york, ny"]


def test_case_and_location_in_one_batch(seen, posting_rows):
    batch = posting_rows(SWE, ("swe", "ACME", "new york, ny"), ("SWE", "Acme", "Remote"))
    rows = seen.mark(batch, AS_OF, 1).collect()
    assert sorted((r.title, r.url) for r in rows) == [
        ("SWE", "https://example.com/0"), ("SWE", "https://example.com/2")
    ]


def test_replay_of_a_run_returns_the_same(seen, posting_rows):
    seen.mark(posting_rows(SWE), AS_OF, 1)
    first = keys(seen.mark(posting_rows(SWE, PM), AS_OF, 2))
    assert keys(seen.mark(posting_rows(SWE, PM), AS_OF, 2)) == first == ["pm|acme|remote"]
    assert seen.count().first()[0] == 2


def test_new_rows_keep_copies(seen, posting_rows):
    batch = posting_rows(SWE, SWE, PM)
    assert novelty.new_rows(batch, seen.read()).count() == 3
    seen.mark(batch, AS_OF, 1)
    assert novelty.new_rows(batch, seen.read()).count() == 0


def test_anti_join_does_not_shuffle_the_seen_side(seen, spark, posting_rows):
    seen.mark(posting_rows(SWE), AS_OF, 1)
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", str(seen.buckets))
    try:
        plan = novelty.new_rows(posting_rows(PM), seen.read())._jdf.queryExecution().executedPlan()
            # Distinct keys of the batch, and its rows to join them back.
        assert plan.toString().count("Exchange hashpartitioning") == 2
        assert "Bucketed: true" in plan.toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_replay_without_rows_unmark_and_compact(spark, posting_rows, tmp_path):
    table = SeenTable(spark, "seen_replayed", str(tmp_path / "seen"), buckets=4).create()
    table.mark(posting_rows(("Old", "Acme", "Remote")), "2026-03-10T00:00:00", 0)
    assert table.mark(posting_rows(("A", "x", "y"), ("B", "x", "y")), "2026-03-10T00:00:00", 1).count() == 2
    replayed = table.mark(posting_rows(("A", "x", "y")).limit(0), "2026-03-10T00:00:00", 1)
    assert replayed.count() == 0 and table.count().first()[0] == 1
    table.mark(posting_rows(("A", "x", "y")), "2026-03-10T00:00:00", 2)
    grown = table.compact(str(tmp_path / "grown"), "seen_grown", buckets=8)
    assert sorted(r.run_id for r in grown.read().collect()) == [0, 2]
    table.unmark(2)
    assert [r.run_id for r in table.read().collect()] == [0]
    for name in ("seen_replayed", "seen_grown"):
        spark.sql(f"DROP TABLE {name}")


def test_new_rows_join_keys_before_rows(spark, posting_rows):
    """Only distinct keys meet the seen side; a hot key's rows meet keys in a join of two shuffles."""
    from hirelake.operators import novelty

    rows = posting_rows(*[("Same", "Acme", "Remote")] * 5, ("Other", "Acme", "Remote"))
    seen = novelty.fresh_seen_rows(rows.filter("title = 'Other'"), rows.limit(0).selectExpr("'' AS dedup_key"), "2026-03-10T00:00:00", 1)
    assert [r.title for r in novelty.new_rows(rows, seen).collect()] == ["Same"] * 5
    plan = novelty.new_rows(rows, seen)._jdf.queryExecution().optimizedPlan().toString()
    anti = plan[plan.index("LeftAnti") :]
    assert "Aggregate" in anti and "title" not in anti.split("Aggregate")[1].split("\n")[0]
