import os

import pytest
from pyspark.sql import functions as F

from hirelake.operators.cleaning import with_key
from hirelake.sources import seen_levels
from hirelake.sources.seen_levels import Folder, LevelledSeen, Manifest

AS_OF = "2026-03-10 12:00:00"


@pytest.fixture
def table(spark, tmp_path):
    made = LevelledSeen(spark, "levels", str(tmp_path / "seen"), buckets=4, fanout=2, first_level_rows=4).create()
    yield made
    for row in spark.catalog.listTables():
        if row.name.startswith("levels_"):
            spark.sql(f"DROP TABLE {row.name}")


def titles(df):
    return sorted(r.title for r in df.collect())


def files(path):
    return sum(n.endswith(".parquet") for _, _, names in os.walk(path) for n in names)


def test_marks_replays_and_merges_agree_with_a_set(table, posting_rows):
    seen, batches = set(), [[f"t{(7 * n + k) % 40}" for k in range(9)] for n in range(14)]
    for n, batch in enumerate(batches):
        rows = posting_rows(*[(t, "Acme", "Remote") for t in [*batch, batch[0]]])
        fresh = titles(table.mark(rows, AS_OF, n))
        assert fresh == sorted(set(batch) - seen)
        seen |= set(batch)
        # Tried again: the same rows, nothing added, whatever has been merged meanwhile.
        version = table.manifest().version
        assert titles(table.mark(rows, AS_OF, n)) == fresh
        assert table.manifest().version == version
        assert titles(table.read()) == sorted(seen)
    levels = [t.level for t in table.manifest().tables]
    assert max(levels) >= 3 and len(levels) == len({x for x in levels if x}) + levels.count(0)
    assert table.count().first()[0] == len(seen)


def test_files_stay_few_over_many_marks(table, posting_rows, tmp_path):
    counts = []
    for n in range(40):
        table.mark(posting_rows((f"a{n}", "Acme", "x"), (f"b{n // 2}", "Acme", "x")), AS_OF, n)
        counts.append(files(tmp_path / "seen/rows"))
    now = table.manifest()
    assert now.next_seq == 40 and table.count().first()[0] == 60
    # The newest marks, a table a level, and those of the kept older versions.
    assert len(now.tables) <= 2 + 6
    assert max(counts) <= (seen_levels.VERSIONS_KEPT + 1) * (2 * 8 + 6 * 4)
    assert len(os.listdir(tmp_path / "seen/manifest")) <= 2 * seen_levels.VERSIONS_KEPT


def test_a_forgotten_mark_is_new_again(table, posting_rows):
    for n, batch in enumerate((["a", "b"], ["b", "c"], ["c", "d"], ["e"], ["f"])):
        table.mark(posting_rows(*[(t, "Acme", "x") for t in batch]), AS_OF, n)
    table.unmark(1)
    assert titles(table.read()) == ["a", "b", "d", "e", "f"]
    assert titles(table.mark(posting_rows(("c", "Acme", "x"), ("b", "Acme", "x")), AS_OF, 1)) == ["c"]
    for n in range(5, 9):
        table.mark(posting_rows((f"g{n}", "Acme", "x")), AS_OF, n)
    assert titles(table.read()).count("c") == 1
    table.unmark(77)


def test_reset_reopen_and_empty_batches(spark, table, posting_rows):
    assert table.mark(posting_rows(("a", "Acme", "x")).limit(0), AS_OF, 0).count() == 0
    for n in range(1, 5):
        table.mark(posting_rows((f"t{n}", None, None), ("", "", "")), AS_OF, n)
    again = LevelledSeen(spark, "levels", table.path, buckets=4, fanout=2, first_level_rows=4).create()
    assert titles(again.read()) == titles(table.read()) == ["", "t1", "t2", "t3", "t4"]
    again.reset()
    assert table.count().first()[0] == 0
    assert titles(table.mark(posting_rows(("t1", None, None)), AS_OF, 1)) == ["t1"]


def test_a_swap_is_won_by_one_writer(spark, table, posting_rows, monkeypatch):
    before = table.manifest()
    table.mark(posting_rows(("a", "Acme", "x")), AS_OF, 0)
    with pytest.raises(RuntimeError):
        table._swap(before)
    # A mark that dies before its swap has not happened.
    monkeypatch.setattr(LevelledSeen, "_swap", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.mark(posting_rows(("b", "Acme", "x")), AS_OF, 1)
    monkeypatch.undo()
    assert titles(table.read()) == ["a"]
    assert titles(table.mark(posting_rows(("b", "Acme", "x")), AS_OF, 1)) == ["b"]


def test_filters_rule_out_most_new_keys_and_no_old_one(spark, tmp_path):
    key = F.concat(F.lit("key "), F.col("id").cast("string")).alias("dedup_key")
    old, new = spark.range(20_000).select(key), spark.range(20_000, 40_000).select(key)
    blocks = -(-20_000 // seen_levels.BLOCK_KEYS)
    table = LevelledSeen(spark, "filters", str(tmp_path / "f")).create()
    made = seen_levels.Table("level1_x", 1, 20_000, blocks)
    seen_levels.filter_blocks(old, blocks).write.parquet(f"{table.path}/filters/level1_x")
    assert table.likely_keys(old, [made]).count() == 20_000
    assert table.likely_keys(new, [made]).count() < 400


def test_the_history_is_not_shuffled(spark, table, posting_rows):
    for n in range(6):
        table.mark(posting_rows((f"t{n}", "Acme", "x")), AS_OF, n)
    now = table.manifest()
    level = next(t for t in now.tables if t.level)
    asked = with_key(posting_rows(("t1", "Acme", "x"))).select("dedup_key")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        told = table._rows(level, spark).join(asked, "dedup_key")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert told.count("Exchange hashpartitioning") == 1


def test_folder_and_manifest(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/m")
    assert folder.names("manifest") == []
    assert folder.put("manifest/a.json", Manifest(3, 4, [], {"1": 2}, [5]).text())
    assert not folder.put("manifest/a.json", "{}")
    assert folder.names("manifest") == ["a.json"]
    assert Manifest.of(folder.read("manifest/a.json")) == Manifest(3, 4, [], {"1": 2}, [5])


def test_known_keys_are_written_before_they_meet_the_batch(table, posting_rows, monkeypatch):
    """So planning knows that they are few, and the batch's rows are not shuffled for them."""
    kept, plain = {}, seen_levels.written

    def written(df, purpose):
        kept[purpose] = plain(df, purpose)
        return kept[purpose]

    monkeypatch.setattr(seen_levels, "written", written)
    table.mark(posting_rows(("a", "Acme", "x"), ("b", "Acme", "x")), AS_OF, 1)
    fresh = table.mark(posting_rows(("b", "Acme", "x"), ("c", "Acme", "x")), AS_OF, 2)
    assert titles(fresh) == ["c"]
    assert [r.dedup_key for r in kept["known-keys"].collect()] == ["b|acme|x"]
