from pathlib import Path
from types import SimpleNamespace

import pytest

from hirelake import session
from hirelake.session import SETTINGS
from hirelake.sources import landing


def standing_in(spark, folder=None, master="local-cluster[2,1,1024]"):
    """A session whose settings, fixed when a session starts, are others."""
    conf = SimpleNamespace(get=lambda name, default=None: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master), _jvm=spark._jvm, _jsc=spark._jsc)


def test_scratch_in_the_shared_folder_is_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_SHARED", [])
    other = standing_in(spark, f"file://{tmp_path}/shared/")
    path = session.scratch_dir(other, "numbers")
    assert path.startswith(f"file://{tmp_path}/shared/numbers-")
    spark.range(10).write.parquet(path)
    session.scratch_dir(other, "never-written")
    Path(tmp_path / "shared/other").mkdir()
    assert session.release(other) == 1
    assert [p.name for p in (tmp_path / "shared").iterdir()] == ["other"]
    assert session.release(other) == 0


def test_a_cluster_must_name_a_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(standing_in(spark), "x")


def test_a_task_reads_little(spark):
    """Postings are some 40 times as large as what they are read from, and are sorted before they are shuffled."""
    assert SETTINGS["spark.sql.files.maxPartitionBytes"] == "16m"


def test_landed_envelopes_are_compressed(spark, tmp_path):
    body = '{"jobs":[' + ",".join(['{"title":"Engineer of the \u00e4ther"}'] * 2_000) + "]}"
    rows = spark.createDataFrame(
        [("s", 1, 2, 3, True, body, ""), ("s", 1, 2, 4, False, None, "timeout"), ("s", 1, 2, 5, True, "<html>", "")], landing.ENVELOPE
    ).withColumnRenamed("data", "body")
    path = str(tmp_path / "lines")
    landing.land_envelopes(rows, path)
    assert sum(f.stat().st_size for f in Path(path).glob("part-*")) < len(body) / 20
    got = {r.page_no: (r.success, r.body, r.error) for r in landing.read_envelopes(spark, path).collect()}
    assert got == {3: (True, body, ""), 4: (False, None, "timeout"), 5: (True, "<html>", "")}
