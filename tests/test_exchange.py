import json
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hirelake.functions.position import ranged, ranged_position
from hirelake.operators import exchange, model_tables
from hirelake.operators.model_tables import is_record
from hirelake.plans import checks_exchange
from hirelake.plans.run import Run, answered_run, read_payloads, run_payloads
from hirelake.schema import LANDED_PAYLOAD, POSTING
from hirelake.sources import sinks

AS_OF = "2026-03-10 12:00:00"


@pytest.mark.parametrize(
    "text, titles",
    [
        ('[{"title":"A"}, 5, null, "x", [1], {"title":"B"}]', ["A", None, None, None, None, "B"]),
        ('{"title":"A"}', ["A"]),
        ('```json\n[{"title":"A"}]\n``` and so on', ["A"]),
        ("[]", []),
        ('[{"title":"A"}] and [{"title":"B"}]', None),
        ('{"title":"A"}]} x', None),
        ('{"title":"A"}],"end":1} x', None),
        ('{"title":"A"} {"title":"B"}', None),
        ('[{"title":"A"}, {"title":', None),
        ("5", None),
        ('"[1"', None),
        ("", None),
        (None, None),
        ('[{"title":7,"company":{"a":[1]}}]', ["7"]),
    ],
)
def test_answers_are_read_once_and_by_element(spark, text, titles):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(model_tables.parsed_list(F.col("text")).alias("x")).first().x
    assert (None if got is None else [r and r.title for r in got]) == titles
    told = model_tables.answer_quality(df.withColumn("ask_id", F.lit("k"))).first()
    good = [t for t in titles or [] if t is not None]
    assert (told.readable, told.records, told.strays) == (titles is not None, len(good), len(titles or []) - len(good))


def asks(spark, *rows):
    return spark.createDataFrame(rows, "ask_id string, kind string, request string")


def answers(spark, *rows):
    return spark.createDataFrame(rows, exchange.ANSWER)


def test_a_request_is_open_once_until_it_has_a_good_answer(spark):
    asked = asks(spark, *[("a", "extract", "A")] * 50, ("b", "extract", "B"), ("c", "normalize", "C"), (None, "extract", None))
    told = answers(spark, ("a", None, "timed out"), ("b", "[]", ""), ("b", None, "late"), ("z", "[]", None))
    got = exchange.open_asks(asked, told).collect()
    assert sorted((r.ask_id, r.request) for r in got) == [("a", "A"), ("c", "C")]
    assert exchange.open_asks(asked, answers(spark)).count() == 3


def sources(spark):
    rows = [
        (0, "Api", "u0", "api", "lever"), (1, "Html", "https://h", "career_page", "html"), (2, "Blank", "u2", "career_page", "html"),
    ]
    made = spark.createDataFrame(rows, "src_idx bigint, name string, url string, type string, provider string")
    none = F.lit(None).cast("string")
    return made.withColumns({"error": none, "base_url": none, "site_number": none})


def test_a_run_asks_then_uses_answers_in_every_cycle(spark):
    landed = spark.createDataFrame(
        [("Api", 1, True, "", json.dumps([{"text": "Dev"}]), None, None, n, 0) for n in (1, 2)], LANDED_PAYLOAD
    )
    contexts = spark.createDataFrame(
        [(n, s, "https://h/x", c) for n in (1, 2) for s, c in (("Html", "some text"), ("Blank", ""), ("Api", "t"), ("No", "t"))],
        "run_id bigint, source string, url string, context string",
    )

    def run(told):
        return run_payloads(
            landed, sources(spark), AS_OF, contexts=contexts, answers=told, skip_normalization=False
        )

    first = run(None)
    asked = first.asks.collect()
    # Two cycles show the same page: one request.  API rows are not normalized, API pages not read.
    assert [r.kind for r in asked] == ["extract"] and "some text" in asked[0].request
    assert sorted(r.title for r in first.postings.collect()) == ["Dev", "Dev"]
    told = [(asked[0].ask_id, '[{"title":"a"},{"title":"b","url":"v"},3,{"title":"c"},{"title":"d"}]', None)]
    second = run(answers(spark, *told))
    batches = second.asks.collect()
    assert [r.kind for r in batches] == ["normalize"] * 2
    assert sorted(r.title for r in second.postings.collect()) == ["Dev", "Dev", *"aabbccdd"]
    for r in batches:
        rows = r.request.split("\n", 1)[1].rsplit("\n", 1)[0]
        told.append((r.ask_id, rows.replace('"title":"a"', '"title":7').replace('"title":"d","company":null', '"title":"D","company":"C"'), ""))
    third = run(answers(spark, *told))
    assert third.asks.count() == 0
    got = sorted((r.run_id, r.title, r.url, r.source, r.provider) for r in third.postings.collect() if r.provider == "html")
    expected = [("7", "https://h/x"), ("D", "https://h/x"), ("b", "v"), ("c", "https://h/x")]
    assert got == [(n, t, u, "Html", "html") for n in (1, 2) for t, u in expected]
    # A number for a title, no company, and echoed nulls are wrong types; the rows stay.
    assert sorted(r.title for r in third.invalid.filter("run_id = 1 AND src_idx = 1").collect()) == ["7", "D", "b", "c"]
    assert {r.error for r in third.errors.collect()} == {"No text content to parse for Blank"}
    failed = run(answers(spark, (asked[0].ask_id, None, "no memory")))
    assert "LLM call failed for Html: no memory" in {r.error for r in failed.errors.collect()}
    assert failed.asks.count() == 1


def test_a_hot_source_is_numbered_by_many_tasks(spark):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("source"), F.xxhash64("id").alias("place"), "id"
    )
    got = ranged_position(rows, ["source"], ["place"])
    expected = F.row_number().over(Window.partitionBy("source").orderBy("place")) - 1
    assert got.withColumn("other", expected).filter("position <> other").count() == 0
    assert got.count() == 40_000 and set(got.columns) == {"source", "place", "id", "position"}
    dealt = ranged(rows, ["source", "place"])
    sizes = [r["count"] for r in dealt.groupBy(F.shiftright("_id", 33)).count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_batches_need_no_chunk(spark, posting_rows):
    rows = posting_rows(*[(f"t{n}", "Acme", "x") for n in range(8)])
    got = model_tables.model_batches(rows, None, ["item_no"], 3).collect()
    titles = {r.batch_id: [j["title"] for j in json.loads(r.jobs_json)] for r in got}
    assert titles == {0: ["t0", "t1", "t2"], 1: ["t3", "t4", "t5"], 2: ["t6", "t7"]}


def joined(path):
    return "".join(f.read_text() for f in sorted(Path(path).glob("part-*")))


def test_parts_are_one_array(spark, posting_rows, tmp_path):
    rows = posting_rows(*[(f't"{n}\n', "Acme", None) for n in range(100)])
    path = sinks.write_json_array(rows, str(tmp_path / "array"))
    assert [r["title"] for r in json.loads(joined(path))] == [f't"{n}\n' for n in range(100)]
    assert len(list(Path(path).glob("part-*"))) > 4
    assert sinks.read_json_array(spark, path).count() == 100
    for n in (0, 1):
        sinks.write_json_array(rows.limit(n), path)
        assert len(json.loads(joined(path))) == n
    assert json.loads(joined(path))[0].keys() == {c.split()[0] for c in POSTING.split(", ")[:8]}


def test_answers_are_used_without_reading_again(spark, monkeypatch):
    reads, runs = [], []
    asks = spark.createDataFrame([("a", "extract", "Source: site 1\n")], "ask_id string, kind string, request string")

    def run(reading, told, skip_normalization):
        runs.append(reading)
        return Run(None, None, asks.selectExpr("1 run_id", "1 src_idx", "kind source", "ask_id error"), None, asks)

    monkeypatch.setattr(checks_exchange, "_read", lambda inputs: reads.append(inputs) or "read")
    monkeypatch.setattr(checks_exchange, "answered_run", run)
    assert checks_exchange.page_errors("inputs").count() == 1
    assert reads == ["inputs"] and runs == ["read"] * 3


def test_a_reading_gives_what_whole_runs_give(spark):
    landed = spark.createDataFrame(
        [("Api", 1, True, "", json.dumps([{"text": "Dev"}]), None, None, 1, 0)], LANDED_PAYLOAD
    )
    contexts = spark.createDataFrame(
        [(1, s, "https://h/x", c) for s, c in (("Html", "some text"), ("Blank", ""), ("Api", "t"))],
        "run_id bigint, source string, url string, context string",
    )
    reading = read_payloads(landed, sources(spark), AS_OF, contexts=contexts)
    asked = answered_run(reading, None, False).asks.collect()
    for text, error in (('[{"title":"a"}]', None), (None, "no memory")):
        told = answers(spark, (asked[0].ask_id, text, error))
        on = answered_run(reading, told, False)
        again = run_payloads(landed, sources(spark), AS_OF, contexts=contexts, answers=told, skip_normalization=False)
        for name in ("postings", "final", "errors", "status", "asks", "invalid"):
            one, other = getattr(on, name), getattr(again, name)
            assert sorted(map(str, one.collect())) == sorted(map(str, other.collect())), name


def test_objects_are_records(spark):
    texts = ["{}", '{"title":null}', '{"x":1}', "[1]", "5", "null", '"OBJECT"', "true", "{"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    told = rows.select("t", is_record(F.try_parse_json("t")).alias("r"))
    assert [r.r for r in told.collect()] == [True, True, True, False, False, False, False, False, None]
    assert "schema_of_variant" not in told._jdf.queryExecution().optimizedPlan().toString()
