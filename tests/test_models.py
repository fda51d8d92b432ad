import json
import re

import pytest
from pyspark.sql import functions as F

from hirelake import session
from hirelake.operators import exchange
from hirelake.operators import model_tables as mt
from hirelake.plans import checks_exchange, checks_models, checks_reports
from hirelake.plans.run import Run
from hirelake.schema import MODEL_RESPONSE


@pytest.mark.parametrize(("size", "sizes"), [(3, [3] * 8 + [1]), (10, [10, 10, 5])])
def test_batches_keep_order(spark, posting_rows, size, sizes):
    df = posting_rows(*[(f"Job {n}", "Test Co", "Remote") for n in range(25)]).repartition(5)
    got = mt.model_batches(df, F.floor(F.col("item_no") / 4), ["item_no"], size).orderBy("batch_id").collect()
    assert [r.n for r in got] == sizes
    titles = [job["title"] for r in got for job in json.loads(r.jobs_json)]
    assert titles == [f"Job {n}" for n in range(25)]


def _exchanged(df, *names):
    """How many exchanges of a plan carry one of the columns."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = df._sc._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)
    return sum(any(f"{name}#" in columns for name in names) for columns in inputs)


@pytest.mark.parametrize("size", [2, 3, 40])
@pytest.mark.parametrize("width", [1, 5])
def test_batches_over_the_ends_of_chunks(spark, posting_rows, size, width):
    rows = posting_rows(*[(f"Job {n % 30}", "Co", "Remote") for n in range(61)])
    # Sources of 31 and 29 rows and one without a name; places repeat, chunks may be NULL.
    rows = rows.withColumn("source", F.when(F.col("item_no") == 60, None).otherwise(F.concat(F.lit("s"), F.floor(F.col("item_no") / 31).cast("string"))))
    rows = rows.withColumns({"page_no": F.col("item_no") % 30, "item_no": F.col("item_no") % 30})
    chunk = F.when(F.col("page_no") >= 2, F.floor(F.col("page_no") / width))
    got = mt.model_batches(rows.repartition(5), chunk, ["page_no"], size).collect()
    told = {(r.source, r.batch_id): json.loads(r.jobs_json) for r in got}
    assert len(told) == len(got) and all(r.n == len(told[r.source, r.batch_id]) for r in got)
    for source in ("s0", "s1", None):
        mine = rows.filter(F.col("source").eqNullSafe(source)).orderBy("page_no").collect()
        numbers = sorted(b for s, b in told if s == source)
        assert numbers == list(range(-(-len(mine) // size)))
        batches = [told[source, b] for b in numbers]
        assert [len(b) for b in batches[:-1]] == [size] * (len(batches) - 1)
        jobs = [job for b in batches for job in b]
        assert [j["title"] for j in jobs] == [r.title for r in mine]
        assert sorted(j["url"] for j in jobs) == sorted(r.url for r in mine)


def test_whole_rows_are_shuffled_once_for_batches(spark, posting_rows):
    df = posting_rows(*[(f"Job {n}", "Test Co", "Remote") for n in range(25)])
    assert _exchanged(mt.model_batches(df, F.floor(F.col("item_no") / 4), ["item_no"], 3), "description", "_job", "job") == 1


@pytest.mark.parametrize(
    ("text", "titles"),
    [
        ('[{"title":"a"},{"title":"b"}]', ["a", "b"]),
        ('Sure ```json\n[{"title":"old"}]``` or ```json [{"title":"new"}] ``` bye', ["new"]),
        ('```\n{"title":"one"}\n```', ["one"]),
        ('Here: [{"title":"p"}] done.', ["p"]),
        ('{"title":"a"} junk', None),
        ('[{"title":"a"}] [2]', None),
        ("[]", []),
        ("nothing", None),
        ('[{"title":', None),
        (None, None),
    ],
)
def test_response_texts(spark, text, titles):
    df = spark.createDataFrame([(text,)], "t string")
    parsed = df.select(mt.parsed_list(F.col("t"))).first()[0]
    assert (parsed if parsed is None else [job.title for job in parsed]) == titles


def test_fallback_per_batch(spark, posting_rows):
    df = posting_rows(*[(f"Job {n}", "C", "") for n in range(5)])
    batches = mt.model_batches(df, F.lit(0), ["item_no"], 1)
    answers = [("src", 0, '[{"title":"new"}]', None), ("src", 1, "garbage", None),
               ("src", 2, '[{"title":"new"}]', "timed out"), ("src", 3, "[]", None)]
    got = mt.apply_responses(batches, spark.createDataFrame(answers, MODEL_RESPONSE))
    assert [(r.title, r.source, r.job_type) for r in got.orderBy("batch_id").collect()] == [
        ("new", "src", ""), ("Job 1", "src", ""), ("Job 2", "src", ""), ("Job 4", "src", "")
    ]


def test_rules(spark):
    df = spark.createDataFrame(
        [(" senior   DEV ops", "acme", " nyc ", "One. Two! Three? Four.", "", ""),
         ("WEB DEV", "IBM Corp", "SF", "Contract work, v1.2 only", "", "Part-time"),
         ("Summer intern", "x", "Remote", None, "", None)],
        "title string, company string, location string, description string, source string, job_type string",
    )
    got = [tuple(r) for r in mt.normalize_rules(df).select("title", "company", "location", "description", "job_type").collect()]
    assert got == [
        ("senior DEV ops", "Acme", "New York, NY", "One. Two!", ""),
        ("Web Dev", "IBM Corp", "San Francisco, CA", "Contract work, v1.2 only", "Part-time"),
        ("Summer intern", "X", "Remote", "", "Internship"),
    ]


def test_bypass(spark):
    df = spark.createDataFrame([("api",), ("browser",), ("career_page",)], "t string")
    assert [r[0] for r in df.select(mt.bypasses_model(F.col("t"))).collect()] == [True, False, False]
    assert all(r[0] for r in df.select(mt.bypasses_model(F.col("t"), True)).collect())


class _Postings:
    """Inputs of given postings alone."""

    def __init__(self, rows):
        self.rows = rows

    def postings(self):
        return self.rows


def test_answers_meet_their_batches_in_place(spark, posting_rows):
    rows = _Postings(posting_rows(*[(f"Job {n}", "Supplier 1", "x") for n in range(40)]))
    got = checks_models.applied(rows)
    assert _exchanged(got, "jobs_json", "parsed", "_job", "description") == 0
    # Of batches 0 to 13: 6 is answered by an empty list, 13 cannot: 13 is 3 mod 5 and 6 mod 7.
    assert sorted({r.batch_id for r in got.collect()}) == [n for n in range(13) if n != 6]
    assert got.filter("company = 'Vendor 1'").count() == 3 * 8


def test_batches_are_written_where_they_are_numbered(spark, posting_rows, monkeypatch):
    made = []

    def bucketed(df, keys, purpose, dealt=False):
        made.append((df, dealt, session.bucketed(df, keys, purpose, dealt)))
        return made[-1][2]

    monkeypatch.setattr(checks_models, "bucketed", bucketed)
    monkeypatch.setattr(checks_models, "_CHUNK_ORDERS", 4)
    page = F.when(F.col("item_no") > 4, F.col("item_no"))
    rows = posting_rows(*[(f"Job {n}", "Supplier 1", "x") for n in range(60)]).withColumn("page_no", page)
    rows = rows.withColumn("source", F.when(F.col("item_no") % 3 > 0, F.concat(F.lit("s"), F.col("item_no") % 3)))
    got = checks_models.applied(_Postings(rows))
    (df, dealt, table), = made
    assert dealt and _exchanged(df, "description", "_job", "jobs_json") == 1
    assert _exchanged(got, "jobs_json", "parsed") == 0
    plain = checks_models.batches(_Postings(rows))
    assert sorted(map(str, table.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    expected = mt.apply_responses(plain, checks_models.responses(_Postings(rows))).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert got.filter("company = 'Vendor 1'").count() > 20
    # One file a task, whichever places its rows have.
    assert len(table.inputFiles()) <= 2 * table.select("place").distinct().count()
    session.apply_settings(spark)


def test_batches_send_the_same_text_with_and_without_chunks(spark, posting_rows):
    odd = ['quo"te', "back\\slash", "new\nline\u2028", "[a, b]", "{}", "", "Straße 🙂", None]
    df = posting_rows(*[(t, "C", None, "2024") for t in odd]).withColumn("source", F.lit("src"))
    parts = [mt.model_batches(df, chunk, ["item_no"], 3) for chunk in (F.floor(F.col("item_no") / 4), None)]
    a, b = ({(r.batch_id, r.n, r.jobs_json) for r in p.collect()} for p in parts)
    assert a == b and len(a) == 3


def test_rows_of_one_time_are_many_files(spark):
    rows = _Postings(spark.range(40_000).select(F.lit("").alias("date_posted"), F.col("id").alias("src_idx")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hours, dated = checks_reports.from_hours(rows, lambda hours, dated: (hours.collect(), dated))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [tuple(r) for r in hours] == [(None, 40_000)] and dated.columns == ["posted_epoch"]
    sizes = [r["count"] for r in dated.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 10_000


def test_the_first_run_is_made_once(spark, monkeypatch):
    runs = []

    def run(inputs, answers):
        runs.append(answers)
        asks = spark.createDataFrame([("a", "extract", "Source: site 1\n")], "ask_id string, kind string, request string")
        return Run(None, None, None, None, asks if answers is None else exchange.open_asks(asks, answers))

    monkeypatch.setattr(checks_exchange, "_run", run)
    told = {(r.state, r.kind): r.n_asks for r in checks_exchange.open_asks(None).collect()}
    assert told == {("first", "extract"): 1}
    assert len(runs) == 3 and runs[0] is None and None not in runs[1:]
