import datetime as dt

from hirelake.operators import reporting
from hirelake.schema import POSTING_FIELDS
from hirelake.sources import landing, sinks

AS_OF = "2026-03-10 12:00:00"


def test_recency_is_strict_and_filter_inclusive(posting_rows):
    df = posting_rows(
        ("hour", "A", "", "2026-03-10T11:00:00Z"), ("future", "A", "", "2026-03-11"),
        ("day", "A", "", "2026-03-10"), ("undated", "A", "", "garbage"),
    )
    got = reporting.recency_counts(df, AS_OF).first().asDict()
    assert got == {"all_time": 4, "within_1h": 1, "within_3h": 2, "within_6h": 2, "within_24h": 3,
                   "within_48h": 3, "undated": 1}
    shown = {r.title for r in reporting.time_filter(df, AS_OF, 1).collect()}
    assert shown == {"hour", "future"}


def test_ties_keep_first_seen_order(posting_rows):
    df = posting_rows(("1", "Zed", "x"), ("2", "Ann", "y"), ("3", "Bob", "x"), ("4", "Bob", "z"))
    assert [r.company for r in reporting.by_company(df).collect()] == ["Bob", "Zed", "Ann"]
    assert [r.location for r in reporting.by_location(df).collect()] == ["x", "y", "z"]


def test_views(spark, posting_rows):
    df = posting_rows(("Dev <b>", "A B", "x"), ("Ops", "a-b", "x"), ("Dev", "C", "x"))
    keys = spark.createDataFrame([("ops|a-b|x",), ("ops|a-b|x",)], "dedup_key string")
    flagged = reporting.flag_new(df, keys)
    view = lambda **s: sorted(r.title for r in reporting.search_view(flagged, AS_OF, **s).collect())
    assert view(query=" DEV ") == ["Dev", "Dev <b>"]
    assert view(slug="a-b") == ["Dev <b>", "Ops"]
    assert view(only_new=True, query="dev", hours=1) == ["Ops"]
    assert reporting.headline(flagged).first().label == "1 new job"
    totals = {tuple(r) for r in reporting.view_counts(flagged).collect()}
    assert ("All Companies", 3, 3) in totals and len(totals) == 4
    assert [tuple(r) for r in reporting.view_counts(flagged.filter("false")).collect()] == [("All Companies", 0, 0)]


def test_preview_and_digest(posting_rows):
    df = posting_rows(*[(f"t{n:02}", f"c{n % 2}", "x") for n in range(13)])
    rows = reporting.preview(df).collect()
    assert [r.title for r in rows] == [f"t{n:02}" for n in range(10)] and rows[0].more == 3
    assert [r.title for r in reporting.digest(df).collect()][:2] == ["t00", "t02"]
    assert reporting.digest_lead(df).first().subject == "13 new job posting(s)"


def test_standardize(posting_rows):
    row = reporting.standardize(posting_rows((" T ", None, "\tx "))).first()
    assert (row.title, row.company, row.location) == ("T", "", "x")


def test_sinks_round_trip(spark, posting_rows, tmp_path):
    df = posting_rows(('He said "hi", then\nleft', " a ", "\\x"), ("", "b", ""))
    expected = sorted(tuple(r) for r in df.select(*POSTING_FIELDS).collect())
    for write, read in ((sinks.write_json, sinks.read_json), (sinks.write_csv, sinks.read_csv)):
        path = write(df, str(tmp_path / write.__name__))
        assert sorted(tuple(r) for r in read(spark, path).collect()) == expected
    empty = sinks.write_csv(df.filter("false"), str(tmp_path / "empty"))
    assert spark.read.text(empty).first()[0].replace('"', "") == ",".join(POSTING_FIELDS)
    assert sinks.run_folder("/out", "csv", dt.datetime(2026, 3, 1, 2, 3, 4)) == "/out/jobs_20260301_020304.csv"


def test_history(spark, posting_rows, tmp_path):
    final = posting_rows(("a", "b", "c"), ("d", "e", "f"))
    errors = spark.createDataFrame([("API fetch failed for x: y",)], "error string")
    path = str(tmp_path / "runs")
    for run in (1, 2):
        sinks.append_run(sinks.run_summary(final, final.limit(run), errors, run, AS_OF), path)
    latest = sinks.latest_status(sinks.read_runs(spark, path), final).first()
    assert (latest.run_id, latest.job_count, latest.new_job_count, latest.error_count, latest.seen_count) == (2, 2, 2, 1, 2)


def test_fetch_errors(spark):
    rows = [(True, None, "{}", 200), (False, "timeout", "{}", None), (True, None, "{}", 503)]
    df = spark.createDataFrame(rows, "success boolean, error string, body string, status_code int")
    got = [tuple(r)[:3] for r in landing.with_fetch_errors(df).collect()]
    assert got == [(True, "", "{}"), (False, "timeout", None), (False, "API returned HTTP 503", None)]
