import pytest
from pyspark.sql import functions as F

from hirelake.functions import dates, text
from hirelake.functions.location import is_us_location
from hirelake.functions.position import running_position


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    return [r[0] for r in df.orderBy("n").select(expression(F.col("v"))).collect()]


def test_locations(spark):
    expected = {
        None: True, "": True, "  ": True, "Not Specified": True, "\tRemote ": True, "US": True,
        "USA": True, "Remote - Australia": True, "Remote (United States)": True,
        "Remote, Germany": False, "Milwaukee, Wisconsin": False, "Indianapolis, Indiana": False,
        "Santa Fe, New Mexico": False, "Toronto, CA": True, "Berlin, DE": True,
        "Bengaluru, IN": True, "Dublin, OH": True, "Dublin, Ohio": False, "Austin, tx ": True,
        "Paris, France, US": True, "SÃO PAULO": False, "London": True, "England": False,
        "Springfield": True, "Washington, DC": True, "Munich, Germany, usa": True,
    }
    got = column(spark, list(expected), is_us_location)
    assert dict(zip(expected, got)) == expected


def test_key_strips_lowers_and_collides(spark):
    df = spark.createDataFrame(
        [(" SWE ", "Acme\t", None), ("a|b", "c", "x"), ("a", "b|c", "x")], "t string, c string, l string"
    )
    keys = [r[0] for r in df.select(text.dedup_key(F.col("t"), F.col("c"), F.col("l"))).collect()]
    assert keys == ["swe|acme|", "a|b|c|x", "a|b|c|x"]


@pytest.mark.parametrize(
    ("value", "trusted", "reported"),
    [
        ("2026-02-14T13:46:00+0000", "2026-02-14 13:46:00", "2026-02-14 13:46:00"),
        ("2026-02-14T13:46:00Z", "2026-02-14 13:46:00", "2026-02-14 13:46:00"),
        ("2026-02-14T13:46:00-05:00", "2026-02-14 18:46:00", "2026-02-14 18:46:00"),
        ("2026-02-14T13:46-05:00", "2026-02-14 18:46:00", "2026-02-14 18:46:00"),
        ("2026-03-11", None, "2026-03-11 00:00:00"),
        ("2026-03-11T10:00:00", None, "2026-03-11 10:00:00"),
        ("2026-02-14T13:46:00.000+0000", None, None),
        ("2026-02-30T00:00:00+0000", None, None),
        ("", None, None),
        ("garbage", None, None),
        (None, None, None),
    ],
)
def test_two_readings_of_a_date(spark, value, trusted, reported):
    read = lambda f: column(spark, [value], lambda v: f(v).cast("string"))[0]
    assert (read(dates.offset_instant), read(dates.report_instant)) == (trusted, reported)


def test_relative_days(spark):
    texts = ["Posted Today", "Posted Yesterday", "Posted 4 Days Ago", "Posted 30+ Days Ago",
             "Posted 1 Day Ago", "", "soon", "99999999999 Days", None]
    got = column(spark, texts, lambda v: dates.days_ago_text(v, "2026-03-10 08:00:00"))
    assert got == [
        "2026-03-10T08:00:00+0000", "2026-03-09T08:00:00+0000", "2026-03-06T08:00:00+0000",
        "2026-02-08T08:00:00+0000", "2026-03-09T08:00:00+0000", "", "", "", "",
    ]


def test_display_in_a_zone(spark):
    values = ["2026-02-14T13:46:00+0000", "2026-03-11", "odd", "", None]
    got = column(spark, values, lambda v: dates.display_text(v, "America/New_York"))
    assert got == ["Feb 14, 08:46 AM", "Mar 10, 08:00 PM", "odd", "Date unknown", "Date unknown"]


def test_capitalize_and_slug(spark):
    assert column(spark, ["FULL-TIME work", ""], text.capitalize) == ["Full-time work", ""]
    assert column(spark, ['A & B "x" <y>'], text.company_slug) == ["a-&amp;-b-&quot;x&quot;-&lt;y&gt;"]


def test_positions_do_not_depend_on_chunks(spark):
    rows = [("hot", n) for n in range(500)] + [(f"s{n}", n) for n in range(20)]
    df = spark.createDataFrame(rows, "source string, n int").repartition(7)
    for width in (1, 7, 1000):
        got = running_position(df, ["source"], ["n"], F.floor(F.col("n") / width)).collect()
        hot = sorted((r.n, r.position) for r in got if r.source == "hot")
        assert hot == [(n, n) for n in range(500)]
        assert all(r.position == 0 for r in got if r.source != "hot")


def test_iso_forms(spark):
    """Forms that the standard reader of ISO texts takes, against that reader."""
    import datetime as dt

    from hirelake.functions import dates

    texts = [
        "2026-03-01T10:00:00.1234567Z", "2026-03-01T10+00:00", "20260301T100000Z", "20260301T1000-0530",
        "20260301T10Z", "2026-03-01T10:00:00,5+00:00", "2026-03-01T10:00:00.123+0000",
        "2026-03-01 10:00:00.123456789-05", "20260301 100000.5+01:00", "2026-03-01T10:00Z",
    ]
    bad = ["2026-03-01T1000:00Z", "2026-13-01T10:00:00Z", "garbage", "", None, "2026-03-01T10:00:00"]
    rows = [(t,) for t in texts + bad]
    df = spark.createDataFrame(rows, "t string")
    found = {
        r.t: r.at for r in df.select("t", F.unix_micros(dates.iso_instant(F.col("t"))).alias("at")).collect()
    }
    zero = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    for t in texts:
        assert found[t] == (dt.datetime.fromisoformat(t) - zero) // dt.timedelta(microseconds=1), t
    assert all(found[t] is None for t in bad)


def test_any_number_of_days_ago(spark):
    from hirelake.functions import dates

    texts = ["Posted 700001 Days Ago", "Posted 739000 Days Ago", "Posted 99999999999999999999 Days Ago", "Posted 4000000 Days Ago"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r.d for r in df.select(dates.days_ago_text(F.col("t"), "2026-03-10T00:00:00").alias("d")).collect()]
    assert found[0].startswith("0109-") and found[1].startswith("0002-") and found[2:] == ["", ""]


def test_positions_of_null_keys(spark):
    from hirelake.functions.position import running_position

    df = spark.createDataFrame([("a", 1), (None, 1), (None, None)], "k string, n bigint")
    found = running_position(df, ["k"], ["n"], F.col("n")).collect()
    assert sorted((r.k or "", r.position) for r in found) == [("", 0), ("", 1), ("a", 0)]
