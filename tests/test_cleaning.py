from hirelake.operators import cleaning, reporting

AS_OF = "2026-03-10 12:00:00"


def test_age_boundary(posting_rows):
    df = posting_rows(
        ("at the limit", "A", "", "2026-03-08T12:00:00+0000"),
        ("a second older", "A", "", "2026-03-08T11:59:59+0000"),
        ("older, no offset", "A", "", "2020-01-01T00:00:00"),
        ("older, day only", "A", "", "2020-01-01"),
        ("older, fraction", "A", "", "2020-01-01T00:00:00.000+0000"),
        ("future", "A", "", "2030-01-01T00:00:00Z"),
    )
    kept = {r.title for r in cleaning.passing(df, AS_OF).collect()}
    assert kept == {
        "at the limit", "older, no offset", "older, day only", "older, fraction", "future"
    }


def test_first_wins_and_counters(posting_rows):
    df = posting_rows(
        ("  ", "A", "Paris, France", "2020-01-01T00:00:00Z"),  # title decides first
        ("Dev", "A", "Paris, France", "2020-01-01T00:00:00Z"),  # then date
        ("Dev", "A", "Paris, France"),  # then location
        ("Dev", "A", "Austin, TX"),
        (" DEV ", "a", "austin, tx"),
        ("Dev", "A", "Remote"),
    )
    rows = cleaning.clean_postings(df, AS_OF).collect()
    assert sorted((r.title, r.location, r.item_no) for r in rows) == [
        ("Dev", "Austin, TX", 3), ("Dev", "Remote", 5)
    ]
    counters = cleaning.drop_counters(df, AS_OF).first().asDict()
    assert counters == {
        "total": 6, "missing_title": 1, "filtered_by_date": 1, "filtered_by_location": 1,
        "remaining": 2, "duplicates_removed": 2,
    }


def test_hot_key_is_cut_before_the_shuffle(spark, posting_rows):
    df = posting_rows(*[("Dev", "A", "Remote")] * 300, *[(f"t{n}", "A", "") for n in range(30)])
    result = cleaning.first_wins(cleaning.with_key(df.repartition(8)))
    assert result.filter("title = 'Dev'").first().item_no == 0
    assert result.count() == 31
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") != plan.rindex("WindowGroupLimit")


def test_empty_input(posting_rows):
    empty = posting_rows(("x", "y", "z")).filter("false")
    assert cleaning.clean_postings(empty, AS_OF).count() == 0
    assert cleaning.drop_counters(empty, AS_OF).first()["duplicates_removed"] == 0
    assert [tuple(r) for r in reporting.summary(empty).collect()] == [("total", "No jobs found.", 0)]
