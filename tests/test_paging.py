import random

import pytest

from hirelake.operators import paging

SCHEMA = "source string, provider string, page_no bigint, success boolean, error string, n_jobs bigint, total bigint"


def one_by_one(provider, pages):
    """The cut-off as a loop over the pages of one source."""
    rule, rows = paging.STOP_RULES[provider], 0
    for number, (success, n, total) in enumerate(pages, 1):
        if not success:
            return number, True
        before, rows, total = rows, rows + n, total or 0
        position = {
            "offset": (number - 1) * rule.step, "page": number, "rows": rows, "rows_before": before
        }[rule.cap]
        if (
            n < rule.min_rows
            or (rule.total == "always" and rows >= total)
            or (rule.total == "known" and 0 < total <= rows)
            or position >= rule.limit
        ):
            return number, False
    return len(pages), False


def test_limits_equal_a_page_loop(spark):
    rng = random.Random(5)
    sources, rows = {}, []
    for n in range(240):
        provider = rng.choice(list(paging.STOP_RULES))
        full = 100 if provider == "lever" else rng.choice([1, 5, 20])
        total = rng.choice([None, 0, 37, 10**6])
        pages = [
            (rng.random() > 0.002, full if rng.random() > 0.01 else 0, total)
            for _ in range(rng.choice([3, 60, 520]))
        ]
        sources[f"s{n}"] = (provider, pages)
        rows += [
            (f"s{n}", provider, i, ok, "" if ok else "HTTP 500", k, t)
            for i, (ok, k, t) in enumerate(pages, 1)
        ]
    stats = spark.createDataFrame(rows, SCHEMA)
    got = {r.source: (r.last_page, r.failed) for r in paging.page_limits(stats).collect()}
    assert got == {name: one_by_one(*source) for name, source in sources.items()}


@pytest.mark.parametrize(("provider", "rows", "pages"), [("workday", 20, 26), ("amazon", 10, 51), ("github", 50, 10)])
def test_caps(spark, provider, rows, pages):
    stats = spark.createDataFrame(
        [("s", provider, n, True, "", rows, 10**6) for n in range(1, 80)], SCHEMA
    )
    assert paging.cut_pages(stats, paging.page_limits(stats)).count() == pages


def test_failure_discards_the_source(spark):
    stats = spark.createDataFrame(
        [
            ("bad", "workday", 1, True, "", 20, 100), ("bad", "workday", 2, False, "API returned HTTP 503", 0, None),
            ("late", "workday", 1, True, "", 20, 20), ("late", "workday", 2, False, "x", 0, None),
            ("sn", "servicenow", 1, False, "HTTP 404", 0, None),
        ],
        SCHEMA,
    )
    limits = paging.page_limits(stats)
    assert {r.source for r in paging.drop_failed(stats, limits).collect()} == {"late"}
    assert sorted(r.error for r in paging.failed_sources(limits).collect()) == [
        "API fetch failed for bad: API returned HTTP 503", "Fetch failed for sn: HTTP 404"
    ]
