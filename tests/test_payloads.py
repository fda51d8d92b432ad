import json

import pytest
from pyspark.sql import functions as F

from hirelake.operators import payloads
from hirelake.plans.run import run_payloads
from hirelake.schema import CATALOG_ENTRY, HTML_PAGE, RAW_PAYLOAD
from hirelake.sources import catalog

AS_OF = "2026-03-10 12:00:00"


@pytest.fixture
def flat(spark):
    """Flatten one body, by the single provider's plan and by the joint one."""

    def run(provider, body, base_url="https://jobs.example.com", site="CX_1"):
        text = body if isinstance(body, str) else json.dumps(body)
        landed = spark.createDataFrame(
            [("Acme Careers", 0, 1, provider, text, base_url, site)],
            "source string, src_idx bigint, page_no bigint, provider string, body string, base_url string, site_number string",
        )
        alone = payloads.flatten(landed, provider, AS_OF).orderBy("item_no").collect()
        joint = payloads.flatten_all(landed, AS_OF).orderBy("item_no").collect()
        assert alone == joint
        return alone

    return run


def test_github_texts(flat):
    jobs = [
        {"data": {"description": "Locations: x"}},
        {"data": {"title": None, "description": "Location Locations In this role you can work from\nRemo About us",
                  "city": "Rome", "slug": "s"}},
        {"data": {"description": "Overview  " + "é" * 400}},
        {"data": {"description": "A Locations Ohio Overview Text\nmore Requirements: x. Overview"}},
        {},
    ]
    rows = flat("github", {"jobs": jobs})
    assert [r.location for r in rows] == ["Not specified", "Rome", "Not specified", "Ohio", "Not specified"]
    assert rows[1].title == "Unknown" and rows[1].url.endswith("/jobs/s")
    assert rows[2].description == "é" * 298
    assert rows[3].description == "Text\nmore"
    assert rows[4].date_posted is None and rows[4].job_type == "Full-time"


def test_amazon_filter_and_dates(flat):
    usa = {"country_code": "USA", "title": "t"}
    rows = flat("amazon", {"jobs": [
        {"title": "no country"}, {**usa, "posted_date": "February 13, 2026", "job_schedule_type": "FULL-TIME"},
        {**usa, "posted_date": "Feb 30, 2026", "city": "Austin"}, {**usa, "country_code": "CAN"},
    ]})
    assert [(r.date_posted, r.job_type, r.location, r.item_no) for r in rows] == [
        ("2026-02-13T00:00:00+0000", "Full-time", "Not specified", 1), ("", "Full-time", "Austin", 2)
    ]


def test_greenhouse_keeps_wall_clock_and_age_limit(flat):
    def date(updated):
        return flat("greenhouse", {"jobs": [{"updated_at": updated}]})[0].date_posted

    assert date("2026-03-01T09:00:00-04:00") == "2026-03-01T09:00:00+0000"
    assert date("2026-03-01T09:00Z") == "2026-03-01T09:00:00+0000"
    assert date("2026-01-08T12:00:01Z") == "2026-01-08T12:00:01+0000"  # 60 d 23:59:59 old
    assert date("2026-01-08T12:00:00Z") == ""  # 61 days old
    assert date("2026-03-01T09:00:00") == ""


def test_lever_needs_a_list(flat):
    assert flat("lever", {"text": "a lone object"}) == []
    rows = flat("lever", [{"text": "T", "createdAt": 1700000000999, "categories": {"commitment": ""}}])
    assert (rows[0].date_posted, rows[0].job_type, rows[0].description) == (
        "2023-11-14T22:13:20+0000", "Full-time", "T"
    )


def test_oracle_reads_the_first_item(flat):
    body = {"items": [{"requisitionList": [
        {"Id": 5, "PrimaryLocationCountry": "US", "PostedDate": "2026-02-24"},
        {"Id": "6", "PrimaryLocationCountry": "DE"}, {"Id": "7"},
    ]}, {"requisitionList": [{"Id": "8"}]}]}
    rows = flat("oracle_hcm", body)
    assert [r.url.rsplit("/", 1)[1] for r in rows] == ["5", "7"]
    assert rows[0].date_posted == "2026-02-24T00:00:00+0000"
    assert flat("oracle_hcm", body, base_url=None)[0].url == ""


def test_apple_dates_and_root(flat):
    jobs = [{"postingDate": "Jan 27, 2026", "id": "1"}, {"postingDate": "in spring"}]
    for body in ({"res": {"searchResults": jobs}}, {"searchResults": jobs}):
        rows = flat("apple", body)
        assert [r.date_posted for r in rows] == ["2026-01-27T00:00:00+0000", "in spring"]
    assert flat("apple", {"res": {}, "searchResults": jobs}) == []


def test_broken_bodies_give_no_rows(flat):
    for provider in payloads.SHAPES:
        assert flat(provider, "not json") == []
        assert flat(provider, "{}") == []


def test_whole_run(spark):
    entries = spark.createDataFrame(
        [
            (0, "GitHub Careers", "u", "api", "https://www.github.careers/api/jobs", None, None, None, None),
            (1, "Yelp Careers", "u", "api", "https://api.lever.co/v0/postings/yelp", None, None, None, None),
            (2, "Later Careers", "u", "api", "https://api.lever.co/v0/postings/x", None, None, None, None),
            (3, "Lost", "", "api", "", None, None, None, None),
            (4, "ServiceNow Careers", "u", "api", "https://careers.servicenow.com/jobs/", None, None, None, None),
        ],
        CATALOG_ENTRY,
    )
    page = json.dumps({"totalCount": 9, "jobs": [{"data": {"title": "Dev", "city": "Austin", "state": "TX"}}] * 2})
    landed = spark.createDataFrame(
        [
            ("GitHub Careers", 1, True, "", page, None),
            ("GitHub Careers", 2, True, "", page, None),
            ("Yelp Careers", 1, False, "API returned HTTP 503", None, None),
        ],
        RAW_PAYLOAD,
    )
    html = """<p class="count">1 to 1 of 1</p><div class="job-listing"><p><i><a href="/jobs/7">Pilot</a></i></p></div>"""
    listings = spark.createDataFrame([("ServiceNow Careers", 1, "u", True, 200, "", html)], HTML_PAGE)
    extracted = spark.createDataFrame(
        [("Cook", "Later Careers", 0, 0), ("Never", "GitHub Careers", 0, 0)],
        "title string, source string, batch_id bigint, item_no bigint",
    )
    sources = catalog.build_sources(entries)
    full = run_payloads(landed, sources, AS_OF, listings=listings, extracted=extracted)
    assert sorted((r.title, r.src_idx) for r in full.final.collect()) == [("Cook", 2), ("Dev", 0), ("Pilot", 4)]
    # A listing landed under another name than the one its rows carry.
    renamed = sources.withColumn("name", F.when(F.col("src_idx") == 4, "SN").otherwise(F.col("name")))
    other = run_payloads(landed, renamed, AS_OF, listings=listings.withColumn("source", F.lit("SN")))
    assert [(r.title, r.source) for r in other.postings.filter("src_idx = 4").collect()] == [
        ("Pilot", "ServiceNow Careers")
    ]
    assert [(r.name, r.state, r.jobs) for r in other.status.filter("name = 'SN'").collect()] == [("SN", "done", 1)]
    run = run_payloads(landed, sources, AS_OF)
    assert run.postings.count() == 4
    assert [(r.title, r.company) for r in run.final.collect()] == [("Dev", "GitHub")]
    assert [(r.name, r.state, r.jobs, r.error) for r in run.status.collect()] == [
        ("GitHub Careers", "done", 4, ""),
        ("Later Careers", "waiting", 0, ""),
        ("Lost", "error", 0, "Lost"),
        ("ServiceNow Careers", "waiting", 0, ""),
        ("Yelp Careers", "error", 0, "API returned HTTP 503"),
    ]
