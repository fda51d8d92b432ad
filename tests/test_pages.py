from hirelake.operators import pages

HTML = """<html><head><title>Head</title></head><body>
<header>Top</header><div class="wrap"><div id="Job-CONTENT"><p>One  two<script>x()</script>
<b>bold <i>text</b> after</i><style>p{}</style><template>no</template><!-- c -->tail &amp; end
<a href="/jobs/1">First</a><a href="/jobs/1#top">Anchor</a><a href="/jobs/1">Again</a>
<a href="mailto:job@example.com">Job mail</a><a href="/about">Open ROLE</a><a>none</a>
<a href="/about">About</a><nav>menu</nav></div>outside</div><footer>foot</footer></body></html>"""


def frame(spark, *rows):
    return spark.createDataFrame(
        [(n, "https://example.com/careers/", html) for n, html in enumerate(rows)],
        "page_id int, url string, html string",
    )


def test_main_text(spark):
    rows = frame(spark, HTML, "", None, "<p>no body</p>", "<main>a</main><div role=main>b</div>", "x" * 4100)
    got = [r.text for r in pages.page_text(rows).orderBy("page_id").collect()]
    assert got[0] == "One two\nbold\ntext\nafter\ntail & end\nFirst\nAnchor\nAgain\nJob mail\nOpen ROLE\nnone\nAbout"
    assert got[1:5] == ["", "", "no body", "a"]
    assert got[5] == "x" * 4000 + "\n\n[... content truncated ...]"


def test_links_first_match_wins(spark):
    html = '<a href="/x">nothing</a><a href="/x">A role</a>' + HTML + '<a href="">careers</a>'
    got = pages.page_links(frame(spark, html)).orderBy("pos").collect()
    assert [(r.pos, r.text, r.url.removeprefix("https://example.com")) for r in got] == [
        (0, "A role", "/x"), (1, "First", "/jobs/1"), (2, "Anchor", "/jobs/1#top"),
        (3, "Open ROLE", "/about"), (4, "careers", "/careers/"),
    ]


def test_context_lists_twenty_links(spark):
    many = "".join(f'<a href="/job/{n}">J{n}</a> ' for n in range(30))
    first, full, none = (
        r.context
        for r in pages.page_context(frame(spark, many, many + "y" * 4000, "<p>t</p>")).orderBy("page_id").collect()
    )
    assert first.count("\n- J") == 20 and first.endswith("- J19: https://example.com/job/19\n")
    assert "\n- J" not in full and full.count("truncated") == 1
    assert none == "t"


def test_listing(spark):
    html = """<div class="page-count">Displaying 1 to 20 of 430 jobs</div>
    <div class="list job-listing"><div><h3><a href="/jobs/1/a/"> Dev </a></h3><ul class="job-meta"><li>Austin</li></ul></div>
    <div><h3><a href="/jobs/2/b/">Ops</a></h3></div><a href="/jobs/3">Save</a><a href="/blog">Blog</a></div>"""
    rows = spark.createDataFrame([("s", 1, True, "", html)], "source string, page_no bigint, success boolean, error string, html string")
    got = pages.listing_postings(rows).orderBy("item_no").collect()
    assert [(r.title, r.location, r.url, r.total) for r in got] == [
        ("Dev", "Austin", "https://careers.servicenow.com/jobs/1/a/", 430),
        ("Ops", "Not specified", "https://careers.servicenow.com/jobs/2/b/", 430),
    ]
    assert [(r.n_jobs, r.total) for r in pages.listing_stats(rows).collect()] == [(2, 430)]


def test_page_operators_do_not_shuffle(spark):
    for df in (pages.page_text(frame(spark, HTML)), pages.page_links(frame(spark, HTML)), pages.page_context(frame(spark, HTML))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert plan.count("ArrowEvalPython") == 1
