"""Registered queries: report tables over the cleaned postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators import novelty, paging, reporting
from hirelake.plans.checks_catalog import SQL_LIMITS
from hirelake.plans.checks_catalog import limits as page_limits
from hirelake.plans.checks_cleaning import (
    FIELDS,
    SPLIT,
    final_postings,
    seen_and_batch,
    sql_final,
    sql_tested,
)
from hirelake.plans.views import AS_OF, POSTINGS, WIDE_AGE, Inputs
from hirelake.schema import POSTING_FIELDS
from hirelake.session import written

# The clock of the report: inside the range of posting dates.
NOW = "2001-10-20 12:30:00"

_BLANKS = "' ' || chr(9)"
_STRIPPED = ", ".join(f"trim(coalesce({f}, ''), {_BLANKS}) AS {f}" for f in POSTING_FIELDS)
_REST = "src_idx, page_no, item_no, dedup_key"

SQL_REPORT = f"""{sql_final()},
report AS (SELECT {_STRIPPED}, {_REST} FROM final)"""

# new = first fetched after the split
SQL_FLAGGED = f"""{SQL_REPORT},
new_keys AS (SELECT dedup_key FROM tested GROUP BY dedup_key
             HAVING min(fetched_at) >= TIMESTAMP '{SPLIT} 00:00:00'),
flagged AS (SELECT report.*, dedup_key IN (SELECT dedup_key FROM new_keys) AS is_new FROM report)"""

SQL_EPOCH = """
CASE WHEN date_posted LIKE '%+0000'
       THEN epoch(try_strptime(date_posted, '%Y-%m-%dT%H:%M:%S+0000'))
     WHEN date_posted LIKE '%Z' THEN epoch(try_strptime(date_posted, '%Y-%m-%dT%H:%M:%SZ'))
     WHEN date_posted LIKE '%-05:00'
       THEN epoch(try_strptime(left(date_posted, 19), '%Y-%m-%dT%H:%M:%S')) + 18000
     WHEN length(date_posted) = 10 THEN epoch(try_strptime(date_posted, '%Y-%m-%d'))
     WHEN length(date_posted) = 19 THEN epoch(try_strptime(date_posted, '%Y-%m-%dT%H:%M:%S'))
     ELSE 0 END"""
SQL_NOW = f"epoch(TIMESTAMP '{NOW}')"
SQL_SLUG = """lower(replace(replace(replace(replace(replace(
    company, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), ' ', '-'))"""


def report(inputs: Inputs) -> DataFrame:
    return reporting.standardize(final_postings(inputs))


def flagged(inputs: Inputs) -> DataFrame:
    seen, batch = seen_and_batch(inputs)
    new_keys = novelty.fresh_seen_rows(batch, seen, AS_OF, 1)
    return reporting.flag_new(report(inputs), new_keys)


def _view(**settings):
    return lambda i: reporting.search_view(flagged(i), NOW, **settings).select(
        "title", "company", "url", "is_new"
    )


def _sql_view(where: str) -> str:
    return f"""WITH {SQL_FLAGGED}, dated AS (SELECT *, {SQL_EPOCH} AS posted_epoch FROM flagged)
    SELECT title, company, url, is_new FROM dated WHERE {where}"""


def _within(hours: int) -> str:
    return f"{SQL_NOW} - posted_epoch <= {hours} * 3600"


COMBINED = {"slug": "supplier#000000007-&amp;-sons", "hours": 24 * 300, "query": " WIDGET "}
SQL_COMBINED = (
    f"{_within(24 * 300)} AND title ILIKE '%widget%' AND company = 'Supplier#000000007 & Sons'"
)


def _counts_sql(field: str) -> str:
    return f"""WITH {SQL_REPORT}
    SELECT {field}, count(*) AS n_jobs,
      arg_min(url, (src_idx, page_no, item_no, url)) AS first_url
    FROM report GROUP BY {field}"""


def status(inputs: Inputs) -> DataFrame:
    """Fetched sources next to planned ones that were never tried."""
    limits = page_limits(inputs)
    fetched = inputs.fetch_pages()
    numbers = fetched.select("source", F.col("src_no").alias("src_idx")).distinct()
    tried = numbers.select(
        "src_idx",
        F.concat(F.when(F.col("src_idx") % 2 == 0, F.lit("Src ")).otherwise(F.lit("src ")),
                 F.col("src_idx").cast("string")).alias("name"),
        F.when(F.col("src_idx") % 3 == 0, F.lit("browser")).otherwise(F.lit("api")).alias("type"),
    )
    untried = tried.select(
        (-1 - F.col("src_idx")).alias("src_idx"),
        F.concat(F.lit("later "), F.col("src_idx").cast("string")).alias("name"),
        F.lit("career_page").alias("type"),
    )
    rows = (
        paging.drop_failed(fetched, limits)
        .filter("n_jobs > 0")
        .select(
            F.col("src_no").alias("src_idx"),
            F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_jobs"))).alias("job"),
        )
    )
    attempts = (
        limits.select("source")
        .join(paging.failed_sources(limits), "source", "left")
        .join(numbers, "source")
        .select("src_idx", "error")
    )
    return reporting.source_status(tried.unionByName(untried), rows, attempts)


SQL_STATUS = f"""{SQL_LIMITS},
failed AS (SELECT src_no, error FROM kept WHERE NOT success),
jobs AS (SELECT src_no, sum(n_jobs) AS jobs FROM kept
         WHERE src_no NOT IN (SELECT src_no FROM failed) GROUP BY src_no),
status AS (
  SELECT DISTINCT f.src_no AS src_idx,
    CASE WHEN f.src_no % 2 = 0 THEN 'Src ' ELSE 'src ' END || f.src_no AS name,
    CASE WHEN f.src_no % 3 = 0 THEN 'BRO' ELSE 'API' END AS type_label,
    CASE WHEN e.error IS NOT NULL THEN 'error' ELSE 'done' END AS state,
    CAST(coalesce(j.jobs, 0) AS bigint) AS jobs, coalesce(e.error, '') AS error
  FROM fetched AS f LEFT JOIN failed AS e ON f.src_no = e.src_no
  LEFT JOIN jobs AS j ON f.src_no = j.src_no
  UNION ALL
  SELECT DISTINCT -1 - src_no, 'later ' || src_no, 'CAR', 'waiting', 0, '' FROM fetched)"""


SPANS = [1, 24, 24 * 90]


def from_hours(inputs: Inputs, count):
    """A history in two parts, its hours counted by part and merged."""
    # Half of the rows may have one time, 0: the row's number lets a range end among them.
    rows = reporting.with_epoch(inputs.postings()).select("posted_epoch", "src_idx")
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).sort("posted_epoch", "_row")
    dated = written(rows.drop("_row"), "history")
    parts = [reporting.hourly_counts(dated.filter(test)) for test in ("src_idx % 2 = 0", "src_idx % 2 = 1")]
    return count(written(reporting.merged_hours(*parts), "hours"), dated.drop("src_idx"))


QUERIES = {
    "standardize": (
        lambda i: reporting.standardize(i.postings()).select(*POSTING_FIELDS),
        f"""WITH postings AS ({POSTINGS}) SELECT {_STRIPPED} FROM postings""",
    ),
    "by_company": (lambda i: reporting.by_company(report(i)), _counts_sql("company")),
    "by_location": (lambda i: reporting.by_location(report(i)), _counts_sql("location")),
    "summary": (
        lambda i: reporting.summary(report(i)),
        f"""WITH {SQL_REPORT}
        SELECT 'company' AS facet, company AS value, count(*) AS n_jobs FROM report GROUP BY company
        UNION ALL SELECT 'location', location, count(*) FROM report GROUP BY location
        UNION ALL SELECT 'total', CASE count(*) WHEN 0 THEN 'No jobs found.'
          ELSE 'Total jobs found' END, count(*) FROM report""",
    ),
    "posted_epoch": (
        lambda i: reporting.with_epoch(i.postings())
        .groupBy("date_posted", "posted_epoch")
        .agg(F.count(F.lit(1)).alias("n_rows")),
        f"""WITH postings AS ({POSTINGS})
        SELECT date_posted, {SQL_EPOCH}::double AS posted_epoch, count(*) AS n_rows
        FROM postings GROUP BY ALL""",
    ),
    "recency_counts": (
        lambda i: reporting.recency_counts(i.postings(), NOW),
        f"""WITH postings AS ({POSTINGS}),
        aged AS (SELECT {SQL_EPOCH} AS ts, {SQL_NOW} - {SQL_EPOCH} AS age FROM postings)
        SELECT count(*) AS all_time,
          count(*) FILTER (ts <> 0 AND age < 3600) AS within_1h,
          count(*) FILTER (ts <> 0 AND age < 10800) AS within_3h,
          count(*) FILTER (ts <> 0 AND age < 21600) AS within_6h,
          count(*) FILTER (ts <> 0 AND age < 86400) AS within_24h,
          count(*) FILTER (ts <> 0 AND age < 172800) AS within_48h,
          count(*) FILTER (ts = 0) AS undated FROM aged""",
    ),
    "recency_from_hours": (
        lambda i: from_hours(i, lambda hours, dated: reporting.recency_from_hours(hours, dated, NOW)),
        f"""WITH postings AS ({POSTINGS}),
        aged AS (SELECT {SQL_EPOCH} AS ts, {SQL_NOW} - {SQL_EPOCH} AS age FROM postings)
        SELECT count(*) AS all_time,
          count(*) FILTER (ts <> 0 AND age < 3600) AS within_1h,
          count(*) FILTER (ts <> 0 AND age < 10800) AS within_3h,
          count(*) FILTER (ts <> 0 AND age < 21600) AS within_6h,
          count(*) FILTER (ts <> 0 AND age < 86400) AS within_24h,
          count(*) FILTER (ts <> 0 AND age < 172800) AS within_48h,
          count(*) FILTER (ts = 0) AS undated FROM aged""",
    ),
    "time_filter_counts": (
        lambda i: from_hours(i, lambda hours, dated: reporting.time_filter_counts(hours, dated, NOW, SPANS)),
        f"""WITH postings AS ({POSTINGS}),
        dated AS (SELECT {SQL_EPOCH} AS posted_epoch FROM postings)
        SELECT count(*) AS all_time,
          {", ".join(f"count(*) FILTER ({_within(span)}) AS last_{span}h" for span in SPANS)},
          count(*) FILTER (posted_epoch = 0) AS undated FROM dated""",
    ),
    "company_facet": (
        lambda i: reporting.company_facet(report(i)),
        f"""WITH {SQL_REPORT} SELECT company, count(*) AS n_jobs, {SQL_SLUG} AS slug
        FROM report GROUP BY company""",
    ),
    "new_flag": (
        lambda i: flagged(i).select("dedup_key", "url", "is_new"),
        f"WITH {SQL_FLAGGED} SELECT dedup_key, url, is_new FROM flagged",
    ),
    "title_search": (_view(query="  RING"), _sql_view("title ILIKE '%ring%'")),
    "time_filter": (_view(hours=24 * 90), _sql_view(_within(24 * 90))),
    "company_filter": (
        _view(slug="supplier#000000007-&amp;-sons"),
        _sql_view(f"{SQL_SLUG} = 'supplier#000000007-&amp;-sons'"),
    ),
    "new_only": (_view(only_new=True, hours=1, query="none"), _sql_view("is_new")),
    "search_view": (_view(**COMBINED), _sql_view(SQL_COMBINED)),
    "search_view_counts": (
        lambda i: reporting.view_counts(
            reporting.search_view(flagged(i), NOW, hours=24 * 300, query="ring")
        ),
        f"""WITH {SQL_FLAGGED}, dated AS (SELECT *, {SQL_EPOCH} AS posted_epoch FROM flagged),
        shown AS (SELECT * FROM dated WHERE {_within(24 * 300)} AND title ILIKE '%ring%')
        SELECT company, count(*) AS visible_jobs, 1 AS visible_companies FROM shown GROUP BY company
        UNION ALL SELECT 'All Companies', count(*), count(DISTINCT company) FROM shown""",
    ),
    "headline": (
        lambda i: reporting.headline(flagged(i)),
        f"""WITH {SQL_FLAGGED}, n AS (SELECT count(*) AS total_jobs,
          count(DISTINCT company) AS companies, count(*) FILTER (is_new) AS new_jobs FROM flagged)
        SELECT *, CASE new_jobs WHEN 1 THEN '1 new job' ELSE new_jobs || ' new jobs' END AS label
        FROM n""",
    ),
    "source_status": (status, f"WITH {SQL_STATUS} SELECT * FROM status"),
    "error_rollup": (
        lambda i: reporting.error_rollup(status(i)),
        f"""WITH {SQL_STATUS} SELECT count(*) FILTER (state = 'error') > 0 AS has_errors,
        count(*) FILTER (state = 'error') AS error_sources FROM status""",
    ),
    "digest": (
        lambda i: reporting.digest(report(i)),
        f"WITH {SQL_REPORT} SELECT company, title, location, url, source FROM report",
    ),
    "digest_lead": (
        lambda i: reporting.digest_lead(report(i)),
        f"""WITH {SQL_REPORT} SELECT count(*) AS n_jobs,
        count(*) || ' new job posting(s)' AS subject FROM report""",
    ),
    "preview": (
        lambda i: reporting.preview(report(i)),
        f"""WITH {SQL_REPORT} SELECT title, company, location, url,
          greatest((SELECT count(*) FROM report) - 10, 0) AS more
        FROM report ORDER BY src_idx, page_no, item_no, url LIMIT 10""",
    ),
    "short_desc": (
        lambda i: reporting.with_short_description(i.postings()).select("url", "short_description"),
        f"""WITH postings AS ({POSTINGS}),
        escaped AS (SELECT url, replace(description, '&', '&amp;') AS d FROM postings)
        SELECT url, CASE WHEN length(d) > 160 THEN left(d, 160) || '...' ELSE d END
          AS short_description FROM escaped""",
    ),
    "date_display": (
        lambda i: reporting.with_date_display(i.postings(), "UTC")
        .groupBy("date_posted", "date_display")
        .agg(F.count(F.lit(1)).alias("n_rows")),
        f"""WITH postings AS ({POSTINGS})
        SELECT date_posted, CASE WHEN coalesce(date_posted, '') = '' THEN 'Date unknown'
            WHEN {SQL_EPOCH} = 0 THEN date_posted
            ELSE strftime(make_timestamp(({SQL_EPOCH} * 1000000)::bigint), '%b %d, %I:%M %p') END
            AS date_display, count(*) AS n_rows
        FROM postings GROUP BY ALL""",
    ),
}
