"""Registered queries: catalog, routing, page cut-off, sinks and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions.text import company_from_source
from hirelake.operators import novelty, paging
from hirelake.plans.checks_cleaning import FIELDS, final_postings, sql_final
from hirelake.plans.views import CATALOG, CYCLES, FETCH_PAGES, Inputs
from hirelake.schema import POSTING_FIELDS
from hirelake.session import scratch_dir
from hirelake.sources import catalog, sinks

_OPTIONAL = "api_url, keywords, domain, country, site_number"

SQL_ENTRIES = f"""
entries AS (
  SELECT input_pos, name, url, coalesce(type, 'career_page') AS type, {_OPTIONAL}
  FROM ({CATALOG}) AS c WHERE url IS NOT NULL AND name IS NOT NULL)"""

SQL_PLAN = f"""{SQL_ENTRIES},
planned AS (
  SELECT row_number() OVER (ORDER BY input_pos) - 1 AS src_idx, name, url, type, {_OPTIONAL},
    'pending' AS status FROM entries)"""

SQL_ROUTED = f"""{SQL_PLAN},
routed AS (
  SELECT *,
    CASE WHEN url = '' AND coalesce(api_url, '') = '' THEN NULL
         WHEN type = 'api' AND coalesce(api_url, '') <> '' THEN
           CASE WHEN api_url LIKE '%amazon.jobs%' THEN 'amazon'
                WHEN api_url LIKE '%pcsx/search%' THEN 'eightfold'
                WHEN api_url LIKE '%myworkdayjobs.com%' THEN 'workday'
                WHEN api_url LIKE '%api.lever.co%' THEN 'lever'
                WHEN api_url LIKE '%boards-api.greenhouse.io%' THEN 'greenhouse'
                WHEN api_url LIKE '%oraclecloud.com%' THEN 'oracle_hcm'
                WHEN api_url LIKE '%/widgets%' THEN 'phenom'
                WHEN api_url LIKE '%api-higher.gs.com%' THEN 'goldman_sachs'
                WHEN api_url LIKE '%careers.epam.com%' THEN 'epam'
                WHEN api_url LIKE '%jobs.apple.com%' THEN 'apple'
                WHEN api_url LIKE '%careers.servicenow.com%' THEN 'servicenow'
                ELSE 'github' END
         WHEN type = 'browser' THEN 'browser' ELSE 'html' END AS provider,
    CASE WHEN url = '' AND coalesce(api_url, '') = ''
         THEN 'No URL found for page: ' || name END AS error
  FROM planned)"""

# The cut-off again, page by page: walk each source's pages until one ends it.
SQL_LIMITS = f"""
fetched AS ({FETCH_PAGES}),
rules(provider, needs_total, cap, cap_limit, step, min_rows) AS (VALUES
  ('amazon', 'always', 'offset', 500, 10, 1), ('eightfold', 'known', 'before', 500, 1, 1),
  ('workday', 'always', 'offset', 500, 20, 1), ('lever', 'never', 'offset', 500, 100, 100),
  ('greenhouse', 'never', 'page', 10, 1, 1), ('oracle_hcm', 'always', 'offset', 500, 25, 1),
  ('phenom', 'always', 'offset', 500, 20, 1), ('goldman_sachs', 'known', 'rows', 500, 1, 1),
  ('epam', 'known', 'offset', 500, 20, 1), ('apple', 'known', 'rows', 500, 1, 1),
  ('servicenow', 'known', 'rows', 500, 1, 1), ('github', 'always', 'page', 10, 1, 1)),
summed AS (
  SELECT f.*, r.*, sum(n_jobs) OVER (PARTITION BY source ORDER BY page_no) AS n
  FROM fetched AS f JOIN rules AS r ON f.provider = r.provider),
marked AS (
  SELECT *, (NOT success) OR n_jobs < min_rows
    OR (needs_total = 'always' AND n >= coalesce(total, 0))
    OR (needs_total = 'known' AND coalesce(total, 0) > 0 AND n >= total)
    OR CASE cap WHEN 'offset' THEN (page_no - 1) * step WHEN 'page' THEN page_no
                WHEN 'rows' THEN n ELSE n - n_jobs END >= cap_limit AS ends
  FROM summed),
kept AS (
  SELECT * FROM (
    SELECT *, coalesce(sum(ends::int) OVER (PARTITION BY source ORDER BY page_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended_before FROM marked) AS m
  WHERE ended_before = 0)"""


def routed(inputs: Inputs):
    return catalog.route(catalog.plan(catalog.source_catalog(inputs.catalog())))


def limits(inputs: Inputs):
    return paging.page_limits(inputs.fetch_pages())


def round_trip(inputs: Inputs, write, read):
    """Final postings written and read back through a new scratch folder."""
    path = write(final_postings(inputs), scratch_dir(inputs.spark, "sink"))
    return read(inputs.spark, path)


def run_history(inputs: Inputs):
    """A history row per day of events, each day a run over that day's finds."""
    cycles = inputs.cycles().withColumn("run_id", F.dayofyear("cycle"))
    firsts = novelty.first_cycles(cycles).groupBy("cycle").agg(F.count(F.lit(1)).alias("new_job_count"))
    errors = (
        inputs.table("events")
        .filter("event_type = 'error'")
        .groupBy(F.to_date("ts").alias("cycle"))
        .agg(F.count(F.lit(1)).alias("error_count"), F.max("props").alias("last_error"))
    )
    runs = cycles.groupBy("run_id", "cycle").agg(F.count_distinct("dedup_key").alias("job_count"))
    path = scratch_dir(inputs.spark, "runs")
    sinks.append_run(
        runs.join(firsts, "cycle", "left").join(errors, "cycle", "left").select(
            F.col("run_id").cast("bigint").alias("run_id"),
            F.col("cycle").cast("timestamp").alias("finished_at"),
            "job_count",
            F.coalesce("new_job_count", F.lit(0)).alias("new_job_count"),
            F.coalesce("error_count", F.lit(0)).alias("error_count"),
            "last_error",
        ),
        path,
    )
    history = sinks.read_runs(inputs.spark, path)
    return history.withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd"))


QUERIES = {
    "source_catalog": (
        lambda i: catalog.source_catalog(i.catalog()),
        f"WITH {SQL_ENTRIES} SELECT * FROM entries",
    ),
    "plan": (
        lambda i: catalog.plan(catalog.source_catalog(i.catalog())),
        f"WITH {SQL_PLAN} SELECT * FROM planned",
    ),
    "plan_defaults": (
        lambda i: catalog.plan(i.catalog()).select("src_idx", "name", "url", "type", "status"),
        f"""SELECT row_number() OVER (ORDER BY input_pos) - 1 AS src_idx,
          coalesce(name, 'Page ' || row_number() OVER (ORDER BY input_pos)) AS name,
          coalesce(url, '') AS url, coalesce(type, 'career_page') AS type, 'pending' AS status
        FROM ({CATALOG}) AS c""",
    ),
    "route_sources": (
        lambda i: routed(i).select("src_idx", "name", "provider", "error"),
        f"WITH {SQL_ROUTED} SELECT src_idx, name, provider, error FROM routed",
    ),
    "plan_kind_counts": (
        lambda i: catalog.kind_counts(catalog.plan(catalog.source_catalog(i.catalog()))),
        f"""WITH {SQL_PLAN} SELECT CASE type WHEN 'api' THEN 'api' WHEN 'browser' THEN 'browser'
        ELSE 'html' END AS kind, count(*) AS sources FROM planned GROUP BY 1""",
    ),
    "base_urls": (
        lambda i: catalog.build_sources(i.catalog()).select(
            "src_idx", "provider", "base_url", "domain", "country", "site_number"
        ),
        f"""WITH {SQL_ROUTED},
        parts AS (SELECT *, 'https://' || lower(regexp_extract(api_url, '://([^/:?#]+)', 1)) AS origin
          FROM routed)
        SELECT src_idx, provider,
          CASE WHEN provider IN ('eightfold', 'oracle_hcm', 'phenom') THEN origin
               WHEN provider = 'workday' THEN regexp_extract(api_url, '^(.*)/wday/', 1) || '/'
                 || regexp_extract(api_url, '/wday/cxs/[^/]*/(.*?)/jobs', 1) END AS base_url,
          CASE WHEN provider = 'eightfold' AND coalesce(domain, '') = '' THEN origin[9:]
               ELSE domain END AS domain,
          CASE WHEN provider = 'phenom' AND country IS NULL THEN 'United States of America'
               ELSE country END AS country,
          CASE WHEN provider = 'oracle_hcm' AND site_number IS NULL THEN 'CX_1001'
               ELSE site_number END AS site_number
        FROM parts""",
    ),
    "company_from_source": (
        lambda i: i.catalog()
        .filter("name IS NOT NULL")
        .select("name", company_from_source(F.col("name")).alias("company")),
        f"""SELECT name, regexp_replace(name, ' (Careers|Jobs)', '', 'g') AS company
        FROM ({CATALOG}) AS c WHERE name IS NOT NULL""",
    ),
    "page_cutoff": (
        lambda i: paging.cut_pages(i.fetch_pages(), limits(i)).select(
            "source", "provider", "page_no", "n_jobs"
        ),
        f"WITH {SQL_LIMITS} SELECT source, provider, page_no, n_jobs FROM kept",
    ),
    "failed_sources": (
        lambda i: paging.failed_sources(limits(i)),
        f"""WITH {SQL_LIMITS} SELECT source,
          CASE provider WHEN 'servicenow' THEN 'Fetch failed for ' ELSE 'API fetch failed for ' END
            || source || ': ' || error AS error
        FROM kept WHERE NOT success""",
    ),
    "drop_failed": (
        lambda i: paging.drop_failed(i.fetch_pages(), limits(i)).select(
            "source", "provider", "page_no", "n_jobs"
        ),
        f"""WITH {SQL_LIMITS} SELECT source, provider, page_no, n_jobs FROM kept
        WHERE source NOT IN (SELECT source FROM kept WHERE NOT success)""",
    ),
    "sink_json": (
        lambda i: round_trip(i, sinks.write_json, sinks.read_json),
        f"WITH {sql_final()} SELECT {FIELDS} FROM final",
    ),
    "sink_json_array": (
        lambda i: round_trip(i, sinks.write_json_array, sinks.read_json_array),
        f"WITH {sql_final()} SELECT {FIELDS} FROM final",
    ),
    "sink_csv": (
        # CSV keeps no difference between a missing and an empty text.
        lambda i: round_trip(i, sinks.write_csv, sinks.read_csv),
        "WITH "
        + sql_final()
        + " SELECT "
        + ", ".join(f"coalesce({name}, '') AS {name}" for name in POSTING_FIELDS)
        + " FROM final",
    ),
    "run_history": (
        run_history,
        f"""WITH cycles AS ({CYCLES}),
        firsts AS (SELECT dedup_key, min(cycle) AS cycle FROM cycles GROUP BY 1),
        new AS (SELECT cycle, count(*) AS n FROM firsts GROUP BY 1),
        failed AS (SELECT CAST(ts AS date) AS cycle, count(*) AS n,
                     max(props) AS last_error
                   FROM events WHERE event_type = 'error' GROUP BY 1)
        SELECT CAST(dayofyear(c.cycle) AS bigint) AS run_id, c.cycle::varchar AS finished_at,
          count(DISTINCT dedup_key) AS job_count, coalesce(any_value(new.n), 0) AS new_job_count,
          coalesce(any_value(failed.n), 0) AS error_count, any_value(failed.last_error) AS last_error
        FROM cycles AS c LEFT JOIN new ON c.cycle = new.cycle
        LEFT JOIN failed ON c.cycle = failed.cycle GROUP BY c.cycle""",
    ),
}
