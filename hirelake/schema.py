"""Table schemas, as DDL so that they read the same in SQL and in Python."""

from __future__ import annotations

# The eight fields of a posting, in output order.
POSTING_FIELDS = [
    "title",
    "company",
    "location",
    "url",
    "description",
    "date_posted",
    "source",
    "job_type",
]

# Spark tables have no row order; these columns carry the input order.  The
# first three identify a posting, ``url`` only settles repeated landings.
ORDINAL = ["src_idx", "page_no", "item_no", "url"]

POSTING = (
    ", ".join(f"{name} STRING" for name in POSTING_FIELDS)
    + ", provider STRING, src_idx BIGINT, page_no BIGINT, item_no BIGINT"
)

# ``page_no`` is the number of the request within its source and cycle, from 1.
RAW_PAYLOAD = (
    "source STRING, page_no BIGINT, success BOOLEAN, error STRING, body STRING, "
    "fetched_at TIMESTAMP"
)

HTML_PAGE = (
    "source STRING, page_no BIGINT, url STRING, success BOOLEAN, status_code INT, "
    "error STRING, html STRING"
)

# Landed files may also hold these.  ``run_id`` is the fetch cycle (NULL: cycle
# 0), ``src_idx`` the source's catalog number (NULL: the first of that name).
CYCLE = "run_id BIGINT, src_idx BIGINT"
LANDED_PAYLOAD = f"{RAW_PAYLOAD}, status_code INT, {CYCLE}"
LANDED_PAGE = f"{HTML_PAGE}, {CYCLE}"

RAW_CARD = "source STRING, item_no BIGINT, title STRING, url STRING, location STRING"

# What a fetcher lands, in one table: payload and listing pages, cards, and the
# marks ``begin`` and ``end`` of a cycle (src_idx NULL: of all its sources).
# A listing's markup is its body.
ARRIVAL = f"kind STRING, {LANDED_PAYLOAD}, item_no BIGINT, title STRING, url STRING, location STRING"

# A page that a cycle brought, told by its numbers alone.
PAGE_STAT = (
    "run_id BIGINT, src_idx BIGINT, source STRING, kind STRING, provider STRING, page_no BIGINT, "
    "success BOOLEAN, error STRING, n_jobs BIGINT, total BIGINT"
)

CATALOG_ENTRY = (
    "input_pos BIGINT, name STRING, url STRING, type STRING, api_url STRING, "
    "keywords STRING, domain STRING, country STRING, site_number STRING"
)

MODEL_RESPONSE = "source STRING, batch_id BIGINT, text STRING, error STRING"

SEEN = (
    "dedup_key STRING, title STRING, company STRING, url STRING, "
    "first_seen_at TIMESTAMP, run_id BIGINT"
)

RUN_HISTORY = (
    "run_id BIGINT, finished_at TIMESTAMP, job_count BIGINT, new_job_count BIGINT, "
    "error_count BIGINT, last_error STRING"
)
