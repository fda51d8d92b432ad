"""Input tables for the registered queries, derived from the given tables.

Each view is one SQL text that Spark and DuckDB both read (but for how an array
is indexed), so that both sides of a check start from the same rows.  Only inputs are shared: what an operator
does is written twice, as DataFrame code and as independent SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from hirelake.session import apply_settings

# Clock of the checks over lineitem and over events.
AS_OF = "2001-11-04 00:00:00"
WIDE_AGE = 365

_DAY = "cast(cast(l_shipdate AS date) AS string)"
_CLOCK = (
    "concat('T', lpad(cast(l_partkey % 24 AS string), 2, '0'), ':', "
    "lpad(cast(l_suppkey % 60 AS string), 2, '0'), ':00')"
)

_POSTINGS = f"""
SELECT
  CASE WHEN l_orderkey % 97 = 0 THEN ''
       WHEN l_linenumber % 5 = 0 THEN concat('  ', p_name, chr(9), ' ')
       WHEN l_linenumber % 3 = 0 THEN upper(p_name)
       ELSE p_name END AS title,
  CASE WHEN l_suppkey % 7 = 0 THEN concat(s_name, ' & Sons') ELSE s_name END AS company,
  @places[l_orderkey % 16] AS location,
  concat('https://jobs.example.com/', cast(l_partkey AS string), '-',
         cast(l_suppkey AS string), '-', {_DAY}, '-',
         cast(cast(round(l_extendedprice * 100) AS bigint) AS string), '-',
         cast(cast(round(l_quantity) AS bigint) AS string), '-',
         cast(cast(round(l_discount * 100) AS bigint) AS string), '-',
         cast(cast(round(l_tax * 100) AS bigint) AS string), '-',
         l_returnflag, l_linestatus) AS url,
  concat(p_type, ' work at ', s_name, '. ', repeat(concat(p_name, ' & more. '), p_size % 20))
    AS description,
  CASE WHEN l_partkey % 8 = 4 THEN '' WHEN l_partkey % 8 = 5 THEN 'garbage'
       WHEN l_partkey % 8 = 7 THEN NULL
       ELSE concat({_DAY}, CASE WHEN l_partkey % 8 = 3 THEN '' ELSE {_CLOCK} END,
                   @zones[l_partkey % 8]) END AS date_posted,
  concat('src', cast(s_nationkey AS string)) AS source,
  CASE p_size % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time'
       WHEN 2 THEN '' ELSE 'Contract' END AS job_type,
  cast(s_nationkey AS bigint) AS src_idx,
  cast(l_orderkey AS bigint) AS page_no,
  cast(l_linenumber AS bigint) AS item_no,
  l_shipdate AS fetched_at
FROM lineitem
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
"""

_PLACES = [
    "Austin, TX", "Remote", "", "London, United Kingdom", "Milwaukee, Wisconsin",
    "Remote - Australia", "Toronto, CA", "Bengaluru, India", "Indianapolis, Indiana",
    "Dublin, OH", "Dublin, Ohio", "Not specified", "Berlin, DE", "Seattle, WA, United States",
    "Santa Fe, New Mexico", None,
]
_ZONES = ["+0000", "Z", "-05:00", "", "", "", "", ""]


def _postings(opening: str, closing: str, first: int, index: str) -> str:
    """The view with its two lookups written for one engine's arrays."""
    text = _POSTINGS
    for name, values in [("places", _PLACES), ("zones", _ZONES)]:
        array = ", ".join("NULL" if value is None else f"'{value}'" for value in values)
        text = re.sub(
            rf"@{name}\[(.*?)\]",
            rf"{opening}{array}{closing}[cast(\1 AS {index}) + {first}]",
            text,
        )
    return text


SPARK_POSTINGS = _postings("array(", ")", 0, "int")
POSTINGS = _postings("[", "]", 1, "bigint")

# Orders as landed pages: 60 pages a source, so sources grow with the table.
FETCH_PAGES = """
SELECT source, src_no, provider, page_no,
       CASE WHEN page_no = 1 THEN greatest(n, 1) ELSE n END AS n_jobs,
       CASE src_no % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 150
                       WHEN 3 THEN 40 ELSE 900 END AS total,
       (src_no * 7 + page_no) % 37 <> 0 AS success,
       CASE WHEN (src_no * 7 + page_no) % 37 <> 0 THEN ''
            ELSE concat('API returned HTTP 50', cast(page_no % 4 AS string)) END AS error
FROM (
  SELECT concat('source ', cast(src_no AS string)) AS source, src_no,
         CASE src_no % 12
              WHEN 0 THEN 'amazon' WHEN 1 THEN 'eightfold' WHEN 2 THEN 'workday'
              WHEN 3 THEN 'lever' WHEN 4 THEN 'greenhouse' WHEN 5 THEN 'oracle_hcm'
              WHEN 6 THEN 'phenom' WHEN 7 THEN 'goldman_sachs' WHEN 8 THEN 'epam'
              WHEN 9 THEN 'apple' WHEN 10 THEN 'servicenow' ELSE 'github' END AS provider,
         page_no,
         CASE WHEN src_no % 12 = 3 THEN 20 * count(*)
              WHEN src_no % 12 IN (7, 9, 10) THEN 5 * count(*)
              ELSE count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) END AS n
  FROM (
    SELECT cast(floor(o_orderkey / 300.0) AS bigint) AS src_no,
           cast(floor(o_orderkey / 5.0) AS bigint) % 60 + 1 AS page_no,
           o_orderstatus
    FROM orders) AS o
  GROUP BY src_no, page_no) AS p
"""

# Customers as catalog entries with gaps.
CATALOG = """
SELECT c_custkey AS input_pos,
  CASE WHEN c_custkey % 19 = 0 THEN NULL
       WHEN c_custkey % 3 = 0 THEN concat(c_name, ' Careers')
       WHEN c_custkey % 3 = 1 THEN concat(c_name, ' Jobs') ELSE c_name END AS name,
  CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN ''
       ELSE concat('https://careers.example.com/', cast(c_custkey AS string)) END AS url,
  CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'browser'
       WHEN c_custkey % 13 = 0 THEN 'html' ELSE 'api' END AS type,
  CASE c_custkey % 14
       WHEN 0 THEN 'https://www.amazon.jobs/en/search.json'
       WHEN 1 THEN 'https://Jobs.example.com:8443/api/pcsx/search?x=1'
       WHEN 2 THEN 'https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/External/jobs'
       WHEN 3 THEN 'https://api.lever.co/v0/postings/acme'
       WHEN 4 THEN 'https://boards-api.greenhouse.io/v1/boards/acme/jobs'
       WHEN 5 THEN 'https://acme.fa.oraclecloud.com/hcmRestApi/resources/latest/req'
       WHEN 6 THEN 'https://careers.example.com/widgets'
       WHEN 7 THEN 'https://api-higher.gs.com/gateway/api/v1/graphql'
       WHEN 8 THEN 'https://careers.epam.com/api/jobs/v2/search'
       WHEN 9 THEN 'https://jobs.apple.com/api/v1/search'
       WHEN 10 THEN 'https://careers.servicenow.com/jobs/'
       WHEN 11 THEN 'https://www.example.org/api/jobs'
       WHEN 12 THEN '' ELSE NULL END AS api_url,
  c_mktsegment AS keywords,
  CASE WHEN c_custkey % 2 = 0 THEN 'example.com' END AS domain,
  CASE WHEN c_custkey % 4 = 0 THEN 'Canada' END AS country,
  CASE WHEN c_custkey % 3 = 0 THEN 'CX_7' END AS site_number
FROM customer
"""

# Events as repeated finds of the same postings, one cycle a day.
CYCLES = """
SELECT concat(cast(user_id AS string), '|', event_type) AS dedup_key,
       cast(ts AS date) AS cycle
FROM events
"""

_K = "p_partkey"
_MONTH = f"({_K} % 12 + 1)"
_DAY_OF = f"({_K} % 28 + 1)"
_NAMES = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
]
_MONTH_NAME = (
    f"CASE {_K} % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
)

# Parts as the facts behind a payload; 20 parts are one page.
PARTS = f"""
SELECT {_K} AS k,
  cast(floor({_K} / 20.0) AS bigint) % 50 + 1 AS page_no,
  cast(floor({_K} / 1000.0) AS bigint) AS src_idx,
  concat('Site ', cast(cast(floor({_K} / 1000.0) AS bigint) AS string), ' Careers') AS source,
  CASE WHEN {_K} % 11 = 0 THEN NULL ELSE p_name END AS title,
  CASE WHEN {_K} % 4 = 0 THEN '' WHEN {_K} % 9 = 0 THEN NULL
       ELSE concat('City ', cast(p_size AS string)) END AS city,
  CASE WHEN {_K} % 5 = 0 THEN '' WHEN {_K} % 8 = 0 THEN NULL ELSE 'TX' END AS state,
  CASE {_K} % 7 WHEN 0 THEN 'CAN' WHEN 1 THEN NULL ELSE 'USA' END AS country3,
  CASE {_K} % 6 WHEN 0 THEN 'CA' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'US' END AS country2,
  CASE WHEN {_K} % 13 = 0 THEN '' WHEN {_K} % 15 = 0 THEN NULL
       ELSE concat('p-', cast({_K} AS string)) END AS slug,
  CASE {_K} % 5
       WHEN 0 THEN NULL
       WHEN 1 THEN concat(p_type, ' Remote ', repeat(concat(p_name, ' '), 40))
       WHEN 2 THEN concat('Locations In this role you can work from ', p_brand,
                          ' Overview We make ', p_name, ' things. Qualifications: ', p_type)
       WHEN 3 THEN concat('Overview ', repeat(concat(p_name, ', '), 60))
       ELSE concat('<p>', p_name, ' <b>', p_brand, '</b></p> ', repeat(p_type, 80)) END AS text,
  CASE WHEN {_K} % 6 = 0 THEN '' WHEN {_K} % 10 = 0 THEN NULL ELSE p_type END AS department,
  CASE WHEN {_K} % 7 = 0 THEN NULL WHEN {_K} % 7 = 1 THEN '' ELSE p_brand END AS label,
  CASE {_K} % 4 WHEN 0 THEN 'FULL-TIME' WHEN 1 THEN NULL WHEN 2 THEN ''
       ELSE 'part time' END AS kind,
  cast({_MONTH} AS bigint) AS month_no, cast({_DAY_OF} AS bigint) AS day_no,
  CASE WHEN {_K} % 17 = 0 THEN 0 WHEN {_K} % 19 = 0 THEN NULL
       ELSE 1600000000 + {_K} * 3607 END AS epoch,
  CASE WHEN {_K} % 17 = 0 THEN 'soon' WHEN {_K} % 19 = 0 THEN NULL
       ELSE concat({_MONTH_NAME}, ' ', cast({_DAY_OF} AS string), ', 2024') END AS long_date,
  CASE WHEN {_K} % 17 = 0 THEN 'soon' WHEN {_K} % 19 = 0 THEN NULL
       ELSE concat(left({_MONTH_NAME}, 3), ' ', cast({_DAY_OF} AS string), ', 2024') END AS short_date,
  CASE WHEN {_K} % 17 = 0 THEN 'soon' WHEN {_K} % 19 = 0 THEN NULL
       ELSE concat('2024-', lpad(cast({_MONTH} AS string), 2, '0'), '-',
                   lpad(cast({_DAY_OF} AS string), 2, '0')) END AS iso_day,
  CASE {_K} % 5 WHEN 0 THEN '-04:00' WHEN 1 THEN 'Z' WHEN 2 THEN '+0530' WHEN 3 THEN ''
       ELSE '+00:00' END AS zone,
  cast({_K} % 24 AS bigint) AS hour_no, cast({_K} % 60 AS bigint) AS minute_no,
  p_name AS name, p_brand AS brand, p_size AS size
FROM part
"""

class Inputs:
    """The given tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = apply_settings(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, text: str, *tables: str) -> DataFrame:
        for name in tables:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def postings(self) -> DataFrame:
        return self.view(SPARK_POSTINGS, "lineitem", "part", "supplier")

    def fetch_pages(self) -> DataFrame:
        return self.view(FETCH_PAGES, "orders")

    def catalog(self) -> DataFrame:
        return self.view(CATALOG, "customer")

    def cycles(self) -> DataFrame:
        return self.view(CYCLES, "events")

    def parts(self) -> DataFrame:
        return self.view(PARTS, "part")
