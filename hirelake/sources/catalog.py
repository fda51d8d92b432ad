"""The catalog of career sites, its plan and its routing.

The catalog is configuration, yet nothing here gathers it: every step is a
column expression, and the plan index is a distributed position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.position import running_position
from hirelake.functions.text import company_from_source, filled
from hirelake.schema import CATALOG_ENTRY

# Part of the API address -> payload shape, first match wins.
ADDRESS_TO_PROVIDER = [
    ("amazon.jobs", "amazon"),
    ("pcsx/search", "eightfold"),
    ("myworkdayjobs.com", "workday"),
    ("api.lever.co", "lever"),
    ("boards-api.greenhouse.io", "greenhouse"),
    ("oraclecloud.com", "oracle_hcm"),
    ("/widgets", "phenom"),
    ("api-higher.gs.com", "goldman_sachs"),
    ("careers.epam.com", "epam"),
    ("jobs.apple.com", "apple"),
    ("careers.servicenow.com", "servicenow"),
]
FALLBACK_PROVIDER = "github"

DEFAULT_TYPE = "career_page"
DEFAULT_SITE_NUMBER = "CX_1001"
DEFAULT_COUNTRY = "United States of America"

ENTRY_COLUMNS = ["url", "type", "api_url", "keywords", "domain", "country", "site_number"]


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog entries from JSON lines; unknown keys are dropped by the schema."""
    return source_catalog(spark.read.schema(CATALOG_ENTRY).json(path))


def source_catalog(entries: DataFrame) -> DataFrame:
    """Entries that have both a name and an address, type defaulted."""
    return entries.filter(F.col("url").isNotNull() & F.col("name").isNotNull()).select(
        "input_pos",
        "name",
        "url",
        F.coalesce("type", F.lit(DEFAULT_TYPE)).alias("type"),
        "api_url",
        "keywords",
        "domain",
        "country",
        "site_number",
    )


def plan(entries: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    """Number the entries from 0 in input order and mark them pending."""
    numbered = running_position(
        entries, [], ["input_pos"], F.floor(F.col("input_pos") / chunk_rows), "src_idx"
    )
    label = F.concat(F.lit("Page "), (F.col("src_idx") + 1).cast("string"))
    return numbered.select(
        "src_idx",
        F.coalesce("name", label).alias("name"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("type", F.lit(DEFAULT_TYPE)).alias("type"),
        "api_url",
        "keywords",
        "domain",
        "country",
        "site_number",
        F.lit("pending").alias("status"),
    )


def provider_of(page_type: Column, api_url: Column) -> Column:
    shape = F.lit(FALLBACK_PROVIDER)
    for part, provider in reversed(ADDRESS_TO_PROVIDER):
        shape = F.when(api_url.contains(part), F.lit(provider)).otherwise(shape)
    return (
        F.when((page_type == "api") & filled(api_url), shape)
        .when(page_type == "browser", F.lit("browser"))
        .otherwise(F.lit("html"))
    )


def route(planned: DataFrame) -> DataFrame:
    """Add ``provider``, or an ``error`` where there is no address at all."""
    has_address = filled(F.col("url")) | filled(F.col("api_url"))
    return planned.withColumn(
        "provider", F.when(has_address, provider_of(F.col("type"), F.col("api_url")))
    ).withColumn(
        "error",
        F.when(~has_address, F.concat(F.lit("No URL found for page: "), F.col("name"))),
    )


def kind_counts(planned: DataFrame) -> DataFrame:
    kind = F.when(F.col("type").isin("api", "browser"), F.col("type")).otherwise(F.lit("html"))
    return planned.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("sources"))


def with_base_urls(routed: DataFrame) -> DataFrame:
    """Add what job links are built from, and the per-provider defaults."""
    api = F.col("api_url")
    scheme = F.regexp_extract(api, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.lower(F.regexp_extract(api, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    origin = F.concat(F.lower(scheme), F.lit("://"), host)
    # .../wday/cxs/{tenant}/{site}/jobs: text before the last /wday/, then site.
    workday_root = F.regexp_extract(api, r"(?s)^(.*)/wday/", 1)
    tenant_and_site = F.split_part(
        F.split_part(api, F.lit("/wday/cxs/"), F.lit(2)), F.lit("/jobs"), F.lit(1)
    )
    workday_site = F.regexp_extract(tenant_and_site, r"(?s)^[^/]*/(.*)$", 1)
    provider = F.col("provider")
    return (
        routed.withColumn(
            "base_url",
            F.when(provider.isin("eightfold", "oracle_hcm", "phenom"), origin).when(
                provider == "workday", F.concat(workday_root, F.lit("/"), workday_site)
            ),
        )
        .withColumn(
            "domain",
            F.when(
                (provider == "eightfold") & ~filled(F.col("domain")), host
            ).otherwise(F.col("domain")),
        )
        .withColumn(
            "site_number",
            F.when(
                provider == "oracle_hcm", F.coalesce("site_number", F.lit(DEFAULT_SITE_NUMBER))
            ).otherwise(F.col("site_number")),
        )
        .withColumn(
            "country",
            F.when(
                provider == "phenom", F.coalesce("country", F.lit(DEFAULT_COUNTRY))
            ).otherwise(F.col("country")),
        )
    )


def with_company(routed: DataFrame) -> DataFrame:
    return routed.withColumn("company", company_from_source(F.col("name")))


def build_sources(entries: DataFrame) -> DataFrame:
    """Catalog -> plan -> routing -> link bases, the table payloads join to."""
    return with_base_urls(route(plan(source_catalog(entries))))
