"""Report tables over final postings: facets, filters, status and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions import dates
from hirelake.functions.text import company_slug, cut, escape_markup, filled, or_empty, strip
from hirelake.operators.cleaning import with_key
from hirelake.schema import ORDINAL, POSTING_FIELDS

# Recency windows in seconds, and lengths of shortened texts.
RECENCY_WINDOWS = {
    "within_1h": 3600,
    "within_3h": 10800,
    "within_6h": 21600,
    "within_24h": 86400,
    "within_48h": 172800,
}
SHORT_DESCRIPTION = 160
ERROR_LENGTH = 120
PREVIEW_ROWS = 10


def standardize(postings: DataFrame) -> DataFrame:
    """The eight fields in order, never NULL, stripped; order columns stay."""
    rest = [c for c in postings.columns if c not in POSTING_FIELDS]
    return postings.select(
        *[strip(or_empty(F.col(name))).alias(name) for name in POSTING_FIELDS], *rest
    )


def _counts(postings: DataFrame, field: str) -> DataFrame:
    first = F.min(F.struct(*ORDINAL))
    return (
        postings.groupBy(field)
        .agg(F.count(F.lit(1)).alias("n_jobs"), first.alias("_first"))
        .orderBy(F.desc("n_jobs"), "_first")
        .select(field, "n_jobs", F.col("_first.url").alias("first_url"))
    )


def by_company(postings: DataFrame) -> DataFrame:
    """Counts descending; equal counts in the order they first appear."""
    return _counts(postings, "company")


def by_location(postings: DataFrame) -> DataFrame:
    return _counts(postings, "location")


def _with_marker(postings: DataFrame, *columns: str) -> DataFrame:
    """Rows counting 1 and a single row counting 0, so that a grand total
    also comes out of an empty table without a second scan."""
    rows = postings.select(*columns, F.lit(1).cast("bigint").alias("_one"))
    empty = [F.lit(None).cast("string").alias(name) for name in columns]
    marker = postings.sparkSession.range(1).select(*empty, F.lit(0).cast("bigint").alias("_one"))
    return rows.unionByName(marker)


def summary(postings: DataFrame) -> DataFrame:
    """Total, per-company and per-location counts from one pass."""
    counted = (
        _with_marker(postings, "company", "location")
        .groupingSets([["company"], ["location"], []], "company", "location")
        .agg(F.sum("_one").alias("n_jobs"), F.grouping_id().alias("_set"))
    )
    facet = (
        F.when(F.col("_set") == 1, F.lit("company"))
        .when(F.col("_set") == 2, F.lit("location"))
        .otherwise(F.lit("total"))
    )
    told = F.when(F.col("n_jobs") == 0, F.lit("No jobs found.")).otherwise(
        F.lit("Total jobs found")
    )
    value = (
        F.when(F.col("_set") == 1, F.col("company"))
        .when(F.col("_set") == 2, F.col("location"))
        .otherwise(told)
    )
    return counted.filter("_set = 3 OR n_jobs > 0").select(
        facet.alias("facet"), value.alias("value"), "n_jobs"
    )


def with_epoch(postings: DataFrame) -> DataFrame:
    return postings.withColumn("posted_epoch", dates.report_epoch(F.col("date_posted")))


def _now(as_of) -> Column:
    return F.unix_micros(dates.instant(as_of)) / F.lit(1000000.0)


def recency_counts(postings: DataFrame, as_of) -> DataFrame:
    """Strict, cumulative age counts; future dates count in every window."""
    dated = F.col("posted_epoch") != 0
    age = _now(as_of) - F.col("posted_epoch")
    return (
        with_epoch(postings)
        .select("posted_epoch")
        .agg(
            F.count(F.lit(1)).alias("all_time"),
            *[
                F.count_if(dated & (age < seconds)).alias(name)
                for name, seconds in RECENCY_WINDOWS.items()
            ],
            F.count_if(~dated).alias("undated"),
        )
    )


HOUR = 3600


def hourly_counts(dated: DataFrame) -> DataFrame:
    """``hour`` (since 1970, NULL for undated rows) and ``n_jobs`` of rows with
    ``posted_epoch``.  Tables of parts of a history add up (:func:`merged_hours`)."""
    hour = F.when(F.col("posted_epoch") != 0, F.floor(F.col("posted_epoch") / HOUR))
    return dated.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n_jobs"))


def merged_hours(counts: DataFrame, more: DataFrame) -> DataFrame:
    return counts.unionByName(more).groupBy("hour").agg(F.sum("n_jobs").alias("n_jobs"))


def _since(hours: DataFrame, dated: DataFrame, edges: dict[str, Column], inside: dict[str, Column]) -> DataFrame:
    """Per name the rows after ``edges`` (seconds): whole hours from their counts, and
    of the one hour that an edge cuts the rows that are ``inside``."""
    cut = {name: F.floor(edge / HOUR) for name, edge in edges.items()}
    whole = hours.agg(
        F.coalesce(F.sum("n_jobs"), F.lit(0)).alias("all_time"),
        *(F.coalesce(F.sum(F.when(F.col("hour") > at, F.col("n_jobs"))), F.lit(0)).alias(n) for n, at in cut.items()),
        F.coalesce(F.sum(F.when(F.col("hour").isNull(), F.col("n_jobs"))), F.lit(0)).alias("undated"),
    )
    epoch = F.col("posted_epoch")
    # Ranges of the plain column, which a scan of a history sorted by it prunes by.
    within = {n: (epoch >= at * HOUR) & (epoch < (at + 1) * HOUR) & (epoch != 0) for n, at in cut.items()}
    near = F.lit(False)
    for test in within.values():
        near = near | test
    cuts = dated.filter(near).agg(
        F.lit(0).cast("bigint").alias("all_time"),
        *(F.count_if(within[n] & inside[n]).alias(n) for n in cut),
        F.lit(0).cast("bigint").alias("undated"),
    )
    names = ["all_time", *cut, "undated"]
    return whole.unionByName(cuts).agg(*(F.sum(n).alias(n) for n in names))


def recency_from_hours(hours: DataFrame, dated: DataFrame, as_of) -> DataFrame:
    """:func:`recency_counts` of a history from its :func:`hourly_counts`.

    ``dated`` is the history itself; of its rows only those are read whose hour
    is cut by the edge of a window.
    """
    age = _now(as_of) - F.col("posted_epoch")
    return _since(
        hours,
        dated,
        {name: _now(as_of) - seconds for name, seconds in RECENCY_WINDOWS.items()},
        {name: age < seconds for name, seconds in RECENCY_WINDOWS.items()},
    )


def time_filter_counts(hours: DataFrame, dated: DataFrame, as_of, spans: list[int]) -> DataFrame:
    """How many rows :func:`time_filter` shows for each span of hours, the same way."""
    names = {f"last_{span}h": span for span in spans}
    return _since(
        hours,
        dated,
        {name: F.floor(_now(as_of)) - span * HOUR for name, span in names.items()},
        {name: within_hours(as_of, span) for name, span in names.items()},
    )


def company_facet(postings: DataFrame) -> DataFrame:
    """Companies by code point, with their slug."""
    return (
        postings.groupBy("company")
        .agg(F.count(F.lit(1)).alias("n_jobs"))
        .withColumn("slug", company_slug(F.col("company")))
        .orderBy("company")
    )


def flag_new(postings: DataFrame, new_keys: DataFrame) -> DataFrame:
    keyed = postings if "dedup_key" in postings.columns else with_key(postings)
    marks = new_keys.select("dedup_key").distinct().withColumn("_new", F.lit(True))
    return keyed.join(marks, "dedup_key", "left").withColumn(
        "is_new", F.coalesce("_new", F.lit(False))
    ).drop("_new")


def title_matches(query: str) -> Column:
    return F.contains(F.lower("title"), strip(F.lower(F.lit(query))))


def title_search(postings: DataFrame, query: str) -> DataFrame:
    return postings.filter(title_matches(query))


def within_hours(as_of, hours: int) -> Column:
    """Inclusive, unlike the recency counts; undated rows are too old."""
    age = F.floor(_now(as_of)) - F.col("posted_epoch")
    return age <= hours * 3600


def time_filter(postings: DataFrame, as_of, hours: int) -> DataFrame:
    dated = with_epoch(postings)
    return dated.filter(within_hours(as_of, hours)) if hours > 0 else dated


def company_filter(postings: DataFrame, slug: str) -> DataFrame:
    """Companies that share a slug are shown together."""
    if slug == "all":
        return postings
    return postings.filter(company_slug(F.col("company")) == slug)


def new_only(flagged: DataFrame, slug: str = "all") -> DataFrame:
    """New rows; time and search do not apply."""
    return company_filter(flagged.filter("is_new"), slug)


def search_view(
    flagged: DataFrame, as_of, slug: str = "all", hours: int = 0, query: str = "",
    only_new: bool = False,
) -> DataFrame:
    """The visible rows for one setting of all filters."""
    if only_new:
        return new_only(with_epoch(flagged), slug)
    visible = time_filter(flagged, as_of, hours)
    if query.strip():
        visible = title_search(visible, query)
    return company_filter(visible, slug)


def view_counts(visible: DataFrame) -> DataFrame:
    """Visible rows per company and over all, with the companies shown."""
    # A row a company first: only these are rolled up, and each is a company by itself.
    shown = F.col("company").isNotNull() & (F.col("_jobs") > 0)
    rolled = (
        _with_marker(visible, "company")
        .groupBy("company")
        .agg(F.sum("_one").alias("_jobs"))
        .rollup("company")
        .agg(
            F.sum("_jobs").alias("visible_jobs"),
            F.count_if(shown).alias("visible_companies"),
            F.grouping("company").alias("_total"),
        )
    )
    name = F.when(F.col("_total") == 1, F.lit("All Companies")).otherwise(F.col("company"))
    return rolled.filter("_total = 1 OR visible_jobs > 0").select(
        name.alias("company"), "visible_jobs", "visible_companies"
    )


def headline(flagged: DataFrame) -> DataFrame:
    """Totals, and the label for the number of distinct new keys."""
    # One row a company and new key; what is distinct is counted on these.
    key = F.when(F.col("is_new"), F.col("dedup_key"))
    counted = (
        flagged.groupBy("company", key.alias("_key"))
        .agg(F.count(F.lit(1)).alias("_jobs"))
        .agg(
            F.coalesce(F.sum("_jobs"), F.lit(0)).alias("total_jobs"),
            F.count_distinct("company").alias("companies"),
            F.count_distinct("_key").alias("new_jobs"),
        )
    )
    n = F.col("new_jobs")
    label = F.when(n == 1, F.lit("1 new job")).otherwise(
        F.concat(n.cast("string"), F.lit(" new jobs"))
    )
    return counted.withColumn("label", label)


def source_status(
    planned: DataFrame, postings: DataFrame, errors: DataFrame, pages: DataFrame | None = None
) -> DataFrame:
    """State of every planned source.

    ``errors`` has src_idx and error, NULL error meaning an attempt without
    one.  A source without postings and without attempts is still waiting.
    ``pages`` (src_idx, pages_landed, pages_kept) tells how much was read.
    """
    told = []
    if pages is not None:
        planned = planned.join(pages, "src_idx", "left")
        told = [
            F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
            for name in ("pages_landed", "pages_kept")
        ]
    counts = postings.groupBy("src_idx").agg(F.count(F.lit(1)).alias("jobs"))
    attempts = errors.groupBy("src_idx").agg(F.min("error").alias("first_error"))
    joined = planned.join(counts, "src_idx", "left").join(
        attempts.withColumn("attempted", F.lit(True)), "src_idx", "left"
    )
    failed = filled(F.col("first_error")) & F.col("jobs").isNull()
    state = (
        F.when(failed, F.lit("error"))
        .when(F.col("jobs").isNotNull() | F.col("attempted"), F.lit("done"))
        .otherwise(F.lit("waiting"))
    )
    message = F.regexp_replace("first_error", r"(?s)^.*?: ", "")
    return joined.select(
        "src_idx",
        "name",
        F.substring(F.upper("type"), 1, 3).alias("type_label"),
        state.alias("state"),
        F.coalesce("jobs", F.lit(0)).cast("bigint").alias("jobs"),
        F.when(failed, F.substring(message, 1, ERROR_LENGTH)).otherwise(F.lit("")).alias("error"),
        *told,
    ).orderBy(F.lower("name"), "src_idx")


def error_rollup(status: DataFrame) -> DataFrame:
    errors = F.count_if(F.col("state") == "error")
    return status.agg((errors > 0).alias("has_errors"), errors.alias("error_sources"))


def digest(postings: DataFrame) -> DataFrame:
    """Rows for a notification: by company, then in input order."""
    return postings.orderBy("company", *ORDINAL).select(
        "company", "title", "location", "url", "source"
    )


def digest_lead(postings: DataFrame) -> DataFrame:
    """Subject line of the digest."""
    n = F.col("n_jobs")
    return postings.agg(F.count(F.lit(1)).alias("n_jobs")).withColumn(
        "subject", F.concat(n.cast("string"), F.lit(" new job posting(s)"))
    )


def preview(postings: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in input order and how many more there are."""
    total = postings.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        postings.orderBy(*ORDINAL)
        .limit(rows)
        .select("title", "company", "location", "url")
        .withColumn("more", F.greatest(total - rows, F.lit(0)))
    )


def with_short_description(postings: DataFrame) -> DataFrame:
    """Shortened after escaping, as the text is meant for a page."""
    text = escape_markup(F.col("description"))
    return postings.withColumn("short_description", cut(text, SHORT_DESCRIPTION, "..."))


def with_date_display(postings: DataFrame, zone: str) -> DataFrame:
    return postings.withColumn("date_display", dates.display_text(F.col("date_posted"), zone))
