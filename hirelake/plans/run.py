"""One whole run, from landed rows to report tables.

Landed rows are told apart by (run_id, src_idx): the fetch cycle and the
source's number in the catalog, so cycles in one folder and sources of one name
stay apart.  What bodies are joined to is written first and read back (the
catalog, and one row per source and cycle), so planning knows its size and
broadcasts it where it is small: bodies are then not shuffled.  For histories of
many cycles land payloads in buckets: then neither has to be small.  Bodies are
parsed twice, once for the slim page statistics and once for the postings; both
are written, and all report tables read those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import filled
from hirelake.operators import exchange, pages, paging, payloads
from hirelake.operators.cleaning import MAX_AGE_DAYS, clean_postings
from hirelake.operators.model_tables import api_or_model, bypasses_model
from hirelake.operators.reporting import source_status, standardize
from hirelake.schema import PAGE_STAT
from hirelake.session import written
from hirelake.sources.bucketed import BucketedLanding
from hirelake.sources.landing import with_fetch_errors

KEYS = ["run_id", "src_idx"]
CATALOG = ["src_idx", "name", "provider", "base_url", "site_number"]


@dataclass
class Run:
    """Tables of one run.  ``postings`` carry run_id; ``errors`` are run_id,
    src_idx, source and error.  ``asks`` are the requests to a model that are
    open (ask_id, kind, request), ``invalid`` normalized rows of wrong types;
    both are None where the run was not given the tables for them."""

    postings: DataFrame
    final: DataFrame
    errors: DataFrame
    status: DataFrame
    asks: DataFrame | None = None
    invalid: DataFrame | None = None


@dataclass
class Reading:
    """What a run has read without a model (:func:`read_payloads`): its tables are
    written, and :func:`answered_run` goes on from them as often as there are answers."""

    sources: DataFrame
    found: DataFrame
    stats: DataFrame
    limits: DataFrame
    postings: DataFrame
    tried: DataFrame
    errors: DataFrame
    asks: DataFrame | None
    as_of: object
    max_age_days: int


def with_keys(landed: DataFrame, catalog: DataFrame, run_id: int | None = None) -> DataFrame:
    """Landed rows with run_id, src_idx and what the catalog says of the source.

    A row without a cycle belongs to cycle 0; one without src_idx to the first
    source of its name.  Rows of no known source stay, with a NULL provider.
    """
    cycle = F.col("run_id").cast("bigint") if "run_id" in landed.columns else F.lit(None)
    number = F.col("src_idx").cast("bigint") if "src_idx" in landed.columns else F.lit(None)
    rows = landed.withColumn("run_id", F.coalesce(cycle, F.lit(0).cast("bigint")))
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    firsts = catalog.groupBy(F.col("name").alias("source")).agg(F.min("src_idx").alias("_first"))
    told = [c for c in CATALOG if c in landed.columns and c != "src_idx"]
    return (
        rows.drop(*told)
        .join(firsts, "source", "left")
        .withColumn("src_idx", F.coalesce(number, "_first"))
        .drop("_first")
        .join(catalog, "src_idx", "left")
        .withColumn("source", F.coalesce("name", "source"))
        .drop("name")
    )


def arrival_stats(arrivals: DataFrame, catalog: DataFrame, *carried: str) -> DataFrame:
    """Pages and cards of ``ARRIVAL`` rows as ``PAGE_STAT`` rows; no shuffle, so a stream may do it.

    A page of a source that the catalog does not know has no provider; it is
    counted, and nothing is read from it.  A card is told by its number.
    """

    def of_kind(kind: str) -> DataFrame:
        return with_keys(arrivals.filter(F.col("kind") == kind), catalog)

    payload = with_fetch_errors(of_kind("payload"))
    of_shape = F.coalesce(F.col("provider").isin(*payloads.SHAPES), F.lit(False))
    keys = [*KEYS, "source", *carried]
    nothing = {"n_jobs": F.lit(0).cast("bigint"), "total": F.lit(None).cast("bigint")}
    lost = payload.filter(~of_shape).withColumns(nothing | {"provider": F.lit(None).cast("string")})
    listing = with_fetch_errors(of_kind("listing").withColumnRenamed("body", "html"), "html")
    cards = of_kind("card").withColumns(
        nothing | {"page_no": F.col("item_no"), "success": F.lit(True), "error": F.lit("")}
    )
    parts = [
        ("payload", payloads.page_stats(payload, keys)),
        ("payload", lost),
        ("listing", pages.listing_stats(listing, keys).withColumn("provider", F.lit("servicenow"))),
        ("card", cards),
    ]
    columns = [*(c.split()[0] for c in PAGE_STAT.split(", ")), *carried]
    rows = [part.withColumn("kind", F.lit(kind)).select(*columns) for kind, part in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _told_of(rows: DataFrame, told: DataFrame, kind: str, number: str = "page_no") -> DataFrame:
    """Rows that the page statistics know, by cycle, source and number."""
    mine = told.filter(F.col("kind") == kind).select(
        *(F.col(k).alias(f"_{k}") for k in KEYS), F.col("page_no").alias("_number")
    )
    same = F.col(number).eqNullSafe(F.col("_number"))
    for key in KEYS:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return rows.join(mine, same, "left_semi")


def _failures(rows: DataFrame, opening: str, error: Column) -> DataFrame:
    """An error row of a run: the opening, the source's name and what went wrong."""
    text = F.concat(F.lit(opening), F.coalesce("source", F.lit("")), error)
    return rows.select(*KEYS, "source", text.alias("error"))


def run_payloads(
    raw_payload: DataFrame | BucketedLanding,
    sources: DataFrame,
    as_of,
    cards: DataFrame | None = None,
    listings: DataFrame | None = None,
    extracted: DataFrame | None = None,
    max_age_days: int = MAX_AGE_DAYS,
    html_pages: DataFrame | None = None,
    responses: DataFrame | None = None,
    attempts: DataFrame | None = None,
    run_id: int | None = None,
    rules: dict[str, paging.StopRule] | None = paging.STOP_RULES,
    stats: DataFrame | None = None,
    contexts: DataFrame | None = None,
    answers: DataFrame | None = None,
    skip_normalization: bool = True,
) -> Run:
    """Landed rows -> postings, final rows, errors and status.

    ``cards`` are browser cards, ``listings`` server-rendered listing pages and
    ``extracted`` postings read from model responses; the last only count for
    sources without flattened rows.  ``html_pages`` are fetched career pages
    (source, success, error, and ``text`` where it has been read), ``responses``
    the model's answers (source, error) and ``attempts`` further tries (source,
    error), such as those of a browser.  Any of them may have run_id and src_idx.

    ``run_id`` reads one cycle only.  Without it every cycle is judged by its
    own pages, and a source counts as done if any cycle brought postings.
    ``rules`` end the reading of a source; None keeps every landed page.  A page
    without a number has no place in a source: it is landed, not kept, and an error.  A page
    that no rule can reach is not read, but it is counted as landed.

    A :class:`BucketedLanding` has been keyed when it was filled.  Its bodies meet
    their limits bucket by bucket and are not shuffled, however many cycles and
    sources there are; a frame's bodies stay in place while catalog and limits are small.

    ``contexts`` (source, url, context) are pages for a model to read, asked
    where their source has no flattened rows; ``answers`` (see ``exchange``) are
    what the model has said so far, in any cycle.  Without
    ``skip_normalization`` rows of all sources but API ones go through the model
    in batches, and stay as they are until it has answered.  What is still to be
    asked is the run's ``asks``; run again with more answers to use them.

    ``stats`` (see :func:`arrival_stats`) are pages that were told of before,
    such as those that a stream has released: bodies are not parsed for them
    again, and a landed page that is not among them is not read.
    """
    reading = read_payloads(
        raw_payload, sources, as_of, cards, listings, extracted, max_age_days, html_pages, responses, attempts,
        run_id, rules, stats, contexts,
    )
    return answered_run(reading, answers, skip_normalization)


def read_payloads(
    raw_payload: DataFrame | BucketedLanding,
    sources: DataFrame,
    as_of,
    cards: DataFrame | None = None,
    listings: DataFrame | None = None,
    extracted: DataFrame | None = None,
    max_age_days: int = MAX_AGE_DAYS,
    html_pages: DataFrame | None = None,
    responses: DataFrame | None = None,
    attempts: DataFrame | None = None,
    run_id: int | None = None,
    rules: dict[str, paging.StopRule] | None = paging.STOP_RULES,
    stats: DataFrame | None = None,
    contexts: DataFrame | None = None,
) -> Reading:
    """The part of :func:`run_payloads` that takes no answers of a model."""
    sources = written(sources, "sources")
    catalog = sources.select(*CATALOG)
    buckets = raw_payload if isinstance(raw_payload, BucketedLanding) else None
    landed = buckets.read(run_id) if buckets else with_keys(raw_payload, catalog, run_id)
    if stats is not None:
        told = written(stats, "told")
        landed = _told_of(landed, told, "payload")
        listings = listings if listings is None else _told_of(with_keys(listings, catalog, run_id), told, "listing")
        stats = told.filter(F.col("kind").isin("payload", "listing")).drop("kind")
    of_shape = F.coalesce(F.col("provider").isin(*payloads.SHAPES), F.lit(False))
    known = landed.filter(of_shape)
    numbered = F.col("page_no").isNotNull()
    found = landed.groupBy(*KEYS, "source", of_shape.alias("usable"), numbered.alias("numbered")).agg(
        F.count("*").alias("pages")
    )
    fresh = stats is None
    if fresh:
        stats = payloads.page_stats(paging.within_reach(known, rules), [*KEYS, "source"])
    else:
        stats = stats.filter(F.col("provider").isNotNull())
    if listings is not None:
        listings = with_keys(listings, catalog, run_id)
        is_known = F.col("provider").isNotNull()
        found = found.unionByName(
            listings.groupBy(*KEYS, "source", is_known.alias("usable"), numbered.alias("numbered")).agg(
                F.count("*").alias("pages")
            )
        )
        listings = listings.filter(is_known)
        if fresh:
            stats = stats.unionByName(pages.listing_stats(listings, [*KEYS, "source"]))
    found = written(found, "found")
    stats = written(stats, "page-stats")
    limits = written(paging.page_limits(stats, [*KEYS, "source"], rules), "limits")

    kept = buckets.kept(known, limits) if buckets else paging.drop_failed(known, limits, KEYS)
    parts = [payloads.flatten_all(kept, as_of, "run_id")]
    if cards is not None:
        shown = with_keys(cards, catalog, run_id).drop("provider", "base_url", "site_number")
        if not fresh:
            shown = _told_of(shown, told, "card", "item_no")
        parts.append(payloads.flatten_cards(shown, sources, "run_id"))
    if listings is not None:
        # Numbered by the source they were landed for; the rows carry the listing's own name.
        parts.append(
            pages.listing_postings(paging.drop_failed(listings, limits, KEYS), *map(F.col, KEYS))
            .drop("total")
            .withColumn("provider", F.lit("servicenow"))
            .withColumn("item_no", F.col("item_no").cast("bigint"))
        )
    postings = written(payloads.union_postings(*parts), "flattened")
    if extracted is not None:
        read = (
            with_keys(extracted, catalog, run_id)
            .filter(F.col("src_idx").isNotNull())
            .withColumn("page_no", F.col("batch_id"))
            .withColumn("provider", F.lit("html"))
            .drop("batch_id", "base_url", "site_number")
        )
        postings = api_or_model(postings, read, *KEYS)
    tried, errors = _outcomes(found, limits, sources, catalog, run_id, html_pages, responses, attempts)
    asks = None
    if contexts is not None:
        pages_to_read = with_keys(contexts, catalog, run_id).filter(F.col("src_idx").isNotNull())
        asks = written(exchange.extraction_asks(pages_to_read, postings, KEYS), "extraction-asks")
        tried = tried.unionByName(pages_to_read.select(*KEYS))
    return Reading(sources, found, stats, limits, postings, tried, errors, asks, as_of, max_age_days)


def answered_run(reading: Reading, answers: DataFrame | None = None, skip_normalization: bool = True) -> Run:
    """A run from what was read and what a model has said so far."""
    sources, postings, tried, errors = reading.sources, reading.postings, reading.tried, reading.errors
    found, stats, limits = reading.found, reading.stats, reading.limits
    answers = sources.sparkSession.createDataFrame([], exchange.ANSWER) if answers is None else answers
    asked, invalid = [], None
    if reading.asks is not None:
        asked.append(reading.asks.select("ask_id", "kind", "request"))
        read = exchange.extracted(reading.asks, answers, KEYS).withColumns(
            {"provider": F.lit("html"), "page_no": F.lit(0).cast("bigint")}
        )
        postings = written(payloads.union_postings(postings, read), "read")
        errors = errors.unionByName(exchange.extraction_failures(reading.asks, answers, KEYS))
    if not skip_normalization:
        postings, asks = _normalized(postings, sources, answers)
        asked.append(asks)
        invalid = postings.filter("NOT is_valid").select(*KEYS, "source", "title", "url")
        postings = postings.drop("is_valid")
    asks = None
    for part in asked:
        asks = part if asks is None else asks.unionByName(part)
    asks = None if asks is None else exchange.open_asks(asks, answers)
    errors = written(errors, "errors")
    attempted = tried.select("src_idx", F.lit(None).cast("string").alias("error")).unionByName(
        errors.select("src_idx", "error")
    )
    kept = (
        stats.join(limits.filter("NOT failed").select(*KEYS, "last_page"), KEYS)
        .filter("page_no <= last_page")
        .select("src_idx", F.lit(0).cast("bigint").alias("landed"), F.lit(1).cast("bigint").alias("kept"))
    )
    counts = (
        found.select("src_idx", F.col("pages").alias("landed"), F.lit(0).cast("bigint").alias("kept"))
        .unionByName(kept)
        .groupBy("src_idx")
        .agg(F.sum("landed").alias("pages_landed"), F.sum("kept").alias("pages_kept"))
    )
    final = standardize(clean_postings(postings.drop("run_id"), reading.as_of, reading.max_age_days))
    return Run(postings, final, errors, source_status(sources, postings, attempted, counts), asks, invalid)


def _normalized(postings: DataFrame, sources: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows after normalization, with ``is_valid``, and the requests it takes.

    Rows of API sources stay.  The others go by batches of their source and cycle,
    and an answered row keeps its source's provider and number.
    """
    told = sources.select("src_idx", "name", "provider", "type")
    typed = postings.join(told.select("src_idx", "type"), "src_idx", "left")
    bypass = bypasses_model(F.coalesce("type", F.lit("career_page")))
    valid = F.col("title").isNotNull() & F.col("company").isNotNull()
    stay = typed.filter(bypass).drop("type").withColumn("is_valid", valid)
    batches = written(exchange.normalization_asks(typed.filter(~bypass).drop("type"), KEYS), "normalization-asks")
    named = batches.join(told.select("src_idx", "name"), "src_idx", "left")
    rows = exchange.normalized(named, answers, F.col("name"), KEYS)
    rows = rows.join(told.select("src_idx", "provider"), "src_idx", "left")
    return (
        written(stay.unionByName(rows, allowMissingColumns=True), "normalized"),
        batches.select("ask_id", "kind", "request"),
    )


def _outcomes(found, limits, sources, catalog, run_id, html_pages, responses, attempts):
    """What was tried (run_id, src_idx) and what failed."""
    told = F.concat(F.lit(": "), F.coalesce("error", F.lit("")))
    tried = limits.select(*KEYS)
    errors = paging.failed_sources(limits, [*KEYS, "source"]).select(*KEYS, "source", "error")
    lost = found.filter("NOT usable")
    errors = errors.unionByName(_failures(lost, "No readable source in the catalog: ", F.lit("")))
    loose = found.filter("usable AND NOT numbered")
    errors = errors.unionByName(_failures(loose, "Pages without a number from ", F.lit("")))
    planless = sources.filter(F.col("error").isNotNull()).select(
        F.lit(run_id or 0).cast("bigint").alias("run_id"),
        F.col("src_idx").cast("bigint").alias("src_idx"),
        F.col("name").alias("source"),
        "error",
    )
    errors = errors.unionByName(planless)
    if html_pages is not None:
        page = with_keys(html_pages, catalog, run_id)
        bad = ~F.coalesce("success", F.lit(False))
        tried = tried.unionByName(page.select(*KEYS))
        errors = errors.unionByName(_failures(page.filter(bad), "Scraper failed for ", told))
        if "text" in html_pages.columns:
            empty = page.filter(~bad & ~filled(F.col("text")))
            errors = errors.unionByName(_failures(empty, "No text content to parse for ", F.lit("")))
    for rows, opening in ((responses, "LLM call failed for "), (attempts, "Browser scrape failed for ")):
        if rows is not None:
            rows = with_keys(rows, catalog, run_id)
            tried = tried.unionByName(rows.select(*KEYS))
            errors = errors.unionByName(_failures(rows.filter(filled(F.col("error"))), opening, told))
    return tried, errors
