"""How much of each source to keep: page cut-off and all-or-nothing failure.

Both follow from one small table with a row per source, ``page_limits``.  Wide
payload rows are never shuffled to find it: the limits come from slim page
statistics and are joined back, so a source with very many or very large pages
is not gathered anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StopRule:
    """When reading a source's pages stops, tested after each page.

    ``total``: ``always`` stops at n >= total even for a missing total (0);
    ``known`` only looks at a total above 0; ``never`` ignores it.
    ``cap`` is tested on ``offset`` (step x pages before), ``page`` or ``rows``.
    ``min_rows``: a page with fewer rows is the last one.
    """

    total: str
    cap: str
    limit: int
    step: int = 1
    min_rows: int = 1

    def most_pages(self) -> int:
        """Pages that can be read at all; no kept page lies beyond it."""
        if self.cap == "page":
            return self.limit
        if self.cap == "offset":
            return -(-self.limit // self.step) + 1
        return self.limit + 1  # every page but the last adds a row or more


# The stop rules by payload shape.
STOP_RULES = {
    "amazon": StopRule("always", "offset", 500, step=10),
    "eightfold": StopRule("known", "rows_before", 500),
    "workday": StopRule("always", "offset", 500, step=20),
    "lever": StopRule("never", "offset", 500, step=100, min_rows=100),
    "greenhouse": StopRule("never", "page", 10),
    "oracle_hcm": StopRule("always", "offset", 500, step=25),
    "phenom": StopRule("always", "offset", 500, step=20),
    "goldman_sachs": StopRule("known", "rows", 500),
    "epam": StopRule("known", "offset", 500, step=20),
    "apple": StopRule("known", "rows", 500),
    "servicenow": StopRule("known", "rows", 500),
    "github": StopRule("always", "page", 10),
}


def _per_provider(value, rules: dict[str, StopRule]) -> Column:
    """``value(rule)`` chosen by the provider column."""
    chosen = F.lit(None)
    for name, rule in rules.items():
        chosen = F.when(F.col("provider") == name, value(rule)).otherwise(chosen)
    return chosen


def _stops(rule: StopRule) -> Column:
    rows, total = F.col("_rows"), F.col("_total")
    stop = F.col("n_jobs") < rule.min_rows
    if rule.total == "always":
        stop = stop | (rows >= total)
    elif rule.total == "known":
        stop = stop | ((total > 0) & (rows >= total))
    position = {
        "offset": (F.col("page_no") - 1) * rule.step,
        "page": F.col("page_no"),
        "rows": rows,
        "rows_before": rows - F.col("n_jobs"),
    }[rule.cap]
    return stop | (position >= rule.limit)


def within_reach(pages: DataFrame, rules: dict[str, StopRule] | None = STOP_RULES) -> DataFrame:
    """Pages that a stop rule could keep, told by provider and page number alone."""
    if rules is None:
        return pages
    return pages.filter(
        F.col("page_no") <= _per_provider(lambda rule: F.lit(rule.most_pages()), rules)
    )


def page_limits(
    page_stats: DataFrame,
    keys: list[str] | None = None,
    rules: dict[str, StopRule] | None = STOP_RULES,
) -> DataFrame:
    """``page_stats`` (source, provider, page_no, success, error, n_jobs,
    total) -> one row per source: last_page, failed, error.

    Pages past ``most_pages`` cannot be kept by any rule.  Dropping them first
    is exact and bounds what the window sees of one source (501 slim rows).
    ``keys`` defaults to the source; pass (run, source) for several runs.
    Without ``rules`` every landed page counts and only failures end a source;
    then nothing is summed and no window is needed.
    """
    keys = keys or ["source"]
    if rules is None:
        judged = page_stats.withColumn("_last", ~F.col("success"))
    else:
        so_far = Window.partitionBy(*keys, "provider").orderBy("page_no")
        judged = (
            within_reach(page_stats, rules)
            .withColumn("_total", F.coalesce("total", F.lit(0)))
            .withColumn("_rows", F.sum("n_jobs").over(so_far))
            .withColumn("_last", ~F.col("success") | _per_provider(_stops, rules))
        )
    ending = F.struct("page_no", "success", "error")
    ends = judged.groupBy(*keys, "provider").agg(
        F.min(F.when(F.col("_last"), ending)).alias("_end"),
        F.max("page_no").alias("_landed"),
    )
    return ends.select(
        *keys,
        "provider",
        F.coalesce("_end.page_no", "_landed").alias("last_page"),
        F.coalesce(~F.col("_end.success"), F.lit(False)).alias("failed"),
        F.col("_end.error").alias("error"),
    )


def cut_pages(pages: DataFrame, limits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pages up to and including the last one to be read."""
    keys = keys or ["source"]
    ends = limits.select(*keys, "last_page")
    return pages.join(ends, keys).filter(F.col("page_no") <= F.col("last_page")).drop("last_page")


def drop_failed(pages: DataFrame, limits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cut pages, and none at all for a source with a failed page among them."""
    return cut_pages(pages, limits.filter(~F.col("failed")), keys)


def failed_sources(limits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["source"]
    opening = F.when(F.col("provider") == "servicenow", F.lit("Fetch failed for ")).otherwise(
        F.lit("API fetch failed for ")
    )
    return limits.filter("failed").select(
        *keys,
        F.concat(
            opening, F.col("source"), F.lit(": "), F.coalesce("error", F.lit(""))
        ).alias("error"),
    )
