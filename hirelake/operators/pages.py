"""Career pages (HTML) -> text, posting links, model context, listing rows.

A page is one row from start to end.  The DOM step runs in Arrow batches in
Python; everything after it is native and stays inside the row, so none of
these operators shuffles.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.functions import markup
from hirelake.functions.text import cut, filled, or_empty
from hirelake.schema import POSTING_FIELDS

# Limits, marker, heading and the default link pattern.
MAX_TEXT = 4000
CUT_MARKER = "\n\n[... content truncated ...]"
LINK_PATTERN = "(job|career|position|opening|role|apply|hiring|vacancy)"
LINK_TEXT = 200
CONTEXT_LINKS = 20
CONTEXT_HEADING = "\n\nJob-related links found on this page:\n"
LISTING_COMPANY = "ServiceNow"
LISTING_SOURCE = "ServiceNow Careers"
LISTING_SITE = "https://careers.servicenow.com"


_TEXT = T.StringType()


def _structs(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, _TEXT) for name in names]))


_ANCHORS = _structs("text", "href", "url")


@F.pandas_udf(_TEXT)
def _main_text(html: pd.Series) -> pd.Series:
    return html.map(lambda page: markup.main_text(markup.Page(page)) if page else "")


@F.pandas_udf(_ANCHORS)
def _anchors(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series(
        [markup.anchors(markup.Page(page), base or "") if page else [] for page, base in zip(html, url)]
    )


@F.pandas_udf(T.StructType().add("text", _TEXT).add("anchors", _ANCHORS))
def _text_and_anchors(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    pages = [markup.Page(page) if page else None for page in html]
    return pd.DataFrame(
        {
            "text": [markup.main_text(page) if page else "" for page in pages],
            "anchors": [
                markup.anchors(page, base or "") if page else []
                for page, base in zip(pages, url)
            ],
        }
    )


@F.pandas_udf(
    T.StructType().add("cards", _structs("title", "href", "place")).add("counter", _TEXT)
)
def _listing(html: pd.Series) -> pd.DataFrame:
    read = [markup.listing(markup.Page(page or "")) for page in html]
    return pd.DataFrame(read, columns=["cards", "counter"])


def _tidy(text: Column, max_length: int) -> Column:
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    text = F.regexp_replace(text, " {2,}", " ")
    return cut(text, max_length, CUT_MARKER)


def _posting_links(anchors: Column, pattern: str) -> Column:
    """Matching links with an http address in page order."""
    test = "(?iu)" + pattern
    numbered = F.transform(
        anchors,
        lambda a, i: F.struct(
            a["url"].alias("url"), i.alias("pos"), a["text"].alias("text"), a["href"].alias("href")
        ),
    )
    return F.filter(
        numbered,
        lambda a: a["url"].startswith("http") & (a["text"].rlike(test) | a["href"].rlike(test)),
    )


def _with_unique_links(pages: DataFrame, anchors: Column, pattern: str) -> DataFrame:
    """Add ``links``: the first matching link of each address, in page order.

    Sorting the page's own array by (address, position) puts the first of
    each address next to its copies: n log n within the row, no shuffle.
    """
    return (
        pages.withColumn("_sorted", F.array_sort(_posting_links(anchors, pattern)))
        .withColumn(
            "_firsts",
            F.filter(
                "_sorted",
                lambda a, i: (i == 0)
                | (a["url"] != F.get(F.col("_sorted"), F.greatest(i - 1, F.lit(0)))["url"]),
            ),
        )
        .withColumn(
            "links",
            F.array_sort(
                F.transform(
                    "_firsts",
                    lambda a: F.struct(
                        a["pos"].alias("pos"),
                        F.substring(a["text"], 1, LINK_TEXT).alias("text"),
                        a["url"].alias("url"),
                    ),
                )
            ),
        )
        .drop("_sorted", "_firsts")
    )


def page_text(pages: DataFrame, max_length: int = MAX_TEXT) -> DataFrame:
    """Main text of every page."""
    return pages.withColumn("text", _tidy(_main_text("html"), max_length)).drop("html")


def page_links(pages: DataFrame, pattern: str = LINK_PATTERN) -> DataFrame:
    """One row per posting link: position (from 0), text and address."""
    found = pages.select("page_id", _anchors("html", "url").alias("anchors"))
    unique = _with_unique_links(found, F.col("anchors"), pattern)
    # The plain explode would have the optimizer test the array's size below,
    # and read every page twice for it.
    rows = unique.select("page_id", F.posexplode_outer("links").alias("pos", "link"))
    return rows.filter("link IS NOT NULL").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "link.text", "link.url"
    )


def page_context(
    pages: DataFrame, pattern: str = LINK_PATTERN, max_length: int = MAX_TEXT
) -> DataFrame:
    """What a model is shown: the text, then up to 20 links, cut once more."""
    read = pages.withColumn("read", _text_and_anchors("html", "url")).drop("html")
    linked = _with_unique_links(read, F.col("read.anchors"), pattern)
    lines = F.transform(
        F.slice("links", 1, CONTEXT_LINKS),
        lambda a: F.concat(F.lit("- "), a["text"], F.lit(": "), a["url"], F.lit("\n")),
    )
    block = F.when(
        F.array_size("links") > 0, F.concat(F.lit(CONTEXT_HEADING), F.array_join(lines, ""))
    ).otherwise(F.lit(""))
    whole = F.concat(_tidy(F.col("read.text"), max_length), block)
    return linked.withColumn("context", cut(whole, max_length, CUT_MARKER)).drop("read", "links")


def listing_postings(pages: DataFrame, *carried: Column) -> DataFrame:
    """Listing pages -> postings, with the announced result total.

    ``source`` is the listing's own name; ``carried`` are further columns of the
    landed page to keep, such as the name it was landed under.
    """
    read = pages.withColumn("read", _listing("html"))
    total = F.regexp_extract("read.counter", r"(?U)of\s*(\d+)", 1).try_cast("bigint")
    rows = read.withColumn("total", F.coalesce(total, F.lit(0).cast("bigint"))).select(
        "total",
        F.struct("page_no", *carried).alias("page"),
        F.posexplode("read.cards").alias("item_no", "card"),
    )
    title, href = F.col("card.title"), F.col("card.href")
    kept = rows.filter(
        filled(title) & href.contains("/jobs/") & ~F.lower(title).isin("save", "saved")
    )
    fields = {
        "title": title,
        "company": F.lit(LISTING_COMPANY),
        "location": F.coalesce(F.nullif(F.col("card.place"), F.lit("")), F.lit("Not specified")),
        "url": F.when(href.startswith("/"), F.concat(F.lit(LISTING_SITE), href)).otherwise(href),
        "description": F.lit(""),
        "date_posted": F.lit(""),
        "source": F.lit(LISTING_SOURCE),
        "job_type": F.lit("Full-time"),
    }
    return kept.select(
        *[fields[name].alias(name) for name in POSTING_FIELDS], "item_no", "total", "page.*"
    )


def listing_stats(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Page statistics of listing pages, for the page cut-off."""
    read = pages.withColumn("read", _listing("html"))
    cards = F.filter(
        "read.cards",
        lambda c: filled(c["title"])
        & c["href"].contains("/jobs/")
        & ~F.lower(c["title"]).isin("save", "saved"),
    )
    total = F.regexp_extract("read.counter", r"(?U)of\s*(\d+)", 1).try_cast("bigint")
    return read.select(
        *(keys or ["source"]),
        F.lit("servicenow").alias("provider"),
        "page_no",
        F.coalesce("success", F.lit(False)).alias("success"),
        or_empty(F.col("error")).alias("error"),
        F.coalesce(F.array_size(cards), F.lit(0)).cast("bigint").alias("n_jobs"),
        F.coalesce(total, F.lit(0).cast("bigint")).alias("total"),
    )
