"""Text helpers as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a
# field.  SQL ``trim`` alone would only remove the ASCII space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set inside a Java pattern (to be used with the flag ``(?U)``).
WS = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def filled(text: Column) -> Column:
    """True where the text is neither NULL nor empty (never NULL itself)."""
    return F.coalesce(text != "", F.lit(False))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def join_filled(separator: str, *parts: Column) -> Column:
    """Join the non-empty parts; '' when there is none."""
    return F.concat_ws(separator, *[blank_to_null(part) for part in parts])


def dedup_key(title: Column, company: Column, location: Column) -> Column:
    """Identity of a posting; the separator is deliberately not escaped."""
    return F.concat_ws(
        "|", *[F.lower(strip(or_empty(c))) for c in (title, company, location)]
    )


def posting_key() -> Column:
    return dedup_key(F.col("title"), F.col("company"), F.col("location"))


def company_from_source(source: Column) -> Column:
    without_suffix = F.replace(source, F.lit(" Careers"), F.lit(""))
    return F.replace(without_suffix, F.lit(" Jobs"), F.lit(""))


def capitalize(text: Column) -> Column:
    """First letter upper, all others lower (``initcap`` lifts every word)."""
    return F.concat(
        F.upper(F.substring(text, 1, 1)),
        F.lower(F.substring(text, 2, 2147483647)),
    )


def escape_markup(text: Column) -> Column:
    # Fixed values; the ampersand has to come first.
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def company_slug(company: Column) -> Column:
    return F.lower(F.replace(escape_markup(company), F.lit(" "), F.lit("-")))


def cut(text: Column, length: int, marker: str) -> Column:
    """The text, or its first ``length`` characters and a marker."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(marker))
    ).otherwise(text)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time per row, for
    costly values that ``use`` names more than once."""
    return F.transform(F.array(value), use)[0]
