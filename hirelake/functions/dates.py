"""Reading and writing the date texts found in postings.

``date_posted`` stays text.  Two readings of it are needed and they differ on
purpose: the age filter only trusts texts that carry an offset, the report
also dates day-only and offset-less texts (as UTC).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date text formats.
UTC_TEXT = "yyyy-MM-dd'T'HH:mm:ss'+0000'"
UTC_TEXT_READ = "yyyy-M-d'T'H:m:sxx"
DAY_READ = "yyyy-M-d"
LONG_MONTH = "MMMM d, yyyy"
SHORT_MONTH = "MMM d, yyyy"
DISPLAY = "MMM dd, hh:mm a"

# Day, hour, minute, second, fraction, offset; the extended form and the basic one.
_EXTENDED = r"(\d{4}-\d{2}-\d{2})[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?"
_BASIC = r"(\d{8})[T ](\d{2})(?:(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?"
_OFFSET = r"(Z|[+-]\d{2}(?::?\d{2})?)"
ISO_WITH_OFFSET = rf"^(?:{_EXTENDED}|{_BASIC}){_OFFSET}$"
ISO_WITHOUT_OFFSET = rf"^(?:{_EXTENDED}|{_BASIC})$"

# The usual form, which Spark's own reader takes as it stands.
PLAIN = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"
PLAIN_OFFSET = r"(Z|[+-]\d\d:\d\d)"

FIRST_SECOND = -62135596800  # 0001-01-01T00:00:00Z
LAST_SECOND = 253402300799  # 9999-12-31T23:59:59Z


def instant(as_of: dt.datetime | str | Column) -> Column:
    """``as_of`` as a timestamp column; naive values are taken as UTC."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    micros = (as_of - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(
        microseconds=1
    )
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def days_before(as_of, days: int) -> Column:
    return instant(as_of) - F.make_dt_interval(F.lit(days))


def utc_text(moment: Column) -> Column:
    return F.date_format(moment, UTC_TEXT)


def _read(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


def _read_iso(text: Column) -> Column:
    """ISO text of either form, minutes, seconds and fraction optional; digits of
    the fraction beyond the sixth do not count.  Without an offset it is in UTC
    (the session zone, see ``session.SETTINGS``)."""
    spaced = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})[T ]", "$1-$2-$3T")
    spaced = F.regexp_replace(spaced, r"^(.{11}\d{2})(\d{2})(\d{2})?", "$1:$2:$3")
    spaced = F.regexp_replace(spaced, r"^(.{11}\d{2}:\d{2}):(?!\d)", "$1")
    spaced = F.regexp_replace(spaced, r"^(.{11}\d{2})(?!:|\d)", "$1:00")
    spaced = F.regexp_replace(spaced, r"^(.{11}\d{2}:\d{2})(?!:)", "$1:00")
    spaced = F.regexp_replace(spaced, r"^(.{19})[.,](\d{1,6})\d*", "$1.$2")
    spaced = F.regexp_replace(spaced, r"([+-]\d{2})$", "$1:00")
    return F.when(spaced.rlike(r"^.{19}"), F.try_to_timestamp(spaced))


def iso_instant(text: Column) -> Column:
    """The instant of any ISO text with an offset; NULL for every other text."""
    return F.when(text.rlike(f"{PLAIN}{PLAIN_OFFSET}$"), F.try_to_timestamp(text)).when(
        text.rlike(ISO_WITH_OFFSET), _read_iso(text)
    )


def offset_instant(text: Column) -> Column:
    """The instant of a text with an offset; NULL for every other text."""
    return F.when(text.endswith("+0000"), _read(text, UTC_TEXT_READ)).otherwise(iso_instant(text))


def report_instant(text: Column) -> Column:
    """The instant as the report reads it: days and bare clocks are UTC."""
    day_only = (F.length(text) == 10) & (F.substring(text, 5, 1) == "-")
    return (
        F.when(text.endswith("+0000"), _read(text, UTC_TEXT_READ))
        .when(day_only, _read(text, DAY_READ))
        .when(text.rlike(f"{PLAIN}{PLAIN_OFFSET}?$"), F.try_to_timestamp(text))
        .when(
            text.rlike(ISO_WITH_OFFSET) | text.rlike(ISO_WITHOUT_OFFSET),
            _read_iso(text),
        )
    )


def report_epoch(text: Column) -> Column:
    """Seconds since 1970 of :func:`report_instant`, 0 when undated."""
    return F.coalesce(F.unix_micros(report_instant(text)) / F.lit(1000000.0), F.lit(0.0))


def epoch_seconds_text(seconds: Column) -> Column:
    """Text of an epoch in seconds; '' for missing, 0 and out of range."""
    usable = (seconds != 0) & seconds.between(FIRST_SECOND, LAST_SECOND)
    return F.coalesce(F.when(usable, utc_text(F.timestamp_seconds(seconds))), F.lit(""))


def epoch_millis_text(millis: Column) -> Column:
    usable = (millis != 0) & millis.between(FIRST_SECOND * 1000, LAST_SECOND * 1000 + 999)
    return F.coalesce(F.when(usable, utc_text(F.timestamp_millis(millis))), F.lit(""))


def month_name_text(text: Column, pattern: str) -> Column:
    """``February 13, 2026`` or ``Feb 13, 2026`` as midnight UTC, else NULL."""
    return utc_text(_read(F.regexp_replace(text, r"\s+", " "), pattern))


def day_text(text: Column) -> Column:
    return utc_text(_read(text, DAY_READ))


def days_ago_text(text: Column, as_of) -> Column:
    """``Posted Today`` / ``Yesterday`` / ``n+ Days Ago`` relative to as_of."""
    now = instant(as_of)
    days = F.regexp_extract(text, r"(\d+)\+?\s*Days?", 1).try_cast("bigint")
    # Any number of days; a moment before the first year is no date.
    micros = F.unix_micros(now) - F.try_multiply(days, F.lit(86_400_000_000))
    moment = (
        F.when(text.contains("Today"), now)
        .when(text.contains("Yesterday"), now - F.make_dt_interval(F.lit(1)))
        .when(micros >= FIRST_SECOND * 1_000_000, F.timestamp_micros(micros))
    )
    return F.coalesce(utc_text(moment), F.lit(""))


def wall_clock_text(text: Column) -> Column:
    """The digits of an ISO text relabelled as UTC, without converting."""
    seconds = F.when(F.substring(text, 17, 1) == ":", F.substring(text, 17, 3)).otherwise(
        F.lit(":00")
    )
    return F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 5), seconds, F.lit("+0000")
    )


def display_text(text: Column, zone: str) -> Column:
    """Card date in a named zone; raw text if unreadable, a notice if empty."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), report_instant(text).cast("timestamp_ntz"))
    shown = F.date_format(local, DISPLAY)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("Date unknown")).otherwise(
        F.coalesce(shown, text)
    )
