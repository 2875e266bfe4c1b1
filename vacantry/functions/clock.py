"""Timestamps in either stored shape, and posting age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantry.functions.text import half_up

RELATIVE = r"(?i)(\d+)\s*(minute|hour|day|week|month)s?\s*ago"
UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}
DAY_SECONDS = 86400.0


def as_timestamp(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def parse_timestamp(c: Column) -> Column:
    """Either ``YYYY-MM-DD HH:MM:SS`` or ISO ``…T…Z``; NULL when neither."""
    return F.try_to_timestamp(c)


def seconds(c: Column) -> Column:
    return F.unix_micros(c) / F.lit(1_000_000.0)


def age_days(as_of: str | Column, then: Column) -> Column:
    """Whole days between two instants, rounded half up."""
    return half_up((seconds(as_timestamp(as_of)) - seconds(then)) / F.lit(DAY_SECONDS))


def posting_age(posted_text: Column, created_at: Column, as_of: str | Column) -> Column:
    """Struct (age_days, method, created_age_days) from the best dating signal.

    An ISO date wins, then relative text anchored at the time it was scraped, then
    "yesterday"; otherwise the posting has no age of its own.
    """
    iso = F.when(posted_text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(posted_text))
    count = F.regexp_extract(posted_text, RELATIVE, 1)
    unit = F.lower(F.regexp_extract(posted_text, RELATIVE, 2))
    span = F.lit(None).cast("double")
    for name, secs in UNIT_SECONDS.items():
        span = F.when(unit == name, count.try_cast("double") * secs).otherwise(span)
    asof = seconds(as_timestamp(as_of))
    created = seconds(created_at)
    by_iso = iso.isNotNull()
    by_relative = posted_text.rlike(RELATIVE)
    by_yesterday = posted_text.rlike("(?i)yesterday")
    posted = (
        F.when(by_iso, seconds(iso))
        .when(by_relative, created - span)
        .when(by_yesterday, created - F.lit(DAY_SECONDS))
    )
    method = (
        F.when(by_iso, F.lit("posting_date_iso"))
        .when(by_relative, F.concat(F.lit("relative_"), unit))
        .when(by_yesterday, F.lit("yesterday"))
        .otherwise(F.lit("no_signal"))
    )
    return F.struct(
        half_up((asof - posted) / F.lit(DAY_SECONDS)).alias("age_days"),
        method.alias("method"),
        half_up((asof - created) / F.lit(DAY_SECONDS)).alias("created_age_days"),
    )
