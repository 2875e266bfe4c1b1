"""Content-derived keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(c: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, size)


def number_text(c: Column) -> Column:
    """Shortest decimal text: 50000.0 is written 50000, NULL is empty."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    text = F.when(whole, c.cast("decimal(18,0)").cast("string")).otherwise(c.cast("string"))
    return F.coalesce(text, F.lit(""))


def _joined(*cols: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cols])


def observation_id(currency, amount_min, amount_max, amount_median, period, data_source,
                   data_source_url, country_code, region, city) -> Column:
    return short_hash(_joined(
        F.upper(currency), number_text(amount_min), number_text(amount_max),
        number_text(amount_median), F.lower(period), F.lower(data_source), data_source_url,
        F.upper(country_code), F.lower(region), F.lower(city)))


def series_id(normalized_title, seniority, industry, country_code, region, city,
              compensation_type, period) -> Column:
    def default(c, text):
        return F.lower(F.coalesce(F.when(c != "", c), F.lit(text)))

    return short_hash(_joined(
        F.lower(normalized_title), default(seniority, "_any"), default(industry, "_any"),
        F.upper(country_code), F.lower(region), F.lower(city),
        default(compensation_type, "unknown"), default(period, "year")))


def canonical_json(c: Column) -> Column:
    """JSON text with keys sorted at every level; the raw text when it is not JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def payload_hash(c: Column) -> Column:
    return short_hash(canonical_json(c))


def benchmark_id(series: Column, payload: Column, fetched_at: Column) -> Column:
    stamp = F.date_format(fetched_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return short_hash(_joined(series, payload, stamp))


def url_job_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 20)


def fingerprint(*cols: Column) -> Column:
    """Hash of a request or profile given as columns."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def multiset_digest(row_hash: Column) -> Column:
    """Aggregate: one hash for a set of rows, whatever their order or partitioning.

    Four 60-bit slices of each row's SHA-256 are summed exactly, so rows are combined
    map-side and no task ever holds the whole set.
    """
    slices = [
        F.sum(F.conv(F.substring(row_hash, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
        for i in range(4)
    ]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"),
                              *[s.cast("string") for s in slices]), 256)
