"""Amounts and annual equivalents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantry.functions.text import literal_map
from vacantry.lexicon import PERIOD_FACTORS, PERIOD_NOTES, SYMBOL_CURRENCY


def parse_amount(c: Column) -> Column:
    """Number in pay text: separators dropped, trailing k means thousands.

    A dot before exactly three digits separates thousands; any other dot is decimal.
    """
    text = F.trim(c)
    kilo = text.rlike("[kK]$")
    body = F.trim(F.regexp_replace(text, "[kK]$", ""))
    body = F.regexp_replace(body, r"[,'’\s]", "")
    body = F.regexp_replace(body, r"\.(?=\d{3}(?:\D|$))", "")
    number = F.regexp_extract(body, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")
    return F.when(kilo, number * 1000).otherwise(number)


def plain_amount(c: Column) -> Column:
    """Number with commas only, NULL when anything else is in the way."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def currency_of(symbol: Column) -> Column:
    return literal_map(SYMBOL_CURRENCY)[F.upper(symbol)]


def annual_factor(period: Column) -> Column:
    return literal_map({k: float(v) for k, v in PERIOD_FACTORS.items()})[
        F.coalesce(period, F.lit("year"))]


def annualize(amount: Column, period: Column) -> Column:
    return amount * annual_factor(period)


def annual_note(period: Column) -> Column:
    return F.coalesce(literal_map(PERIOD_NOTES)[F.coalesce(period, F.lit("year"))],
                      F.lit("unknown period; not annualized"))
