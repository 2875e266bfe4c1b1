"""Unicode compatibility folding, which Spark has no expression for: ligatures, full-width and combining forms."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MARKS = re.compile("[̀-ͯ]")


@F.pandas_udf(StringType())
def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


def compatible(c: Column) -> Column:
    """The compatibility decomposition; ASCII values pass as they are and the vectorized pass sees NULL for them.

    Meant for distinct values (see ``staging.by_distinct``), as every value with other characters goes to Python.
    """
    odd = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_decomposed(odd), c)


def without_marks(c: Column) -> Column:
    """Decomposed text without its combining marks."""
    return F.regexp_replace(c, "[\\u0300-\\u036f]", "")
