"""Keeping staged columns computed once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_distinct(df: DataFrame, column: str, **made: Column) -> DataFrame:
    """Adds columns that depend on one column only, worked out once per distinct value.

    Values are made distinct map-side first, so a value that most rows share costs one
    evaluation per task; the join back is planned by the size the distinct side turns out
    to have.  NULL is a value like any other.
    """
    values = df.select(F.col(column).alias("_value")).distinct().select(
        "_value", *[expr.alias(name) for name, expr in made.items()])
    same = F.col(column).eqNullSafe(F.col("_value"))
    return df.join(values, same, "left").select(*df.columns, *made)


def computed_once(df: DataFrame, given: Iterable[str] = ()) -> DataFrame:
    """The same rows, with all columns fixed before anything that reads them.

    A filter on a column built in several stages is pushed below the stages by writing
    the whole chain into the predicate, once per reference.  Passing each row through a
    one-element generator keeps such predicates above the chain; unused columns are
    still pruned.  Columns in ``given`` came in as they are and pass beside the
    generator, so that predicates on them still reach the scan.
    """
    beside = set(given)
    made = [F.col(f"`{c}`") for c in df.columns if c not in beside]
    if not made:
        return df
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c in beside],
                     F.explode_outer(F.array(F.struct(*made))).alias("_made"))
    return rows.select(*[F.col(f"`{c}`") if c in beside else F.col(f"_made.`{c}`").alias(c) for c in df.columns])
