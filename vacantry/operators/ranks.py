"""Positions of rows in a global order, without a window that holds all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.session import work_dir

_INDEX_BITS = 33  # of monotonically_increasing_id: row number within its partition


def in_order(df: DataFrame, *order: Column | str, mark: str) -> DataFrame:
    """Rows dealt to ranges of the order and sorted within them; ``mark`` rises with the order.

    Equal sort keys land in one range, so add columns that tell rows apart where one key may be very frequent.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .withColumn(mark, F.monotonically_increasing_id()))


def with_position(df: DataFrame, *order: Column | str, name: str = "position", path: str | None = None) -> DataFrame:
    """All rows and their position, from 1, in the given order.

    The rows are written once, range by range, to ``path`` (a new folder in the shared working folder if None) and
    read back: both the counts per range and the positions come from the same stored rows, whatever executors are
    lost between.  The counts are one row per range; their running sums offset the row numbers within the ranges.
    Rows with equal sort keys get different positions in no fixed order.  Nulls sort as in the given order columns.
    """
    spark = df.sparkSession
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the rows have a column {name} already")
    path = path or work_dir(spark, "position")
    ordered = in_order(df, *order, mark=name)
    ordered.write.parquet(path)
    stored = spark.read.schema(ordered.schema).parquet(path)
    part = F.shiftright(F.col(name), _INDEX_BITS)
    before, total = [], 0
    for number, rows in sorted((r[0], r[1]) for r in stored.groupBy(part.alias("range")).agg(F.count("*")).collect()):
        before.append((number, total))
        total += rows
    offsets = spark.createDataFrame(before, "range_number long, range_offset long")
    joined = stored.withColumn("range_number", part).join(F.broadcast(offsets), "range_number")
    index = F.col(name).bitwiseAND((1 << _INDEX_BITS) - 1)
    return joined.select(*[stored[c] for c in df.columns], (index + F.col("range_offset") + 1).alias(name))
