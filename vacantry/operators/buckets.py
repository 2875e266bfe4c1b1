"""Keyed tables stored by a hash of the key, so that a small update reads and writes the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from vacantry.session import work_dir

BUCKET = "_bucket"


class BucketedTable:
    """A parquet table partitioned by a hash of its key columns; NULL keys have a bucket like any others."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        (rows.select(*self.schema.names, self.bucket().alias(BUCKET)).repartition(self.buckets, BUCKET)
         .write.partitionBy(BUCKET).parquet(self.path))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; other buckets' files are not even listed for reading."""
        stored = StructType(list(self.schema.fields)).add(BUCKET, IntegerType())
        rows = self.spark.read.schema(stored).parquet(self.path)
        return (rows if buckets is None else rows.filter(F.col(BUCKET).isin(buckets))).select(*self.schema.names)

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets of the changes; at most ``buckets`` numbers."""
        return sorted(r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect())

    def merge(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the rows of the touched buckets by ``how(stored rows, changes)``; returns those buckets.

        The merged rows are written aside first, then each touched bucket is overwritten whole.  A run that is cut off
        leaves whole buckets, old or new; running the same merge again finishes it if ``how`` gives the same rows when
        its changes are applied twice, as upserts do.
        """
        buckets = self.touched(changes)
        if not buckets:
            return buckets
        aside = work_dir(self.spark, "merge")
        merged = how(self.read(buckets), changes).select(*self.schema.names, self.bucket().alias(BUCKET))
        merged.repartition(len(buckets), BUCKET).write.parquet(aside)
        staged = self.spark.read.schema(merged.schema).parquet(aside)
        staged.repartition(len(buckets), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            BUCKET).parquet(self.path)
        full = {r[0] for r in staged.select(BUCKET).distinct().collect()}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for bucket in set(buckets) - full:  # no row is left there, so nothing was written over it
            fs.delete(hadoop.Path(f"{self.path}/{BUCKET}={bucket}"), True)
        fs.delete(hadoop.Path(aside), True)
        return buckets
