"""Tables that micro-batches change: a base and the changes since, merged when read.

Batch N overwrites its own ``delta/batch=N`` folder, so a replay leaves the same files.  Every ``every`` batches the
base and the changes are merged into a new base; reading takes the newest base and the changes after it, so the
number of folders read stays below ``every`` + 1 however long the stream runs.  The base before the newest and the
changes since it are kept, so that a batch that is replayed after its compaction finds what it read before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from vacantry.operators.fetchlog import join_back

EVERY = 10
BUCKET = "_bucket"


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps the row of the latest batch for each key."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys and c != "batch"]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")

    return merge


def newest_group(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps, for each key, all rows of the latest batch that has any; keys may be NULL."""
    def merge(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*keys).agg(F.max("batch").alias("_last"))
        return join_back(rows, last, keys).filter("batch = _last").drop("batch", "_last")

    return merge


def totals(keys: list[str], **sums) -> Callable[[DataFrame], DataFrame]:
    """Merge by aggregates, each of which can be applied to its own results."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[agg.alias(name) for name, agg in sums.items()])

    return merge


class DeltaTable:
    """A stored table of ``schema`` below ``path``; ``merge`` makes its rows of those of all batches.

    With ``buckets`` rows are stored by a hash of ``bucket_by``, and ``current`` can read chosen buckets only.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, merge: Callable[[DataFrame], DataFrame],
                 every: int = EVERY, bucket_by: list[str] | None = None, buckets: int = 32):
        self.spark, self.path, self.schema, self.merge, self.every = spark, path, schema, merge, every
        self.bucket_by, self.buckets = bucket_by, buckets

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the completely written folders of one kind."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName().partition("=")[2]) for p in names if "=" in p.getName() and fs.exists(hadoop.Path(p, "_SUCCESS")))

    def bucket(self):
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def folders(self, before: int | None = None) -> tuple[int | None, list[int]]:
        """Number of the base and of the changes that make up the table before a batch."""
        limit = (1 << 62) if before is None else before
        base = max((n for n in self._numbers("base") if n < limit), default=None)
        return base, [n for n in self._numbers("delta") if n < limit and (base is None or n > base)]

    def current(self, before: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        base, deltas = self.folders(before)
        full = StructType(list(self.schema.fields)).add("batch", LongType())
        kinds = ([("base", base)] if base is not None else []) + [("delta", n) for n in deltas]
        stored = StructType(list(self.schema.fields))
        if self.bucket_by:
            stored = stored.add(BUCKET, IntegerType())
        out = self.spark.createDataFrame([], full)
        for kind, n in kinds:
            rows = self.spark.read.schema(stored).parquet(f"{self.path}/{kind}/batch={n}")
            if self.bucket_by:
                if buckets is not None:
                    rows = rows.filter(F.col(BUCKET).isin(list(buckets)))
                rows = rows.drop(BUCKET)
            out = out.unionByName(rows.withColumn("batch", F.lit(n).cast("long")))
        return self.merge(out).select(*self.schema.names)

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows = rows.select(*self.schema.names)
        if self.bucket_by:
            rows.withColumn(BUCKET, self.bucket()).write.mode("overwrite").partitionBy(BUCKET).parquet(
                f"{self.path}/{kind}/batch={batch}")
        else:
            rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Stores the changes of a batch and, every ``every`` batches, a new base."""
        self._write(rows, "delta", batch)
        if batch % self.every == self.every - 1:
            self.compact(batch)

    def compact(self, batch: int) -> None:
        """Writes the base of everything up to the batch and removes what only older bases need."""
        previous = max((n for n in self._numbers("base") if n < batch), default=-1)
        base, deltas = self.folders(batch)
        if base is None and not deltas and batch not in self._numbers("delta"):
            return
        self._base_of(batch)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for kind, old in (("base", [n for n in self._numbers("base") if n < previous]),
                          ("delta", [n for n in self._numbers("delta") if n <= previous])):
            for n in old:
                fs.delete(hadoop.Path(f"{self.path}/{kind}/batch={n}"), True)

    def _base_of(self, batch: int) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/base/batch={batch}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)  # left by a run that was cut off
        self._write(self.current(batch + 1), "base", batch)
