"""Shared parts of the streaming jobs: reading, idempotent batch output, reading back.

Each micro-batch overwrites its own ``batch=N`` folder, so a replayed batch after a lost
executor or driver leaves the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType


def read_files(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.parquet",
               files_per_batch: int | None = None) -> DataFrame:
    """Stream over the parquet files of a folder, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None],
                  mode: str = "update") -> StreamingQuery:
    """Processes everything available, then stops; the checkpoint remembers what was read."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(on_batch)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def batch_writer(out: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write


def read_batches(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """All batches written so far with their number in column ``batch``."""
    full = StructType(list(schema.fields)).add("batch", LongType())
    return spark.read.schema(full).parquet(out)
