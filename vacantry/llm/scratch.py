"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from vacantry.session import MADE


class Scratch:
    """Tables written once and read again: cuts lineage, and a lost executor costs only its tasks.

    They lie in a new folder below ``spark.checkpoint.dir``.  Where that is unset the session must be
    local, as in tests, and the Spark warehouse folder takes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = (spark.conf.get("spark.checkpoint.dir", None)
                or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = spark.conf.get("spark.sql.warehouse.dir")
        self.spark = spark
        self.root = f"{root.rstrip('/')}/text-{name}-{uuid.uuid4().hex}"
        MADE.append(self.root)  # so that clean_work() finds it
        self._n = 0

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Writes the rows and returns them as read back; frees the shuffle files behind them."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        schema = df.schema
        del df
        self.free()
        return self.spark.read.schema(schema).parquet(path)

    def free(self) -> None:
        """Lets Spark's cleaner remove shuffle files of frames that are no longer in use."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Deletes a kept table that nothing will read again."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
