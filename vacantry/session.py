"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("vacantry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


MADE: list[str] = []  # working folders of this process


def clean_work(spark: SparkSession) -> int:
    """Deletes the working folders this process has made and returns their number.

    For the end of a run, when no result that reads them is needed any more.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    gone = 0
    while MADE:
        path = hadoop.Path(MADE.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def work_dir(spark: SparkSession, name: str) -> str:
    """New folder for one run under the cluster's shared checkpoint folder.

    That folder is named by ``spark.checkpoint.dir``.  Where it is unset a local session,
    as in tests, uses its warehouse folder; on a cluster it is an error, as executors
    cannot see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    MADE.append(os.path.join(root, f"vacantry-{name}-{uuid.uuid4().hex}"))
    return MADE[-1]
