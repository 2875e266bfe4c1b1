"""SQLite files as a Spark data source: a folder of files, read in ranges of rows, with filters pushed down.

SQLite opens local paths only, so the folder must lie on a file system that every task sees as a path, such as a
mounted shared folder.  One partition reads one range of row ids of one file; comparisons of columns with literals
become its WHERE clause, and only wanted columns are read.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

RANGE_ROWS = 100_000
_OPERATORS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local_path(path: str) -> str:
    """The path without its file scheme; other file systems have no SQLite."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"SQLite files need a mounted path, not {path}")
    return parsed.path if parsed.scheme else path


class SqliteRange(ds.InputPartition):
    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class SqliteReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.path, self.table = local_path(options["path"]), options["table"]
        self.rows = int(options.get("rangerows", RANGE_ROWS))
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes comparisons, IN lists and NULL tests of top-level columns; gives back all others."""
        for f in filters:
            name = _quote(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and type(f) in _OPERATORS and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.where.append((f"{name} {_OPERATORS[type(f)]} ?", [f.value]))
            elif name and isinstance(f, ds.In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.where.append((f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif name and isinstance(f, (ds.IsNull, ds.IsNotNull)):
                self.where.append((f"{name} IS {'NOT ' * isinstance(f, ds.IsNotNull)}NULL", []))
            else:
                yield f

    def _open(self, file: str) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{file}?mode=ro", uri=True)

    def partitions(self) -> list[SqliteRange]:
        files = ([os.path.join(self.path, f) for f in sorted(os.listdir(self.path)) if f.endswith((".sqlite", ".db"))]
                 if os.path.isdir(self.path) else [self.path])
        out = []
        for file in files:
            with self._open(file) as con:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quote(self.table)}").fetchone()
            if low is not None:
                out += [SqliteRange(file, at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]
        return out or [SqliteRange("", 0, -1)]

    def read(self, partition: SqliteRange) -> Iterator[tuple]:
        if not partition.file:
            return
        names = ", ".join(_quote(f.name) for f in self.schema) or "1"
        tests = ["rowid BETWEEN ? AND ?", *[w for w, _ in self.where]]
        values = [partition.low, partition.high, *[v for _, given in self.where for v in given]]
        con = self._open(partition.file)
        try:
            yield from con.execute(f"SELECT {names} FROM {_quote(self.table)} WHERE {' AND '.join(tests)}", values)
        finally:
            con.close()


class SqliteSource(ds.DataSource):
    """``spark.read.format("sqlite")`` with a schema and the options path, table and rangeRows."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | StructType, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows of one table of a SQLite file, or of all files of a folder; columns have SQLite's integer, real and text types."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").schema(schema).options(table=table, rangeRows=range_rows).load(path)


def write_sqlite(df: DataFrame, path: str, table: str) -> int:
    """Writes each partition as a SQLite file of its own into a mounted folder and returns the number of files.

    A file gets its final name when it is complete, so a task that runs again leaves the same files.
    """
    folder, columns = local_path(path), df.columns
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        final = os.path.join(folder, f"part-{context.partitionId():05d}.sqlite")
        draft = f"{final}.{context.taskAttemptId()}"
        con = sqlite3.connect(draft)
        con.execute(f"CREATE TABLE {_quote(table)} ({', '.join(map(_quote, columns))})")
        insert = f"INSERT INTO {_quote(table)} VALUES ({', '.join('?' * len(columns))})"
        for batch in batches:
            con.executemany(insert, zip(*(c.to_pylist() for c in batch.columns)))
        con.commit()
        con.close()
        os.replace(draft, final)
        yield pa.RecordBatch.from_pylist([{"file": final}])

    return df.mapInArrow(run, "file string").count()
