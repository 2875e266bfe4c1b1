"""Bounded samples of labelled documents for fitting, and row helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 20_000


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(*names: str) -> list[Column]:
    """Columns by exact name, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None,
                    max_rows: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, label) of at most about ``max_rows`` labelled ids, chosen by a hash of the id.

    Ids without a label are left out; of several labels for one id the larger share wins, 1 on a tie.
    ``where`` restricts the ids.  The chosen ids are at most ``max_rows`` and are sent to every task.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        ids = ids.where(where)
    ids = (ids.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def bounded(df: DataFrame, max_rows: int, *order: str):
    """At most ``max_rows`` rows in a fixed order as pandas; for samples of numbers only."""
    return df.orderBy(F.xxhash64(*order), *order).limit(max_rows).toPandas()
