"""Connected components of an edge table, by alternating star contractions; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantry.llm.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours of each node to the smallest of them and the node itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:  # smaller neighbours only
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    out = both.join(least, "a")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            least.select("a", F.col("low").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its smallest node.

    Repeated edges and edges of a node with itself change nothing.  Each round is a written table; rounds
    grow with the logarithm of the longest chain.
    """
    state = None
    table = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    table = scratch.keep(table, "edges")
    while True:
        after = scratch.keep(_star(_star(table, large=True), large=False), "edges")
        now = after.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        scratch.drop(table)
        table = after
        if now == state:
            break
        state = now
    member = table.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return member.union(table.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
