"""Candidate pairs from index lists: each pair once, and no pair inside a component that is known already.

An index has rows (sig, node, ...): every node stands in some lists, and nodes that may link share a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.llm.scratch import Scratch

LOW_LISTS = 8  # smallest lists of a node that its entries carry


def collapsed(index: DataFrame) -> DataFrame:
    """The index without lists of one node and, of lists with the same nodes, with only the smallest; ``rows`` is added.

    Lists are compared by their length and a 128-bit sum of hashed nodes.  ``rows`` is the length of the list.
    """
    lists = index.groupBy("sig").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                     F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    keep = lists.where("rows > 1").groupBy("rows", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "rows")
    return index.join(keep, "sig")


def star_pairs(index: DataFrame, order: list[Column], near: str | None = None) -> DataFrame:
    """(a, b): at most one pair per node, with the chosen member it shares most lists with, if in another component.

    ``index`` has (sig, node, component, ...); the member of a list that comes first in ``order`` is chosen.  ``near``
    is a condition on the columns of a node and, with the suffix _b, of the chosen member.
    """
    rest = [c for c in index.columns if c != "sig"]
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("node").alias("node"),
                   *[F.col(c).alias(f"{c}_b") for c in rest])
    chosen = index.groupBy("sig").agg(F.min(key).alias("p"), F.count("*").alias("rows")).where("rows > 1").select(
        "sig", *[f"p.{c}_b" for c in rest])
    pairs = index.join(chosen, "sig").where("component <> component_b").where(near or "true")
    pairs = pairs.groupBy("node", "node_b").agg(F.count("*").alias("lists"))
    return (pairs.groupBy("node").agg(F.max(F.struct("lists", "node_b")).alias("best"))
            .select(F.col("node").alias("a"), F.col("best.node_b").alias("b")))


def cross_pairs(index: DataFrame, sketches: DataFrame, scratch: Scratch, near: str) -> DataFrame:
    """(a, b): all pairs of one list in different components that meet the condition ``near``.

    At least one of the two is outside the list's largest component.  ``sketches`` has one row per node, or per value of
    the columns it shares with the index, and further columns for the condition; those of the second node have the
    suffix _b.  A pair is made at the first
    list both share, as far as the LOW_LISTS smallest lists of each tell.
    """
    parts = index.groupBy("sig", "component").agg(F.count("*").alias("rows"))
    mixed = (parts.groupBy("sig").agg(F.count("*").alias("parts"), F.max(F.struct("rows", "component")).alias("top"))
             .where("parts > 1").select("sig", F.col("top.component").alias("major")))
    left = collapsed(index.drop("rows").join(mixed, "sig")).drop("rows")
    left = scratch.keep(left, "mixed")
    low = left.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, LOW_LISTS).alias("low"))
    keys = [c for c in sketches.columns if c in left.columns]
    wide = scratch.keep(left.join(low, "node").join(sketches, keys), "entries")
    minor = wide.where("component <> major")
    every = wide.select("sig", *[F.col(c).alias(f"{c}_b") for c in wide.columns if c != "sig"])
    out = (minor.join(every, "sig").where("component <> component_b AND (component_b = major_b OR node < node_b)")
           .where(near).where("coalesce(array_min(array_intersect(low, low_b)), sig) >= sig"))
    return out.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct()


def labelled(index: DataFrame, member: DataFrame | None) -> DataFrame:
    """The index with the component of each node, itself where ``member`` (node, component) has none."""
    if member is None:
        return index.withColumn("component", F.col("node"))
    return index.join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
