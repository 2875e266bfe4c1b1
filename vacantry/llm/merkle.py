"""Merkle manifest of a document table by time-forward processing.

Every document is a leaf; per source, runs of ARITY neighbours become their parent until one node, the subroot,
remains, and the subroots of all sources become the root in the same way.  Nodes are labelled so that children
come before their parent: by the last leaf below them, then by level.  Digests travel forward in time as messages
to the parent's label, held in a priority queue until the sweep reaches that label; proofs travel back in a
sweep over the reversed labels, each node sending to its children what lies beside and above them.

The queue is external: Spark's sorted shuffle deals aligned blocks of SPAN leaves to groups, a heap holds the
messages between labels of one block, and messages that leave a block are rows of the next round's table.  A round
lifts three levels, so 10**10 documents take three rounds up and three back.  No group exceeds SPAN rows, whatever
share of the rows one source has; ranks within a source come from positions in one global order.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.llm.scratch import Scratch
from vacantry.operators.ranks import with_position

ARITY = 16
LEVELS = 3  # levels that one round lifts
SPAN = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = ("".join(chr(a + i) for i in range(26)) for a in (65, 97))
_PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(**altered: Column) -> Column:
    """Digest of one document's fields, each with its length in bytes; ``altered`` replaces fields by expressions."""
    values = [altered.get(name, F.col(name)).cast("string") for name in FIELDS]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def folded_case(text: Column | str = "text") -> Column:
    """The text with A-Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _height(total: int) -> int:
    """Levels to lift in a tree of which this level has ``total`` nodes."""
    height = 0
    while total > 1 and height < LEVELS:
        total = -(-total // ARITY)
        height += 1
    return height


def _last(index: int, level: int, n: int) -> int:
    """Last of the block's n nodes below a node."""
    return min((index + 1) * ARITY ** level, n) - 1


def sweep_up(digests: list[str], height: int) -> dict[tuple[int, int], str]:
    """(level, index) to digest for a block's nodes and all above them up to ``height``."""
    n, queue, nodes = len(digests), [], {}
    for i, leaf in enumerate(digests):
        nodes[0, i] = leaf
        if height:
            heapq.heappush(queue, (_last(i // ARITY, 1, n), 1, i // ARITY, i, leaf))
        while queue and queue[0][0] == i:  # all children of the node with the least label have arrived
            _, level, index, _, _ = queue[0]
            parts = []
            while queue and queue[0][1:3] == (level, index):
                parts.append(heapq.heappop(queue)[4])
            nodes[level, index] = _hash(parts)
            if level < height:
                up = index // ARITY
                heapq.heappush(queue, (_last(up, level + 1, n), level + 1, up, index, nodes[level, index]))
    return nodes


def sweep_down(nodes: dict[tuple[int, int], str], n: int, height: int, above: list[tuple[str, str]]):
    """(index, proof) of a block's nodes in descending order; a proof lists what lies left and right, level by level."""
    top = tuple(above)
    queue = [(-_last(0, height, n), -height, 0, top)]
    while queue:
        _, level, index, proof = heapq.heappop(queue)
        level = -level
        if not level:
            yield index, proof
            continue
        first, end = index * ARITY, -(-n // ARITY ** (level - 1))
        children = [nodes[level - 1, i] for i in range(first, min(first + ARITY, end))]
        for k in range(len(children)):
            beside = ("".join(children[:k]), "".join(children[k + 1:]))
            heapq.heappush(queue, (-_last(first + k, level - 1, n), 1 - level, first + k, (beside, *proof)))


def _block() -> Column:
    return F.floor(F.col("idx") / SPAN).cast("long").alias("block")


def _lifted(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("idx")
    total = rows["n"][0].as_py()
    height = _height(total)
    nodes = sweep_up(rows["digest"].to_pylist(), height)
    return pa.table({"tree": rows["tree"][:1], "idx": pa.array([rows["idx"][0].as_py() // SPAN]),
                     "n": pa.array([-(-total // SPAN)]), "digest": pa.array([nodes[height, 0]])})


def climb(leaves: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables of rounds, from the leaves (tree, idx, n, digest) to one row per tree; n is the tree's number of rows."""
    rounds = [leaves]
    while len(rounds) == 1 or (rounds[-1].agg(F.max("n")).first()[0] or 1) > 1:
        lifted = (rounds[-1].select("tree", "idx", "n", "digest", _block()).groupBy("tree", "block")
                  .applyInArrow(_lifted, "tree long, idx long, n long, digest string"))
        rounds.append(scratch.keep(lifted, "round"))
    return rounds


def _lowered(carried: list[str], own: list[str]):
    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        height = _height(rows["n"][0].as_py())
        nodes = sweep_up(rows["digest"].to_pylist(), height)
        given = [(p["left"], p["right"]) for p in above["proof"][0].as_py()]
        index, proofs = zip(*sweep_down(nodes, len(rows), height, given))
        rows = rows.take(pa.array(index))
        ends = [0]
        for p in proofs:
            ends.append(ends[-1] + len(p))
        flat = pa.StructArray.from_arrays([pa.array([x[k] for p in proofs for x in p], pa.string()) for k in (0, 1)],
                                          names=["left", "right"])
        columns = {"tree": rows["tree"], "idx": rows["idx"]} | {c: rows[c] for c in own}
        columns |= {c: pa.chunked_array([pa.array([above[c][0].as_py()] * len(rows), above.schema.field(c).type)])
                    for c in carried}
        return pa.table(columns | {"proof": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)})

    return run


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Proofs of all leaves from those of the trees.

    ``tops`` has (tree, proof) and further columns, which all leaves of the tree get; further columns of the leaves
    are kept.
    """
    carried = [c for c in tops.columns if c not in ("tree", "proof")]
    above = tops.withColumn("idx", F.lit(0).cast("long"))
    for below in rounds[-2::-1]:
        own = [c for c in below.columns if c not in ("tree", "idx", "n", "digest")]
        kinds = [f"{c} {below.schema[c].dataType.simpleString()}" for c in own]
        kinds += [f"{c} {tops.schema[c].dataType.simpleString()}" for c in carried]
        sent = above.select("tree", F.col("idx").alias("block"), "proof", *carried)
        above = (below.withColumn("block", _block()).groupBy("tree", "block").cogroup(sent.groupBy("tree", "block"))
                 .applyInArrow(_lowered(carried, own), ", ".join(["tree long", "idx long", *kinds, f"proof {_PROOF}"])))
    return above


def fold(leaf: Column | str, proof: Column | str) -> Column:
    """Root that a leaf digest and its proof lead to."""
    leaf, proof = (F.col(c) if isinstance(c, str) else c for c in (leaf, proof))
    return F.aggregate(proof, leaf, lambda at, beside: digest(beside["left"], at, beside["right"]))


def proof_digest(proof: Column | str) -> Column:
    """Digest of all siblings of a proof, level by level and left to right."""
    return digest(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""))


def manifest(docs: DataFrame, scratch: Scratch, altered_leaf: Column | None = None) -> DataFrame:
    """(doc_id, leaf, altered, subroot, root, proof) for every row of ``docs``, which has the columns of FIELDS.

    ``altered`` is the digest that ``altered_leaf`` gives for the row, or the leaf where that is null.  Per source,
    leaves ascend by doc_id (nulls first), rows of one doc_id by their digest; sources ascend by their bytes, null
    first.  Repeated rows are leaves of their own and give rows of their own; a null or empty text is a field like
    any other; long texts are hashed whole by Spark.  Other columns are ignored.  An empty table has no rows.
    """
    leaf = leaf_digest()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf.alias("digest"),
                       (F.lit(None).cast("string") if altered_leaf is None else altered_leaf).alias("altered"))
    rows = with_position(rows, F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "digest", name="at",
                         path=f"{scratch.root}/000-ordered")
    sources = scratch.keep(rows.groupBy("source").agg(F.min("at").alias("tree"), F.count("*").alias("n")), "sources")
    leaves = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(
        "tree", (F.col("at") - F.col("tree")).alias("idx"), "n", "digest", "doc_id", F.col("digest").alias("leaf"), "altered")
    leaves = scratch.keep(leaves, "leaves")
    rounds = climb(leaves, scratch)

    roots = with_position(rounds[-1].select(F.col("tree").alias("source_tree"), "digest"), "source_tree", name="at",
                          path=f"{scratch.root}/000-subroots")
    total = sources.count()
    subroots = roots.select(F.lit(0).cast("long").alias("tree"), (F.col("at") - 1).alias("idx"),
                            F.lit(total).cast("long").alias("n"), "digest", "source_tree", F.col("digest").alias("subroot"))
    upper = climb(scratch.keep(subroots, "subroots"), scratch)
    root = upper[-1].first()
    top = docs.sparkSession.createDataFrame([(0, [])] if root else [], f"tree long, proof {_PROOF}")
    tops = descend(upper, top).select(F.col("source_tree").alias("tree"), "subroot", "proof")
    return descend(rounds, scratch.keep(tops, "tops")).select(
        "doc_id", "leaf", F.coalesce("altered", "leaf").alias("altered"), "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"), "proof")
