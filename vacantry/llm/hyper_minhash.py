"""Near duplicates by HyperMinHash: compressed registers are banded, compared, and candidates verified exactly.

A set's shingles are dealt to buckets by a hash; each bucket keeps its least remaining hash as a floating-point
number, the count of leading zeros and MANTISSA bits after the first one: 16 bits a register, whatever the set's
size.  Small sets would leave buckets empty, so they use fewer buckets and more hash functions, REGISTERS in all;
linked sets differ in size by a quarter at most, so a set near the next size class is entered in both.  Every BAND
registers make a band, nodes with an equal band meet, and pairs whose Jaccard estimate, corrected for registers that
agree by chance, is far below the bound drop out, as do pairs that the parity bits of their sets keep apart.  Whole
sets decide.

A pair at similarity 0.8 shares none of the 40 bands with probability (1 - 0.8**4)**40 < 1e-9, and fails the
estimate (81 registers, bound 0.42) with probability below 1e-10; more similar pairs do so still less.  Equal sets are
one node.  Bands list one node against one chosen member, links are contracted to components, and only pairs of
different components meet after that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantry.llm.blocks import LOWER, blocks, mix
from vacantry.llm.candidates import collapsed, cross_pairs, labelled, star_pairs
from vacantry.llm.components import components
from vacantry.llm.scratch import Scratch
from vacantry.llm.shingle_join import (DENOM, NUMER, PARITY, nodes_of, parity_condition, shingle_sets, text_key, verify,
                                        whole_sets)

SHINGLE = 4
REGISTERS, BAND = 160, 4
MANTISSA = 10  # bits
MOST_BUCKETS = 32
LOAD = 8  # shingles per bucket at least, where there is more than one
COMPARED = 81  # registers that the estimate looks at
BOUND = 0.42  # estimates below cannot come from linked sets
SKETCH = [f"r{i}" for i in range(COMPARED // 3)]  # three registers a column, 20 bits each
_LEAST = 4  # smaller sets link with equal ones only


def buckets_of(n: np.ndarray) -> np.ndarray:
    """Buckets that a set of n shingles is dealt to: a power of two."""
    load = np.clip(n // LOAD, 1, MOST_BUCKETS)
    return 1 << np.floor(np.log2(load)).astype(np.int64)


def compressed(least: np.ndarray) -> np.ndarray:
    """16-bit registers of the least 53-bit hash per bucket: leading zeros, then mantissa bits; 0 for an empty bucket."""
    empty = least == np.uint64(1 << 53)
    fraction, exponent = np.frexp(np.where(empty, 0, least).astype(np.float64))
    zeros = (53 - exponent).astype(np.int64)
    mantissa = np.floor((np.maximum(2 * fraction, 1) - 1) * (1 << MANTISSA)).astype(np.int64)
    return np.where(empty, 0, (zeros << MANTISSA) + mantissa + 1).astype(np.uint16)


def registers(owner: np.ndarray, shingle: np.ndarray, n_sets: int, buckets: int) -> np.ndarray:
    """(set, REGISTERS) compressed registers of sets given as (owner, shingle)."""
    out = np.empty((n_sets, REGISTERS), dtype=np.uint16)
    for k in range(REGISTERS // buckets):
        hashed = mix(shingle ^ mix(np.full(1, 977 * k + 1, dtype=np.uint64)))
        least = np.full(n_sets * buckets, 1 << 53, dtype=np.uint64)
        np.minimum.at(least, owner * buckets + (hashed % np.uint64(buckets)).astype(np.int64), hashed >> np.uint64(11))
        out[:, k * buckets:(k + 1) * buckets] = compressed(least).reshape(n_sets, buckets)
    return out


def bands(sketch: np.ndarray, buckets: int) -> np.ndarray:
    """64-bit keys of the bands of each sketch; bands of other places or numbers of buckets have other keys."""
    words = np.ascontiguousarray(sketch).view(np.uint64)
    place = np.arange(words.shape[1], dtype=np.uint64) + np.uint64(1000 * buckets)
    return mix(mix(words) + place * np.uint64(0x9E3779B97F4A7C15))


def estimate_condition(least: float = BOUND) -> str:
    """SQL: the share of equal registers of r* and r*_b, less those equal by chance, reaches ``least``.

    Two registers of different minima agree in their leading zeros with probability 1/3 and then in the mantissa with
    2**-MANTISSA.
    """
    chance = 2.0 ** -MANTISSA / 3
    ones, carry = (sum(x << 20 * i for i in range(3)) for x in (0xFFFF, 0x10000))
    differ = " + ".join(f"bit_count((({r} ^ {r}_b) + {ones}L) & {carry}L)" for r in SKETCH)
    return f"({COMPARED} - ({differ})) / {COMPARED}D - {chance}D >= {least}D * (1 - {chance}D)"


def packed(sketch: np.ndarray) -> np.ndarray:
    """The first COMPARED registers of each sketch as the columns of SKETCH."""
    lanes = sketch[:, :COMPARED].astype(np.int64).reshape(len(sketch), len(SKETCH), 3)
    return lanes[:, :, 0] | lanes[:, :, 1] << 20 | lanes[:, :, 2] << 40


def _sketched(size: int):
    """Entries (sig, node, n, other) of every text's set; ``other`` marks those for the next size class."""
    def run(batches):
        for batch in batches:
            for _, block in blocks(batch, "text", LOWER):
                text, shingle, n, node = shingle_sets(block, size)
                _, first = np.unique(node, return_index=True)
                fresh = np.zeros(block.n, dtype=bool)
                fresh[first] = True
                own, over = buckets_of(n), buckets_of(DENOM * n // NUMER)
                for buckets in np.unique(np.concatenate([own, over])):
                    for more, chosen in ((False, own == buckets), (True, (over == buckets) & (over != own))):
                        mine = np.flatnonzero(chosen & fresh & (n >= _LEAST))
                        if not len(mine):
                            continue
                        place = np.full(block.n, -1)
                        place[mine] = np.arange(len(mine))
                        here = place[text]
                        sketch = registers(here[here >= 0], shingle[here >= 0], len(mine), int(buckets))
                        columns = [pa.array(node[mine]), pa.array(n[mine].astype(np.int64)),
                                   pa.array(np.full(len(mine), more))]
                        ends = pa.array((np.arange(len(mine) + 1) * (REGISTERS // BAND)).astype(np.int32))
                        keys = bands(sketch, int(buckets)).view(np.int64).ravel()
                        columns.append(pa.ListArray.from_arrays(ends, pa.array(keys)))
                        columns += [pa.array(c) for c in packed(sketch).T.copy()]
                        yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "next", "bands", *SKETCH])

    return run


_SKETCHED = "node long, n long, next boolean, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Sets of ``size``-word shingles link at a Jaccard similarity of 0.8 or more.  ``component_id`` is the smallest
    doc_id reachable by links, null only if every id there is null; ``kept`` marks the rows with that id, so rows that
    repeat it are all kept, as are rows alone without an id.  A null or empty text has no shingles and only itself;
    one with fewer words has its whole sequence as its shingle.  Texts are read whole, and memory is a multiple of
    the longest.  Sets are compared as 64-bit hashes.  An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    rows = scratch.keep(nodes_of(docs, size), "rows")
    sketched = docs.mapInArrow(_sketched(size), _SKETCHED).dropDuplicates(["node", "next"])
    sketched = scratch.keep(sketched, "sketches")

    entries = sketched.select("node", "next", "n", F.explode("bands").alias("sig"))
    index = scratch.keep(collapsed(entries), "index")
    near = f"{NUMER} * greatest(n, n_b) <= {DENOM} * least(n, n_b)"

    wanted = index.select("node").distinct()
    keys = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key").distinct()
    texts = docs.select("text", text_key().alias("key")).join(keys, "key", "left_semi")
    sets = scratch.keep(whole_sets(texts, size), "sets")
    # the member that meets most others, as the original of many copies does, is compared first
    central = index.groupBy("node").agg(F.sum("rows").alias("met"))
    order = [-F.col("met"), F.xxhash64("node")]
    links = scratch.keep(verify(star_pairs(labelled(index, None).join(central, "node"), order, near), sets), "links")
    member = scratch.keep(components(links, scratch), "member")

    parity = sets.select("node", *PARITY).dropDuplicates(["node"])
    pairs = cross_pairs(labelled(index, member), sketched.drop("n", "bands").join(parity, "node"), scratch,
                        f"{near} AND {parity_condition()} AND {estimate_condition()}")
    links = links.union(scratch.keep(verify(pairs, sets), "links"))
    member = scratch.keep(components(links, scratch), "member")

    group = F.when(F.col("n") > 0, F.coalesce("component", "node"))
    out = scratch.keep(rows.join(member, "node", "left").select("doc_id", "n", group.alias("component")), "grouped")
    low = out.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    low = scratch.keep(low, "low")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.join(low, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))
