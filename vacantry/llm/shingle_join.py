"""Near duplicates: an exact Jaccard join of word-shingle sets with token-combination prefixes.

1. Every text becomes the set of its distinct shingles (64-bit hashes).  Equal sets are one node.
2. Two sets that link share many of their smallest shingles by hash.  Only that part of each set is dealt
   out by shingle, and a node that shares too few of them with other nodes has no partner.  Shingles that very
   many texts hold, found in a bounded sample, are dealt out by node instead.
3. The whole sets of the nodes left are dealt out to count in how many nodes each shingle occurs.  Shared
   shingles are ordered from rare to frequent.  Rare ones are indexed singly, frequent ones in pairs or
   triples taken within small groups; the prefix is extended until a partner must share at least one index
   entry.  A pair whose sizes or numbers of shared shingles rule the similarity out never meets.
4. Within an index list each node is verified against one chosen member, links are contracted to
   components, and only pairs of different components are verified after that.  A large group of near
   copies thus costs about as many comparisons as it has members, and no link between components is missed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantry.llm.blocks import LOWER, NOT_SPACE, Block, blocks, join_hashes, keyed, mix, windows
from vacantry.llm.candidates import collapsed, cross_pairs, labelled, star_pairs
from vacantry.llm.components import components
from vacantry.llm.labelled import fresh, quoted
from vacantry.llm.scratch import Scratch

SHINGLE = 5
NUMER, DENOM = 4, 5  # similarity 0.8 as a fraction
EXTRA_PERCENT = 15  # shared shingles asked for in the hash-ordered part, as a share of the set
BLOCK_SHINGLES = 1 << 18
CLASS_LIMITS = (64, 4096)  # node counts up to which a shingle is indexed singly, in pairs; triples above
_LOW56 = np.uint64((1 << 56) - 1)
PART_SHINGLES = 4 << 20  # shingles of all sets per part that they are dealt to
HOT_NODES = 16_384  # nodes with a shingle from which on it is not gathered; above the last class limit
HOT_SHARE = 500  # ... and at least every so many-th
HOT_SAMPLE = 10_000  # texts that the hot shingles are looked for in
_VERY_MANY = 1 << 40


def shingle_sets(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order: (text of each, shingle, set size, node).

    A text of fewer than ``size`` words has its whole sequence as its one shingle; one without words has
    none and node 0.  The node is a 64-bit hash of the set.
    """
    starts, ends = block.edges(NOT_SPACE)
    bounds = block.bounds(starts)
    hashes = block.hashes(starts, ends)
    text, _, shingle = windows(hashes, bounds, size)
    for k in range(1, size):
        short = np.flatnonzero(np.diff(bounds) == k)
        text = np.concatenate([text, short])
        shingle = np.concatenate([shingle, join_hashes(hashes, bounds[short], k)])
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    text, shingle = text[new], shingle[new]
    n = np.bincount(text, minlength=block.n)
    total = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(mix(shingle + np.uint64(1)), out=total[1:])
    at = np.concatenate([[0], np.cumsum(n)])
    node = mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64)
    node[n == 0] = 0
    return text, shingle, n, node


def least_common(n):
    """Smallest intersection that a set of n shingles has with any partner."""
    return (NUMER * n + DENOM - 1) // DENOM


def _extra(n):
    return np.maximum(1, EXTRA_PERCENT * n // 100)


def least_shared(n):
    """Shared shingles that a linked set of n has at least in its hash-ordered part."""
    return _extra(least_common(n))


def _size_classes(top: int = 1 << 40) -> np.ndarray:
    """First size of each class; linked sets are at most one class apart."""
    out = [1]
    while out[-1] < top:
        out.append(DENOM * out[-1] // NUMER + 1)
    return np.array(out)


SIZE_CLASS = _size_classes()


def nodes_of(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, key, hash, n, node) of every row; ``hash`` is of the text, ``key`` the id or else the hash."""
    def run(batches):
        for batch in batches:
            for rows, block in blocks(batch, "text", LOWER):
                _, _, n, node = shingle_sets(block, size)
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(n.astype(np.int64)), pa.array(node)],
                    names=["doc_id", "key", "hash", "n", "node"])

    return docs.select("doc_id", text_key().alias("key"), _hash().alias("hash"), "text").mapInArrow(
        run, "doc_id long, key long, hash long, n long, node long")


def _hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def text_key():
    return F.coalesce(F.col("doc_id"), _hash())


_DEALT = "bucket int, nodes binary, sizes binary, owners binary, tokens binary"


def hot_shingles(docs: DataFrame, n_rows: int, size: int) -> np.ndarray:
    """Shingles (56 bits, ascending) that very many texts hold, by a sample of about HOT_SAMPLE texts.

    Missing one, or taking one for hot that is not, changes no result.  At most HOT_SHARE times the mean size of a
    set are hot, whatever the number of texts.
    """
    if n_rows < HOT_NODES:
        return np.zeros(0, dtype=np.uint64)
    step = max(1, n_rows // HOT_SAMPLE)

    def run(batches):
        for batch in batches:
            for _, block in blocks(batch, "text", LOWER):
                _, shingle, _, _ = shingle_sets(block, size)
                token, n = np.unique(shingle >> np.uint64(8), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).select("text")
    least = max(HOT_NODES, n_rows // HOT_SHARE) / step
    found = some.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["token"] for r in found.select("token").collect()], dtype=np.int64).view(np.uint64))


def _is_hot(token: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(token), dtype=bool)
    return hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token


def _packed(text: np.ndarray, token: np.ndarray, node: np.ndarray, n: np.ndarray, parts: int, hot: np.ndarray) -> pa.RecordBatch:
    """Shingles (56 bits) by bucket, one row each: nodes and sizes, the owner of each shingle, shingles.

    A hot shingle is dealt by its node, so no bucket gets all nodes that have it.
    """
    dealt = np.where(_is_hot(token, hot), node.view(np.uint64)[text], token)
    bucket = (mix(dealt) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
    out = ([], [], [], [], [])
    for b in np.flatnonzero(np.diff(cuts)):
        mine = order[cuts[b]:cuts[b + 1]]
        owner, local = np.unique(text[mine], return_inverse=True)
        seven = np.ascontiguousarray(token[mine]).view(np.uint8).reshape(-1, 8)[:, :7]
        local = local.astype(np.uint16 if len(owner) < 65536 else np.uint32)
        for column, value in zip(out, (int(b), node[owner].tobytes(), n[owner].astype(np.int32).tobytes(),
                                       local.tobytes(), seven.tobytes())):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32())] + [pa.array(c, pa.binary()) for c in out[1:]],
                                      names=["bucket", "nodes", "sizes", "owners", "tokens"])


def _dealt_parts(docs: DataFrame, parts: int, size: int, hot: np.ndarray) -> DataFrame:
    """Hash-ordered part of every set, dealt out; copies within a block count once."""
    def run(batches):
        for batch in batches:
            for _, block in blocks(batch, "text", LOWER):
                text, shingle, n, node = shingle_sets(block, size)
                fresh = np.zeros(block.n, dtype=bool)
                fresh[np.unique(node, return_index=True)[1]] = True
                length = np.minimum(n, n - least_common(n) + _extra(n))
                take = (np.arange(len(text)) - (np.cumsum(n) - n)[text] < length[text]) & fresh[text]
                yield _packed(text[take], shingle[take] >> np.uint64(8), node, n, parts, hot)

    return docs.select("text").mapInArrow(run, _DEALT).repartitionById(parts, F.col("bucket"))


def _dealt_sets(sets: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Whole sets, dealt out."""
    def run(batches):
        for batch in batches:
            node, ends = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy()
            values = batch.column(1).values.to_numpy().view(np.uint64)
            at = 0
            while at < len(node):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_SHINGLES, "right")) - 1)
                n = np.diff(ends[at:end + 1])
                yield _packed(np.repeat(np.arange(end - at), n), values[ends[at]:ends[end]] >> np.uint64(8),
                              node[at:end], n, parts, hot)
                at = end

    return sets.select("node", "shingles").mapInArrow(run, _DEALT).repartitionById(parts, F.col("bucket"))


def _gathered(batches, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the buckets of one partition that occur in several nodes.

    Gives all nodes and their sizes, then for each shingle and node: the node's index, the shingle, and in how
    many nodes it occurs, _VERY_MANY for a hot one.
    """
    node, size, owner, token = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    n_nodes = 0
    for batch in batches:
        for nodes, sizes, owners, tokens in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            packed = np.frombuffer(tokens, dtype=np.uint8).reshape(-1, 7)
            wide = np.zeros((len(packed), 8), dtype=np.uint8)
            wide[:, :7] = packed
            own = np.frombuffer(nodes, dtype=np.int64)
            node.append(own)
            size.append(np.frombuffer(sizes, dtype=np.int32))
            owner.append(np.frombuffer(owners, np.uint16 if len(own) < 65536 else np.uint32).astype(np.int64) + n_nodes)
            token.append(wide.view(np.uint64)[:, 0])
            n_nodes += len(own)
    node, ref = np.unique(np.concatenate(node), return_inverse=True)
    sizes = np.zeros(len(node), dtype=np.int64)
    sizes[ref] = np.concatenate(size)
    owner, token = ref[np.concatenate(owner)], np.concatenate(token)
    order = np.lexsort((owner, token))
    owner, token = owner[order], token[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    owner, token = owner[new], token[new]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
    count = np.diff(np.append(first, len(token)))
    count = np.where(_is_hot(token, hot), _VERY_MANY, np.repeat(count, count))
    keep = count > 1
    return node, sizes, owner[keep], token[keep], count[keep]


_BACK = "part int, nodes binary, sizes binary, counts binary, tokens binary"


def _sent_back(node: np.ndarray, size: np.ndarray, count: np.ndarray, token: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row per part that nodes are dealt to: nodes, sizes, numbers of shingles, and the shingles of each in turn.

    ``token`` holds the shingles of the nodes one after another, or is empty.
    """
    part = (mix(node.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = ([], [], [], [], [])
    for p in np.flatnonzero(np.diff(cuts)):
        mine = order[cuts[p]:cuts[p + 1]]
        own = b"".join(token[at[i]:at[i + 1]].tobytes() for i in mine) if len(token) else b""
        for column, value in zip(out, (int(p), node[mine].tobytes(), size[mine].tobytes(), count[mine].tobytes(), own)):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32())] + [pa.array(c, pa.binary()) for c in out[1:]],
                                      names=["part", "nodes", "sizes", "counts", "tokens"])


def _shared_counts(parts: int, hot: np.ndarray):
    """How many of the shingles dealt to one partition each node shares with others."""
    def run(batches):
        node, size, owner, _, _ = _gathered(batches, hot)
        count = np.bincount(owner, minlength=len(node)).astype(np.int64)
        some = count > 0
        yield _sent_back(node[some], size[some], count[some], np.zeros(0, np.uint64), parts)

    return run


def _shared_tokens(parts: int, hot: np.ndarray):
    """Shared shingles dealt to one partition by node, with their class in the top byte."""
    def run(batches):
        node, size, owner, token, count = _gathered(batches, hot)
        packed = (np.searchsorted(CLASS_LIMITS, count).astype(np.uint64) << np.uint64(56)) | token
        packed = packed[np.argsort(owner, kind="stable")]
        n = np.bincount(owner, minlength=len(node)).astype(np.int64)
        some = n > 0
        yield _sent_back(node[some], size[some], n[some], packed, parts)

    return run


def _arrived(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``_sent_back`` of one part: distinct nodes, their sizes, and for each entry its node, count and all shingles."""
    columns = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.uint64)]
    for batch in batches:
        for k, name in enumerate(("nodes", "sizes", "counts", "tokens")):
            for value in batch.column(batch.schema.get_field_index(name)).to_pylist():
                columns[k].append(np.frombuffer(value, dtype=columns[k][0].dtype))
    node, size, count, token = (np.concatenate(c) for c in columns)
    distinct, ref = np.unique(node, return_inverse=True)
    sizes = np.zeros(len(distinct), dtype=np.int64)
    sizes[ref] = size
    return distinct, sizes, ref, count, token


def _may_have_partner(batches):
    node, size, ref, count, _ = _arrived(batches)
    shared = np.bincount(ref, weights=count, minlength=len(node))
    yield pa.RecordBatch.from_arrays([pa.array(node[shared >= least_shared(size)])], names=["node"])


def signatures(packed: np.ndarray, n: int) -> list[np.ndarray]:
    """Index entries of one node from its shared shingles (class in the top byte), for its size class and the next.

    Of the shared shingles at most ``budget`` are missing from a partner.  A class whose entries take k
    shingles from one of ``groups`` groups survives that as long as k are left in some group, so the prefix
    grows until every group loses k - 1 and still more than ``budget`` remain.
    """
    packed = np.sort(packed)
    kind, token = (packed >> np.uint64(56)).astype(np.int64), packed & _LOW56
    budget = len(packed) - int(least_common(n))
    own = int(np.searchsorted(SIZE_CLASS, n, "right")) - 1
    out = []
    for size_class in (own, own + 1):
        smallest = int(SIZE_CLASS[max(size_class - 1, 0)])
        groups = (int(least_common(smallest)) - 1) // 6
        k = np.where(kind > 0, kind + 1, 1) if groups else np.ones(len(kind), dtype=np.int64)
        group = np.where(k > 1, k * groups + (mix(token) % np.uint64(max(groups, 1))).astype(np.int64), -1)
        seen: dict[int, int] = {}
        worth = 0
        end = 0
        while worth <= budget:
            g = int(group[end])
            if g < 0:
                worth += 1
            else:
                seen[g] = seen.get(g, 0) + 1
                worth += seen[g] >= k[end]
            end += 1
        salt = np.uint64(size_class + 1)
        single = token[:end][group[:end] < 0]
        out.append(mix(single ^ (salt << np.uint64(57))))
        for g in seen:
            mine = token[:end][group[:end] == g]
            width = int(k[:end][group[:end] == g][0])
            if len(mine) >= width:
                picks = np.array(list(combinations(range(len(mine)), width)))
                out.append(mix(join_hashes(mine[picks.ravel()], np.arange(0, picks.size, width), width) + salt))
    return out


def _index(batches):
    node, size, ref, count, token = _arrived(batches)
    owner = np.repeat(ref, count)
    token = token[np.argsort(owner, kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(node)))])
    enough = np.flatnonzero(np.diff(at) >= least_common(size))
    for first in range(0, len(enough), 1000):
        sig, rows = [], []
        for i in enough[first:first + 1000]:
            packed = token[at[i]:at[i + 1]]
            for s in signatures(packed, int(size[i])):
                sig.append(s)
                rows.append(np.broadcast_to(np.array([node[i], size[i], len(packed)]), (len(s), 3)))
        rows = np.concatenate(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), *(pa.array(c) for c in rows.T.copy())],
                                         names=["sig", "node", "n", "shared"])


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, block in blocks(batch, "text", LOWER):
                text, shingle, n, node = shingle_sets(block, size)
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.ListArray.from_arrays(pa.array(at), pa.array(shingle.view(np.int64))),
                     *map(pa.array, _parities(text, shingle, block.n).T.copy())], names=["node", "shingles", *PARITY])

    return docs.select("text").mapInArrow(run, "node long, shingles array<long>, " + ", ".join(f"{p} long" for p in PARITY))


PARITY = [f"parity{i}" for i in range(8)]


def _parities(text: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """64 bits per column of PARITY and text: whether an odd number of shingles fall on each bit.

    Two sets differ in at least as many shingles as their bits differ.
    """
    bits = 64 * len(PARITY)
    cell = text * bits + (mix(shingle) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def parity_condition() -> str:
    """SQL: the parity bits of two sets do not rule out that they link."""
    apart = " + ".join(f"bit_count({p} ^ {p}_b)" for p in PARITY)
    return f"{NUMER + DENOM} * ({apart}) <= {DENOM - NUMER} * (n + n_b)"


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the similarity."""
    out = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
           .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"))
    both = F.size(F.array_intersect("x", "y"))
    return (out.withColumn("both", both)
            .where(DENOM * F.col("both") >= NUMER * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b"))


# Similar enough by size, and if both shared as many shingles as the one that shares fewer has.
_NEAR = f"""{NUMER} * greatest(n, n_b) <= {DENOM} * least(n, n_b)
    AND {NUMER + DENOM} * least(shared, shared_b) >= {NUMER} * (n + n_b)"""


def _cross_pairs(index: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of one list in different components, each once.

    Entries that no size in their list could reach leave first, and pairs whose parity bits differ more than
    their sets may.
    """
    least = index.groupBy("sig").agg(F.min("n").alias("least"), F.max("shared").alias("most"))
    reach = (index.join(least, "sig")
             .where(f"{NUMER + DENOM} * least(shared, most) >= {NUMER} * (n + least)").drop("least", "most"))
    bits = sets.select("node", *PARITY).dropDuplicates(["node"])
    return cross_pairs(reach, bits, scratch, f"{_NEAR} AND {parity_condition()}")


def _grouped(docs: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """(doc_id, hash, n, component) of every row; the component is null for a text without words."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = scratch.keep(nodes_of(docs, size), "rows")
    total = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["shingles"] // PART_SHINGLES))
    hot = hot_shingles(docs, total["rows"], size)
    back = F.col("part")
    counts = _dealt_parts(docs, parts, size, hot).mapInArrow(_shared_counts(parts, hot), _BACK).repartitionById(parts, back)
    near = scratch.keep(counts.mapInArrow(_may_have_partner, "node long"), "near")
    keys = rows.groupBy("node").agg(F.min("key").alias("key")).join(near, "node", "left_semi").select("key").distinct()
    with_key = docs.select("text", text_key().alias("key")).join(keys, "key", "left_semi")
    sets = scratch.keep(whole_sets(with_key, size), "sets")

    tokens = _dealt_sets(sets, parts, hot).mapInArrow(_shared_tokens(parts, hot), _BACK).repartitionById(parts, back)
    entries = scratch.keep(tokens.mapInArrow(_index, "sig long, node long, n long, shared long"), "entries")
    index = scratch.keep(collapsed(entries).drop("rows"), "index")

    # first each node with the member of its lists that has the smallest share of shingles of its own, nearest to the middle
    order = [1 - F.col("shared") / F.col("n"), F.xxhash64("node")]
    links = scratch.keep(verify(star_pairs(labelled(index, None), order, _NEAR), sets), "links")
    member = scratch.keep(components(links, scratch), "member")
    links = links.union(scratch.keep(verify(_cross_pairs(labelled(index, member), sets, scratch), sets), "links"))
    member = scratch.keep(components(links, scratch), "member")

    group = F.when(F.col("n") > 0, F.coalesce("component", "node"))
    return rows.join(member, "node", "left").select("doc_id", "hash", "n", group.alias("component"))


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Sets link at a Jaccard similarity of 0.8 or more.  ``component_id`` is the smallest doc_id reachable by
    links, null only if every id there is null.  A null or empty text has no shingles and only itself.
    Repeated rows each give a row; rows of one doc_id with different texts are separate sets.  Sets are
    compared as 64-bit hashes.
    """
    out = _grouped(docs, scratch, size)
    low = out.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    low = scratch.keep(low, "low")  # so that the join below has no aggregate on its side and can be split
    return out.join(low, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, scratch: Scratch, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of linked texts.

    The row with the smallest doc_id stays, rows without one coming last; of rows with that id the one whose
    text has the smallest hash.  Of repeated rows (same id and text) one stays, also of empty ones.
    """
    out = _grouped(docs, scratch, size)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    first = scratch.keep(out.where("component is not null").groupBy("component").agg(F.min(order).alias("first")), "first")
    gone = (out.join(first, "component").where(order != F.col("first"))
            .select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash")).distinct())
    mark, = fresh(docs.columns, "text_hash")
    ids, hashes = quoted("doc_id", mark)
    rest = docs.withColumn(mark, _hash()).join(gone, hashes.eqNullSafe(F.col("gone_hash")) & ids.eqNullSafe(F.col("gone_id")),
                                               "left_anti")
    return rest.dropDuplicates(["doc_id", mark]).select(*quoted(*docs.columns))
