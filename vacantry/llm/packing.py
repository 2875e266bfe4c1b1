"""Packs tokenized documents into windows by a plan solved on the length histogram.

Every document is cut into whole windows and a remainder.  Whole windows stand alone.  For the remainders,
combinations of two or three lengths that fill a window exactly are enumerated, non-negative least squares
finds how often to repeat each so that the histogram is used up, and the counts are rounded down.  What is
left is packed greedily, largest first; a piece that would leave a gap is cut at a multiple of CUT.  The
plan holds ranges of ranks per length, never single documents, so its size depends on the window only.
Documents find their place by their rank within their length; the texts are read once.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantry.llm.blocks import text_array
from vacantry.llm.scratch import Scratch

WINDOW = 2048
CUT = 128
END_ID = 1
_ALONE = 1 << 36  # sequence ids of whole windows start here; planned ones lie below

_encoders: dict[tuple[str, str], object] = {}


def encoder(ranks_path: str, pattern: str):
    """Byte-level tokenizer over a public vocabulary in rank form; one per worker process."""
    import tiktoken

    key = (ranks_path, pattern)
    if key not in _encoders:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def _cut_crcs(tail: np.ndarray, cut: int) -> list[int]:
    """CRC of the whole remainder, then of the part before and the part after each possible cut."""
    out = [_crc(tail)]
    for c in range(cut, len(tail), cut):
        out += [_crc(tail[:c]), _crc(tail[c:])]
    return out


def tokenized(docs: DataFrame, ranks_path: str, pattern: str, window: int = WINDOW, cut: int = CUT,
              end_id: int = END_ID) -> DataFrame:
    """One row per document: token count with the end id, remainder, its rank in this task, and CRCs.

    A null text is empty and has the end id only.  Full texts are tokenized, one at a time.
    """
    def run(batches):
        enc = encoder(ranks_path, pattern)
        part = TaskContext.get().partitionId()
        seen = np.zeros(window, dtype=np.int64)
        alone = 0
        for batch in batches:
            rows = ([], [], [], [], [], [])
            for text in text_array(batch, "text"):
                ids = np.append(enc.encode_to_numpy(text.as_py(), disallowed_special=()).astype(np.uint32),
                                np.uint32(end_id))
                full, rest = divmod(len(ids), window)
                tail = ids[full * window:]
                for column, value in zip(rows, (
                        len(ids), rest, int(seen[rest]), alone,
                        [_crc(ids[i * window:(i + 1) * window]) for i in range(full)],
                        _cut_crcs(tail, cut) if rest else [])):
                    column.append(value)
                seen[rest] += 1
                alone += full
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, part)), batch.column(0), *map(pa.array, rows, kinds)],
                names=["part", "doc_id", "doc_tokens", "rest", "rank", "alone", "whole_crcs", "rest_crcs"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "part long, doc_id long, doc_tokens long, rest long, rank long, alone long, "
             "whole_crcs array<long>, rest_crcs array<long>")


def combinations(window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a window: all pairs, and two triples for each length."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, np.zeros_like(a)], axis=1)
    first = np.arange(1, window - 1)
    rest = window - first
    triples = [np.stack([first, b, rest - b], axis=1) for b in (np.maximum(rest // 2, 1), np.maximum(rest // 4, 1))]
    out = np.sort(np.concatenate([pairs, *triples]), axis=1)
    out = out[(out >= 0).all(axis=1)]
    return np.unique(out[out[:, 1] > 0], axis=0)


def solve(combos: np.ndarray, histogram: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared gap between used and present lengths.

    Non-negative least squares by accelerated projected steps; the bound on each step is the column's sum
    of row sums, which holds for matrices without negative entries.
    """
    size = len(histogram)

    def used(x):
        return sum(np.bincount(combos[:, j], weights=x, minlength=size) for j in range(3)) * present

    def gain(r):
        return sum((r * present)[combos[:, j]] for j in range(3))

    present = np.ones(size)
    present[0] = 0
    limit = np.maximum(gain(used(np.ones(len(combos)))), 1)
    feasible = histogram[combos[:, 1]].astype(bool) & histogram[combos[:, 2]].astype(bool)
    feasible &= (combos[:, 0] == 0) | histogram[combos[:, 0]].astype(bool)
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.where(feasible, np.maximum(y + gain(histogram - used(y)) / limit, 0), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


@dataclass
class Plan:
    """Ranges of ranks: documents of remainder ``rest`` and rank in [low, high) put ids [start, end) of it
    into sequence ``sequence + rank - low`` at ``offset``."""

    rows: np.ndarray  # rest, low, high, start, end, sequence, offset
    sequences: int


def make_plan(histogram: np.ndarray, window: int = WINDOW, cut: int = CUT) -> Plan:
    """Plan for ``histogram[length]`` remainders of each length below the window."""
    histogram = np.asarray(histogram, dtype=np.int64).copy()
    histogram[0] = 0
    rows: list[tuple[int, ...]] = []
    sequences = 0
    # a pool entry: length -> stack of (rest, low rank, high rank, start, end); only whole remainders can be cut
    pool: dict[int, list[list[int]]] = {int(n): [[int(n), 0, int(histogram[n]), 0, int(n)]]
                                        for n in np.flatnonzero(histogram)}
    left = {n: e[0][2] for n, e in pool.items()}

    def take(length: int, copies: int, sequence: int, offset: int, until: int = 0) -> list[list[int]]:
        """Places ``copies`` pieces of a length, one in each of the sequences; with ``until`` only their first
        part, and gives back the ranges of the second parts."""
        rests = []
        while copies:
            entry = pool[length][-1]
            n = min(copies, entry[2] - entry[1])
            end = entry[3] + until if until else entry[4]
            rows.append((entry[0], entry[1], entry[1] + n, entry[3], end, sequence, offset))
            if until:
                rests.append([entry[0], entry[1], entry[1] + n, end, entry[4]])
            entry[1] += n
            left[length] -= n
            if entry[1] == entry[2]:
                pool[length].pop()
            sequence += n
            copies -= n
        if not left[length]:
            del left[length], pool[length]
        return rests

    def place(lengths: list[int], copies: int) -> None:
        nonlocal sequences
        offset = 0
        for n in lengths:
            take(n, copies, sequences, offset)
            offset += n
        sequences += copies

    combos = combinations(window)
    if len(left) > 1:
        x = solve(combos, histogram)
        for i in np.argsort(-x, kind="stable"):
            want = int(x[i] + 1e-6)
            if not want:
                break
            lengths = [int(n) for n in combos[i] if n]
            need = {n: lengths.count(n) for n in lengths}
            copies = min([want, *(left.get(n, 0) // k for n, k in need.items())])
            if copies:
                place(lengths, copies)

    lengths = sorted(left)  # greedy: largest first, then the largest that fit, then a cut piece
    while left:
        lengths = [n for n in lengths if n in left]
        chosen: list[int] = [lengths[-1]]
        free = window - chosen[0]
        used = {chosen[0]: 1}
        while free:
            k = int(np.searchsorted(lengths, free, "right")) - 1
            while k >= 0 and left[lengths[k]] <= used.get(lengths[k], 0):
                k -= 1
            if k < 0:
                break
            chosen.append(lengths[k])
            used[lengths[k]] = used.get(lengths[k], 0) + 1
            free -= lengths[k]
        copies = min(left[n] // k for n, k in used.items())
        at = free // cut * cut
        victim = 0
        if at:
            for n in lengths[int(np.searchsorted(lengths, free, "right")):]:
                whole = pool[n][-1]
                if whole[3] == 0 and whole[4] == whole[0] and left[n] > used.get(n, 0):
                    victim = n
                    copies = min(copies, whole[2] - whole[1],
                                 left[n] // (used.get(n, 0) + 1))
                    break
        base, offset = sequences, 0
        if victim:  # cut first, while the range on top is a whole one
            for piece in take(victim, copies, base, window - free, until=at):
                rest = piece[4] - piece[3]
                pool.setdefault(rest, []).insert(0, piece)
                left[rest] = left.get(rest, 0) + piece[2] - piece[1]
                if rest not in lengths:
                    lengths = sorted([*lengths, rest])
        for n in chosen:
            take(n, copies, base, offset)
            offset += n
        sequences += copies
    table = np.array(rows, dtype=np.int64).reshape(-1, 7)
    return Plan(table[np.lexsort((table[:, 1], table[:, 0]))], sequences)


def _placed(plan: Plan, window: int, cut: int):
    # ranges from the first id and ranges of second parts are cut at different ranks: a table for each, in
    # which no two ranges of a length share a rank
    span = int(plan.rows[:, 2].max(initial=0)) + 1
    tables = [(t[:, 0] * span + t[:, 1], t) for t in (plan.rows[plan.rows[:, 3] == 0], plan.rows[plan.rows[:, 3] > 0])
              if len(t)]

    def run(batches):
        for batch in batches:
            doc, total, rest, rank, part, alone, whole, crcs = (batch.column(i) for i in range(8))
            total, rest, rank, part, alone = (c.to_numpy() for c in (total, rest, rank, part, alone))
            out = ([], [], [], [], [], [], [])
            n_whole = (total - rest) // window
            row = np.repeat(np.arange(batch.num_rows), n_whole)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n_whole) - n_whole, n_whole)
            flat = whole.flatten().to_numpy()
            parts = [(row, within * window, np.full(len(row), window), flat,
                      (part[row] + 1) * _ALONE + alone[row] + within, np.zeros(len(row), dtype=np.int64))]
            # a remainder has one range, or one in each table where it was cut
            mine = np.flatnonzero(rest > 0)
            for key, table in tables:
                at = np.searchsorted(key, rest[mine] * span + rank[mine], "right") - 1
                found = np.maximum(at, 0)
                ok = (at >= 0) & (table[found, 0] == rest[mine]) & (table[found, 2] > rank[mine])
                found, rows = found[ok], mine[ok]
                start, end = table[found, 3], table[found, 4]
                where = np.where(end - start == rest[rows], 0,
                                 np.where(start == 0, 2 * (end // cut) - 1, 2 * (start // cut)))
                ends = crcs.offsets.to_numpy()
                crc = crcs.values.to_numpy()[ends[rows] + where] if len(rows) else np.zeros(0, dtype=np.int64)
                parts.append((rows, total[rows] - rest[rows] + start, end - start, crc,
                              table[found, 5] + rank[rows] - table[found, 1], table[found, 6]))
            row, start, length, crc, sequence, offset = (np.concatenate(c) for c in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(row)), *(pa.array(c.astype(np.int64)) for c in (
                    start, length, crc, total[row], sequence, offset))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, scratch: Scratch, ranks_path: str, pattern: str, window: int = WINDOW,
           cut: int = CUT, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents (doc_id, text; other columns are ignored) may repeat or lack an id: each row is packed.  No
    documents give no pieces.  What reaches the driver is the histogram of remainders, below one window.
    """
    rows = scratch.keep(tokenized(docs, ranks_path, pattern, window, cut, end_id), "tokens")
    counts = rows.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(window, dtype=np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[r["rest"]] = r["n"]
    plan = make_plan(histogram, window, cut)
    ranked = rows.join(bases, ["part", "rest"], "left").select(
        "doc_id", "doc_tokens", "rest", (F.col("rank") + F.coalesce("base", F.lit(0))).alias("rank"), "part",
        "alone", "whole_crcs", "rest_crcs")
    return ranked.mapInArrow(
        _placed(plan, window, cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                    "sequence_id long, offset long")


def sequences(docs: DataFrame, pieces: DataFrame, ranks_path: str, pattern: str, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids) with the tokens themselves; ids of documents must be unique here."""
    def run(batches):
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            ids = [[*enc.encode_ordinary(t.as_py()), end_id] for t in text_array(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])

    tokens = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
    parts = pieces.join(tokens, "doc_id").select(
        "sequence_id", F.struct("offset", F.slice("ids", F.col("start").cast("int") + 1,
                                                  F.col("length").cast("int")).alias("ids")).alias("p"))
    return parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"))
