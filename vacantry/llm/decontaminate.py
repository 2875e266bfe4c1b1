"""Benchmark passages in documents, found by Wu-Manber search over words.

The patterns are the word windows of the benchmark items.  For each pattern length a shift table says, for
every block of two words, how far a search may skip when that block ends the current position; blocks that
no pattern holds skip almost a whole pattern.  Where the shift is 0, the hash of the block selects the
bucket of patterns that end with it, and their words are compared.  All texts of a block are searched in
step, one lane per stretch of words, so each step is one array operation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantry.llm.blocks import LOWER, Block, blocks, byte_set, join_hashes
from vacantry.llm.labelled import fresh
from vacantry.llm.scratch import Scratch

WINDOW = 10
LANE = 256  # words a lane starts in
PATTERN_BYTES = 8 << 20  # of benchmark text that one search table is built from; the table is up to 15 times as large
WORD = byte_set([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = block.edges(WORD)
    return starts, ends, block.bounds(starts), block.hashes(starts, ends)


@dataclass
class Library:
    """All items one after another: folded text, places and hashes of their words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def spelled(self, first: int, length: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[first:first + length], self.ends[first:first + length])]


@dataclass
class Search:
    """Search tables for the patterns of one length; a pattern is a place in the library.

    ``slots``: of the last block of each pattern, ascending; ``at``: its first word; ``cut`` and ``items``: numbers of
    the items that hold pattern i are ``items[cut[i]:cut[i + 1]]``.
    """

    length: int
    bits: int
    shift: np.ndarray
    library: Library
    slots: np.ndarray
    at: np.ndarray
    cut: np.ndarray
    items: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.shift, self.slots, self.at, self.cut, self.items))

    @property
    def block(self) -> int:
        return min(2, self.length)

    def find(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence, by equal word hashes."""
        m, size, step = self.length, self.block, np.arange(self.length)
        n = np.maximum(np.diff(bounds) - m + 1, 0)  # positions where a window may start
        lanes = -(-n // LANE)
        text = np.repeat(np.arange(len(n)), lanes)
        offset = (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        at = bounds[:-1][text] + offset
        end = np.minimum(at + LANE, bounds[:-1][text] + n[text])
        ends = join_hashes(hashes, np.arange(max(len(hashes) - size + 1, 0)), size)
        slot = (ends >> np.uint64(64 - self.bits)).astype(np.int64)
        jump = self.shift[slot]
        first, which = [], []
        while len(at):
            last = at + m - size
            skip = jump[last].astype(np.int64)
            hit = np.flatnonzero(skip == 0)
            if len(hit):
                wanted = slot[last[hit]].astype(self.slots.dtype)
                p, low, high = at[hit], np.searchsorted(self.slots, wanted), np.searchsorted(self.slots, wanted, "right")
                while len(p):  # one pattern of each bucket at a time
                    same = (self.library.hashes[self.at[low][:, None] + step] == hashes[p[:, None] + step]).all(axis=1)
                    first.append(p[same])
                    which.append(low[same])
                    low = low + 1
                    more = low < high
                    p, low, high = p[more], low[more], high[more]
            at = at + np.maximum(skip, 1)
            going = at < end
            at, end = at[going], end[going]
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate([empty, *first]), np.concatenate([empty, *which])


def _search(length: int, library: Library, at: np.ndarray, owner: np.ndarray) -> Search:
    """Tables for the windows that start at the words ``at`` of the items ``owner``."""
    window = join_hashes(library.hashes, at, length)
    order = np.lexsort((owner, window))
    at, owner, window = at[order], owner[order], window[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = window[1:] != window[:-1]
    for j in range(length):  # windows of equal hash and other words stay apart
        new[1:] |= library.hashes[at[1:] + j] != library.hashes[at[:-1] + j]
    pattern = np.cumsum(new) - 1
    again = np.zeros(len(at), dtype=bool)  # an item that holds the pattern once more
    again[1:] = ~new[1:] & (owner[1:] == owner[:-1])
    items, cut = owner[~again].astype(np.int32), np.searchsorted(pattern[~again], np.arange(new.sum() + 1))
    at = at[new].astype(np.int32)

    size = min(2, length)
    ends = join_hashes(library.hashes, np.arange(len(library.hashes) - size + 1), size)
    bits = int(np.clip(np.ceil(np.log2(8 * len(ends) + 1)), 10, 26))
    slot = (ends >> np.uint64(64 - bits)).astype(np.uint32)
    shift = np.full(1 << bits, length - size + 1, dtype=np.uint8 if length < 256 else np.uint32)
    for j in range(length - size + 1):
        np.minimum.at(shift, slot[at + j], shift.dtype.type(length - size - j))
    last = slot[at + length - size]
    order = np.argsort(last, kind="stable")
    count = np.diff(cut)[order]
    begin = np.concatenate([[0], np.cumsum(count)])
    items = items[np.repeat(cut[:-1][order] - begin[:-1], count) + np.arange(count.sum())]
    return Search(length, bits, shift, library, last[order], at[order], begin.astype(np.int32), items)


def compile_items(items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[list[Search], list[str]]:
    """Search tables, one per pattern length, and the item ids as sorted distinct strings.

    Rows of one id are one item; a null id is the empty string.  An item of fewer words than the window is
    one pattern, one without words none.  Tables take some fifteen times the bytes of the items at most.
    """
    ids = sorted({"" if i is None else str(i) for i, _ in items})
    number = {s: k for k, s in enumerate(ids)}
    texts = [(text or "").encode() for _, text in items]
    block = Block(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]), LOWER)
    starts, ends, bounds, hashes = _words(block)
    library = Library(block.data, starts.astype(np.int32), ends.astype(np.int32), hashes)
    owner = np.array([number["" if i is None else str(i)] for i, _ in items], dtype=np.int64)
    n = np.diff(bounds)
    length = np.minimum(n, window)
    out = []
    for m in np.unique(length[n > 0]):
        mine = np.flatnonzero(length == m)
        places = n[mine] - m + 1
        at = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places) + np.repeat(bounds[:-1][mine], places)
        out.append(_search(int(m), library, at, np.repeat(owner[mine], places)))
    return out, ids


def _search_block(block: Block, searches: list[Search], ids: list[str]) -> dict[str, list]:
    starts, ends, bounds, hashes = _words(block)
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    found: dict[int, set[int]] = {}
    for s in searches:
        first, which = s.find(hashes, bounds)
        text = np.searchsorted(bounds, first, "right") - 1
        for p, w, t in zip(first.tolist(), which.tolist(), text.tolist()):
            span, q = slice(p, p + s.length), int(s.at[w])
            spelled = [block.data[a:b].tobytes() for a, b in zip(starts[span], ends[span])]
            if spelled != s.library.spelled(q, s.length):  # unequal words of equal hash
                continue
            cover[p] += 1
            cover[p + s.length] -= 1
            found.setdefault(t, set()).update(s.items[s.cut[w]:s.cut[w + 1]].tolist())
    hit = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(np.cumsum(cover[:-1]) > 0, out=hit[1:])
    names = [sorted(found.get(t, ())) for t in range(block.n)]
    return {"n_words": np.diff(bounds), "n_hit": hit[bounds[1:]] - hit[bounds[:-1]], "items": names,
            "covered": np.diff(hit) > 0, "bounds": bounds,
            "n_items": np.array([len(x) for x in names], dtype=np.int64),
            "items_sha256": [hashlib.sha256(",".join(ids[k] for k in x).encode()).hexdigest() for x in names]}


def pattern_items(benchmark: DataFrame, most: int = PATTERN_BYTES) -> list[tuple[object, str | None]]:
    """The (item_id, text) rows, read to the driver behind a check of their size.

    For one search table of a stated, small pattern set: one larger than ``most`` bytes raises.  ``item_parts``
    reads a benchmark of any size.
    """
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    if size > most:
        raise ValueError(f"benchmark of {size} bytes; give parts of at most {most}")
    return [tuple(r) for r in benchmark.select("item_id", "text").toLocalIterator()]


def item_parts(benchmark: DataFrame, most: int = PATTERN_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The (item_id, text) rows in parts of at most ``most`` bytes, more only for one longer row; at least one part.

    Parts are read to the driver one after another.
    """
    part, held = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        size = len((text or "").encode()) + 16
        if part and held + size > most:
            yield part
            part, held = [], 0
        part.append((item, text))
        held += size
    yield part


def _merge(got: dict[str, list], ids: list[str], hits: list[bytes], found: list[list[str]]) -> None:
    """Adds hit words and item ids of other parts to those of a block."""
    covered, bounds = got["covered"], got["bounds"]
    for t, runs in enumerate(hits):
        for a, b in np.frombuffer(runs, dtype=np.int64).reshape(-1, 2) + bounds[t]:
            covered[a:b] = True
    total = np.concatenate([[0], np.cumsum(covered)])
    names = [sorted({*(ids[k] for k in mine), *others}) for mine, others in zip(got["items"], found)]
    got["n_hit"] = total[bounds[1:]] - total[bounds[:-1]]
    got["n_items"] = np.array([len(x) for x in names], dtype=np.int64)
    got["items_sha256"] = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    got["names"] = names


def _hit_runs(got: dict[str, list]) -> list[bytes]:
    """First and one past the last word of each run of hit words, for every text."""
    out = []
    for a, b in zip(got["bounds"][:-1], got["bounds"][1:]):
        edge = np.diff(np.concatenate([[0], got["covered"][a:b].astype(np.int8), [0]]))
        out.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).astype(np.int64).tobytes())
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                  drop: tuple[str, ...] = (), most: int = PATTERN_BYTES) -> DataFrame:
    """The rows with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` as last columns.

    A word is hit if it lies in any occurrence of a window.  A null text has no words.  With no items, or
    none with words, nothing is hit.  Columns of the rows with such names stay and the new ones get
    underscores in front.  Nothing is shuffled.  A benchmark of more than ``most`` bytes is searched in parts;
    between two parts the rows are written with their hit words and item ids so far.
    """
    keep = [c for c in docs.columns if c not in drop]
    names = fresh(keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, k) for n, k in zip(names, kinds)])
    columns, carry = docs.columns, fresh(docs.columns, "hits", "found")
    carried_schema = T.StructType([*docs.schema, T.StructField(carry[0], T.BinaryType()),
                                   T.StructField(carry[1], T.ArrayType(T.StringType()))])

    def searched(rows: DataFrame, items: list[tuple[object, str | None]], first: bool, last: bool) -> DataFrame:
        tables = docs.sparkSession.sparkContext.broadcast(compile_items(items, window))  # a bounded multiple of ``most``

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches, ids = tables.value
            for batch in batches:
                for rows, block in blocks(batch, text, LOWER):
                    got = _search_block(block, searches, ids)
                    part = batch.slice(rows.start, rows.stop - rows.start)
                    if not (first and last):
                        hits, found = ([b""] * block.n, [[]] * block.n) if first else (
                            part.column(batch.schema.get_field_index(c)).to_pylist() for c in carry)
                        _merge(got, ids, hits, found)
                    if last:
                        arrays = [part.column(batch.schema.get_field_index(c)) for c in keep]
                        arrays += [pa.array(got[c].astype(np.int64)) for c in ("n_words", "n_hit", "n_items")]
                        arrays += [pa.array(got["items_sha256"], pa.string()), pa.array(got["n_hit"] > 0)]
                        yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])
                    else:
                        arrays = [part.column(batch.schema.get_field_index(c)) for c in columns]
                        arrays += [pa.array(_hit_runs(got), pa.binary()), pa.array(got["names"], pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *carry])

        return rows.mapInArrow(run, schema if last else carried_schema)

    parts = item_parts(benchmark, most)
    items, after = next(parts), next(parts, None)
    if after is None:
        return searched(docs, items, True, True)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows, first = docs, True
    while after is not None:
        rows, first = scratch.keep(searched(rows, items, first, False), "part"), False
        items, after = after, next(parts, None)
    return searched(rows, items, False, True)
