"""Removal of long byte strings that occur more than once, within or across documents.

Every window of LENGTH bytes belongs to the place of its smallest n-gram by hash (its anchor), so equal
windows have equal anchors at equal offsets.  Neighbouring windows with one anchor are a stretch.  Stretches
whose anchor n-gram occurs once are unique and drop out by counting; equal stretches are kept once with
their number.  The others are dealt out by anchor.  There all stretches are cut into symbols of GRAIN bytes
aligned to the anchor, the suffixes of the symbol string are sorted by grouping (``suffix_groups``), suffixes
that agree on all whole symbols of a window form a class, and the windows of a class are compared as bytes
by their hash.  An anchor with many different stretches, as at the edge of a passage that very many
documents share, is too much for one task: its stretches are split into cells of windows by the bytes before the
anchor, a cell takes the bytes that all its windows share into its key, and cells are dealt out and sorted like
stretches, or split again.  Runs of repeated windows go back to their documents by joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantry.llm.blocks import Block, blocks, mix, text_array
from vacantry.llm.scratch import Scratch
from vacantry.llm.suffix_groups import suffix_array
from vacantry.operators.joins import spread_join

LENGTH = 400
GRAIN = 32  # bytes of an n-gram and of a symbol
BLOCK = 1 << 20
TASK_BYTES = 4 << 20  # of stretches sorted together, more only for one anchor
STRETCHES_PER_TASK = 500  # different stretches of one anchor that one task sorts; those of more are split
CELLS = (32, 1)  # windows of a cell, one number a round; all windows of one cell and key are equal in the last
_PLACE = 26  # low bits of a window key that hold a place in the block
_STRETCHES = "array<struct<key:bigint,content:bigint,start:int,n:int,anchor:int>>"


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - width + 1], before[width - 1:n])


def stretches(block: Block, length: int = LENGTH, grain: int = GRAIN) -> dict[str, np.ndarray]:
    """Stretches of all texts: text index, anchor key, content hash, first window, number of windows, anchor
    offset from the first window."""
    empty = {k: np.zeros(0, dtype=np.int64) for k in ("text", "key", "content", "start", "n", "anchor")}
    n = len(block.data)
    if n < length:
        return empty
    at = np.arange(n - grain + 1)
    gram = block.hashes(at, at + grain)
    places = np.arange(len(gram), dtype=np.uint64)
    low = np.uint64((1 << _PLACE) - 1)
    least = _smallest((gram & ~low) | places, length - grain + 1) & low
    windows = np.maximum(np.diff(block.offsets) - length + 1, 0)
    text = np.repeat(np.arange(block.n), windows)
    first = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + block.offsets[:-1][text]
    anchor = least[first].astype(np.int64)
    new = np.ones(len(first), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return empty
    count = np.diff(np.append(begin, len(first)))
    start, anchor, text = first[begin], anchor[begin], text[begin]
    return {"text": text, "key": gram[anchor].view(np.int64),
            "content": block.hashes(start, start + count + length - 1).view(np.int64),
            "start": start - block.offsets[text], "n": count, "anchor": anchor - start}


def _in_segments(block: Block, length: int, grain: int, size: int) -> dict[str, np.ndarray]:
    """Stretches of a block; a text longer than ``size`` is taken in segments that share ``length`` - 1 bytes, so every
    window lies in one of them and places stay below _PLACE bits.  A stretch ends with its segment."""
    if block.n > 1 or len(block.data) < size + length:
        return stretches(block, length, grain)
    out = []
    for at in range(0, len(block.data) - length + 1, size):
        data = block.data[at:at + size + length - 1]
        got = stretches(Block(data, np.array([0, len(data)])), length, grain)
        got["start"] = got["start"] + at
        out.append(got)
    return {k: np.concatenate([got[k] for got in out]) for k in out[0]}


def _listed(length: int, grain: int):
    def run(batches):
        for batch in batches:
            for rows, block in blocks(batch, "text", size=BLOCK):
                part = batch.slice(rows.start, rows.stop - rows.start)
                got = _in_segments(block, length, grain, BLOCK)
                ends = np.searchsorted(got["text"], np.arange(block.n + 1))
                fields = [pa.array(got["key"]), pa.array(got["content"]),
                          *(pa.array(got[k].astype(np.int32)) for k in ("start", "n", "anchor"))]
                items = pa.StructArray.from_arrays(fields, names=["key", "content", "start", "n", "anchor"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)],
                    names=["row", "ref", "stretches"])

    return run


def _cut_out(length: int):
    def run(batches):
        for batch in batches:
            texts = text_array(batch, "text")
            out = ([], [], [], [], [])
            for i, wanted in enumerate(batch.column(batch.schema.get_field_index("wanted")).to_pylist()):
                data = texts[i].as_py().encode()
                for w in wanted:
                    for column, value in zip(out, (w["key"], w["content"], w["weight"], w["anchor"],
                                                   data[w["start"]:w["start"] + w["n"] + length - 1])):
                        column.append(value)
            for at in range(0, len(out[0]), 2000):
                part = [c[at:at + 2000] for c in out]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, k) for c, k in zip(part, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())))],
                    names=["key", "content", "weight", "anchor", "data"])

    return run


def repeated_windows(texts: list[bytes], key: np.ndarray, weight: np.ndarray, anchor: np.ndarray, length: int = LENGTH,
                     grain: int = GRAIN) -> list[np.ndarray]:
    """For each stretch, which of its windows occur elsewhere among stretches with the same key, or twice by weight.

    Stretches must be distinct; ``anchor`` is the anchor's offset in each.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    block = Block(np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
    offset = block.offsets[:-1]
    # symbols aligned to the anchor; a last symbol of its own ends each stretch
    lead = anchor % grain
    n_symbols = (sizes - lead) // grain
    owner = np.repeat(np.arange(len(texts)), n_symbols)
    first = np.cumsum(n_symbols) - n_symbols
    nth = np.arange(n_symbols.sum()) - first[owner]
    place = offset[owner] + lead[owner] + nth * grain
    symbol = np.unique(block.hashes(place, place + grain), return_inverse=True)[1] + 1
    string = np.zeros(len(symbol) + len(texts), dtype=np.int64)
    at = np.arange(len(symbol)) + owner
    string[at] = symbol
    sa = suffix_array(string)
    # classes of suffixes: same key and equal on all whole symbols that every window here holds
    whole = (length - grain + 1) // grain
    back = np.full(len(string), -1, dtype=np.int64)
    back[at] = np.arange(len(symbol))
    sa = back[sa]
    sa = sa[sa >= 0]
    sa = sa[nth[sa] + whole <= n_symbols[owner[sa]]]
    # anchors of one key need not lie at equal symbol numbers, so the distance to the anchor is compared as well
    apart = (anchor[owner] - lead[owner]) // grain - nth
    # the suffix order says nothing about key and distance, so they are sorted within each run of equal symbols
    fresh = np.ones(len(sa), dtype=bool)
    if len(sa) > 1:
        a, b = sa[:-1], sa[1:]
        same = np.ones(len(a), dtype=bool)
        for t in range(whole):
            same &= symbol[a + t] == symbol[b + t]
        run = np.cumsum(np.concatenate([[True], ~same]))
        order = np.lexsort((apart[sa], key[owner[sa]], run))
        sa, run = sa[order], run[order]
        a, b = sa[:-1], sa[1:]
        fresh[1:] = (run[1:] != run[:-1]) | (key[owner[a]] != key[owner[b]]) | (apart[a] != apart[b])
    kind = np.full(len(symbol), -1, dtype=np.int64)
    kind[sa] = np.cumsum(fresh)
    members = np.bincount(kind[sa], minlength=len(sa) + 2)
    # windows: the first aligned place at or after the start names the class
    count = sizes - length + 1
    text = np.repeat(np.arange(len(texts)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    step = -(-(start - lead[text]) // grain)
    step = np.maximum(step, 0)
    ahead = lead[text] + step * grain - start
    cls = kind[first[text] + step]
    out = weight[text] > 1
    check = np.flatnonzero(~out | (members[cls] > 1))
    begin = offset[text[check]] + start[check]
    mark = mix(block.hashes(begin, begin + length) ^ mix(cls[check].astype(np.uint64) * np.uint64(64) + ahead[check].astype(np.uint64)))
    order = np.argsort(mark, kind="stable")
    equal = mark[order][1:] == mark[order][:-1]
    out[check[order[1:][equal]]] = True
    out[check[order[:-1][equal]]] = True
    return np.split(out, np.cumsum(count)[:-1]) if len(texts) else []


def _runs(flags: np.ndarray) -> np.ndarray:
    """First and one past the last place of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).astype(np.int32)


def _sorted_out(length: int, grain: int):
    def solve(rows: list[tuple]):
        distinct = {r[1]: r for r in rows}  # a repeated row would cut a stretch out twice
        rows = list(distinct.values())
        flags = repeated_windows([r[4] for r in rows], np.array([r[0] for r in rows]), np.array([r[2] for r in rows]),
                                 np.array([r[3] for r in rows], dtype=np.int64), length, grain)
        found = [(r[1], _runs(f).tobytes()) for r, f in zip(rows, flags) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()),
                                           pa.array([f[1] for f in found], pa.binary())], names=["content", "runs"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held > TASK_BYTES and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield solve(rows)

    return run


def _single_windows(length: int):
    """Every window of wanted stretches with its hash, for a plain count."""
    def run(batches):
        for batch in batches:
            texts = text_array(batch, "text")
            for i, wanted in enumerate(batch.column(batch.schema.get_field_index("wanted")).to_pylist()):
                data = np.frombuffer(texts[i].as_py().encode(), dtype=np.uint8)
                begin = np.array([w["start"] for w in wanted])
                for segment in np.unique(begin // BLOCK):
                    some = [w for w, mine in zip(wanted, begin // BLOCK == segment) if mine]
                    low = min(w["start"] for w in some)
                    piece = data[low:max(w["start"] + w["n"] for w in some) + length - 1]
                    block = Block(piece, np.array([0, len(piece)]))
                    n = np.array([w["n"] for w in some])
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start = np.repeat([w["start"] - low for w in some], n) + at
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([w["content"] for w in some], n)), pa.array(at.astype(np.int32)),
                         pa.array(block.hashes(start, start + length).view(np.int64)),
                         pa.array(np.repeat([w["weight"] for w in some], n))], names=["content", "at", "window", "weight"])

    return run


def _in_cells(length: int, grain: int, width: int):
    """Cuts stretches into cells: windows with the same number of bytes before the anchor, divided by ``width``."""
    def cells_of(batch):
        of, key, weight = (batch.column(c).to_numpy() for c in ("content", "key", "weight"))
        anchor, data = batch.column("anchor").to_numpy().astype(np.int64), batch.column("data").to_pylist()
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        block = Block(np.frombuffer(b"".join(data), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
        least = anchor - (sizes - length)  # bytes before the anchor in the last window
        n = anchor // width - least // width + 1
        row = np.repeat(np.arange(len(data)), n)
        cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (least // width)[row]
        low, high = cell * width, np.minimum(cell * width + width - 1, length - grain)
        begin = anchor[row] - np.minimum(high, anchor[row])
        end = anchor[row] - np.maximum(low, least[row]) + length
        at, middle = block.offsets[row], block.offsets[row] + anchor[row]
        shared = block.hashes(middle - low, middle + length - high)  # bytes of every window that the cell can hold
        keys = mix(shared ^ mix(key.view(np.uint64)[row] + cell.astype(np.uint64)))
        return pa.RecordBatch.from_arrays(
            [pa.array(of[row]), pa.array(begin.astype(np.int32)), pa.array(keys.view(np.int64)),
             pa.array(block.hashes(at + begin, at + end).view(np.int64)), pa.array(weight[row]),
             pa.array((anchor[row] - begin).astype(np.int32)),
             pa.array([data[r][i:j] for r, i, j in zip(row.tolist(), begin.tolist(), end.tolist())], pa.binary())],
            names=["of", "shift", "key", "content", "weight", "anchor", "data"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield cells_of(batch.slice(at, 1000))

    return run


def _of_stretches(batches):
    """Runs of all cells of a stretch as runs of the stretch; runs that meet at the edge of two cells become one."""
    for batch in batches:
        runs = []
        for cells in batch.column(1).to_pylist():
            each = np.concatenate([np.frombuffer(c["runs"], dtype=np.int32) + np.int32(c["shift"]) for c in cells]).reshape(-1, 2)
            each = each[np.argsort(each[:, 0])]
            apart = each[1:, 0] > each[:-1, 1]
            first, last = np.concatenate([[True], apart]), np.concatenate([apart, [True]])
            runs.append(np.stack([each[first, 0], each[last, 1]], axis=1).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.binary())], names=["content", "runs"])


def _crowded(contents: DataFrame, key, most: int) -> DataFrame:
    """Keys with more different contents than one task sorts."""
    return contents.groupBy(key.alias("many")).agg(F.count("*").alias("different")).where(F.col("different") > most).select("many")


def _sorted_runs(cut: DataFrame, length: int, grain: int) -> DataFrame:
    """Runs of repeated windows of stretches, sorted key by key."""
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (cut.select("key", "content", "weight", "anchor", "data").repartition(parts, "key").sortWithinPartitions("key", "content")
            .mapInArrow(_sorted_out(length, grain), "content long, runs binary"))


def _runs_of_cells(cut: DataFrame, scratch: Scratch, length: int, grain: int, most: int, widths: tuple[int, ...]) -> DataFrame:
    """Runs of repeated windows of stretches, found in their cells; cells of a key with more than ``most`` are split again.

    A stretch has one row, whatever number of its cells hold runs: stretches occur in many texts, and the join that
    takes runs back to them would make as many rows of each occurrence.
    A cell whose key occurs once holds no repeated window.  With one window a cell, cells of one key are equal, so
    the last round leaves no key with more than one.
    """
    cells = scratch.keep(cut.mapInArrow(_in_cells(length, grain, widths[0]), "of long, shift int, key long, content long, "
                                        "weight long, anchor int, data binary"), "cells")
    keys = scratch.keep(cells.groupBy("key").agg(F.sum("weight").alias("total")).where("total > 1").select("key"), "keys")
    contents = scratch.keep(cells.join(keys, "key", "left_semi").groupBy("content").agg(
        F.sum("weight").alias("weight"), F.first("key").alias("key"), F.first("anchor").alias("anchor"),
        F.first("data").alias("data")), "contents")
    if widths[1:]:
        many = scratch.keep(_crowded(contents, F.col("key"), most), "many")
        few = contents.join(many, F.col("key") == F.col("many"), "left_anti")
        runs = scratch.keep(_sorted_runs(few, length, grain), "runs")
        if not many.isEmpty():
            rest = contents.join(many, F.col("key") == F.col("many"), "left_semi")
            runs = runs.union(_runs_of_cells(rest, scratch, length, grain, most, widths[1:]))
    else:
        runs = scratch.keep(_sorted_runs(contents, length, grain), "runs")
    found = cells.select("of", "shift", "content").join(runs, "content").groupBy("of").agg(
        F.collect_list(F.struct("shift", "runs")).alias("cells"))
    found = scratch.keep(found.mapInArrow(_of_stretches, "content long, runs binary"), "runs")
    scratch.drop(cells)
    return found


def _by_document(contents: DataFrame) -> DataFrame:
    """The stretches to cut out of each chosen document."""
    return contents.groupBy("at.ref", "at.row").agg(F.collect_list(F.struct(
        F.col("at.key").alias("key"), "content", "weight", F.col("at.start").alias("start"), F.col("at.n").alias("n"),
        F.col("at.anchor").alias("anchor"))).alias("wanted"))


def _finished(length: int):
    def run(batches):
        for batch in batches:
            texts = text_array(batch, "text")
            found = batch.column(batch.schema.get_field_index("found")).to_pylist()
            out = ([], [], [], [], [])
            for i, spans in enumerate(found):
                data = np.frombuffer(texts[i].as_py().encode(), dtype=np.uint8)
                cover = np.zeros(len(data) + 1, dtype=np.int32)
                for s in spans or ():
                    runs = np.frombuffer(s["runs"], dtype=np.int32).reshape(-1, 2).astype(np.int64)
                    np.add.at(cover, s["start"] + runs[:, 0], 1)
                    np.add.at(cover, s["start"] + runs[:, 1] + length - 1, -1)
                gone = np.cumsum(cover[:-1], out=cover[:-1]) > 0
                kept = data[~gone].tobytes()
                for column, value in zip(out, (len(data), int(gone.sum()), len(_runs(gone)), hashlib.sha256(kept).hexdigest(),
                                               kept.decode(errors="replace"))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return run


def without_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, grain: int = GRAIN,
                    most: int = STRETCHES_PER_TASK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) for every row of (doc_id, text).

    ``text`` is what stays of the text; a character that a removed run cuts apart becomes U+FFFD there, while
    ``kept_sha256`` is of the exact bytes.
    A byte is removed if some string of ``length`` bytes over it starts anywhere else too, in this or another
    row; a repeated row is another row.  A null text is empty.  Other columns are ignored.  Texts, n-grams and
    windows are told apart by 64-bit hashes.
    """
    ref = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(F.coalesce(F.col("doc_id"), ref).alias("row"), ref.alias("ref"), "text")

    listed = texts.mapInArrow(_listed(length, grain), f"row long, ref long, stretches {_STRETCHES}")
    once = listed.groupBy("ref").agg(F.count("*").alias("copies"), F.min("row").alias("row"),
                                     F.first("stretches").alias("stretches"))
    items = scratch.keep(once.select("ref", "row", "copies", F.explode("stretches").alias("s"))
                         .select("ref", "row", "copies", "s.*"), "stretches")

    keys = items.groupBy("key").agg(F.sum("copies").alias("total")).where("total > 1").select("key")
    keys = scratch.keep(keys, "keys")  # so that the join below has no aggregate on its side and can be split
    shared = scratch.keep(items.join(keys, "key", "left_semi"), "shared")
    contents = shared.groupBy("content").agg(
        F.sum("copies").alias("weight"), F.min(F.struct("ref", "row", "start", "n", "anchor", "key")).alias("at"))
    contents = scratch.keep(contents, "contents")
    many = scratch.keep(_crowded(contents, F.col("at.key"), most), "many")

    def cut(chosen: DataFrame) -> DataFrame:
        return texts.join(_by_document(chosen), ["ref", "row"]).select("text", "wanted").mapInArrow(
            _cut_out(length), "key long, content long, weight long, anchor int, data binary")

    few = contents.join(many, F.col("at.key") == F.col("many"), "left_anti")
    runs = scratch.keep(_sorted_runs(cut(few), length, grain), "runs")
    if not many.isEmpty():
        rest = contents.join(many, F.col("at.key") == F.col("many"), "left_semi")
        runs = runs.union(_runs_of_cells(cut(rest), scratch, length, grain, most, CELLS))

    found = (shared.select("ref", "start", "content").join(runs, "content")
             .groupBy("ref").agg(F.collect_list(F.struct("start", "runs")).alias("found")))
    rows = spread_join(docs.select("doc_id", ref.alias("ref"), "text"), found, "ref", "left")  # copies of a text have one ref
    rows = rows.select("doc_id", "text", "found")
    return rows.mapInArrow(_finished(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
