"""Counts of whole texts, taken in Arrow tasks: words, symbols, repeated lines and repeated passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vacantry.llm.blocks import NOT_SPACE, Block, blocks, byte_set, keyed, windows
from vacantry.llm.labelled import fresh

REPEAT_WINDOW = 8
_SYMBOLS = byte_set(b"#*$%&|<>")
_UPPER = byte_set(range(0x41, 0x5B))
_LETTERS = byte_set([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_DIGITS = byte_set(range(0x30, 0x3A))
_MARKS = byte_set(b"!?.,;:")
_SHOUTS = byte_set(b"!?")
_LEAD = byte_set([*range(0x80), *range(0xC0, 0x100)])
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_letters",
         "n_digits", "n_marks", "n_shouts", "n_lines", "n_distinct")


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def first_seen(keys: np.ndarray) -> np.ndarray:
    """True at the first occurrence of each key."""
    order = np.argsort(keys, kind="stable")
    out = np.ones(len(keys), dtype=bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = False
    return out


def block_stats(block: Block) -> dict[str, np.ndarray]:
    """One array per name in STATS, one entry per text of the block."""
    starts, ends = block.edges(NOT_SPACE)
    bounds = block.bounds(starts)
    data = block.data
    word_text = np.repeat(np.arange(block.n), np.diff(bounds))
    hashes = block.hashes(starts, ends)

    text, first, key = windows(hashes, bounds, REPEAT_WINDOW)
    hit = first[repeated(keyed(text, key))]
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + REPEAT_WINDOW, -1)
    covered = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(np.cumsum(cover[:-1]) > 0, out=covered[1:])

    newline = byte_set([0x0A])
    line_start, line_end = block.edges(~newline)
    words = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    line_start, line_end = line_start[words > 0], line_end[words > 0]
    line_text = np.repeat(np.arange(block.n), np.diff(block.bounds(line_start)))
    again = ~first_seen(keyed(line_text, block.hashes(line_start, line_end)))
    lead = _LEAD[data]
    return {
        "n_words": np.diff(bounds),
        "word_chars": block.counts(lead & NOT_SPACE[data]),
        "n_symbols": block.counts(_SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_text[again], minlength=block.n),
        "n_repeat_words": covered[bounds[1:]] - covered[bounds[:-1]],
        "n_chars": block.counts(lead),
        "n_upper": block.counts(_UPPER[data]),
        "n_letters": block.counts(_LETTERS[data] & lead),
        "n_digits": block.counts(_DIGITS[data]),
        "n_marks": block.counts(_MARKS[data]),
        "n_shouts": block.counts(_SHOUTS[data]),
        "n_lines": np.bincount(line_text, minlength=block.n),
        "n_distinct": np.bincount(word_text[first_seen(keyed(word_text, hashes))], minlength=block.n),
    }


def with_stats(df: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """The rows with one long column per statistic, and the name each statistic got.

    Names that the rows already have get underscores in front.  A null text counts as empty.  Columns in
    ``drop`` are read for the counts and then left out.
    """
    keep = [c for c in df.columns if c not in drop]
    names = fresh(keep, *STATS)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches):
        for batch in batches:
            for rows, block in blocks(batch, text):
                stats = block_stats(block)
                part = batch.slice(rows.start, rows.stop - rows.start)
                arrays = [part.column(batch.schema.get_field_index(c)) for c in keep]
                arrays += [pa.array(stats[s].astype(np.int64)) for s in STATS]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return df.mapInArrow(run, schema), dict(zip(STATS, names))
