"""Language of texts by n-gram filters that answer for all languages at once.

Every language has the set of byte n-grams that make up at least MIN_SHARE of its training text.  One table
holds all sets as Bloom filters laid side by side: row i has bit l set if some n-gram of language l hashes
to i.  The AND of an n-gram's rows is the mask of all languages that contain it.  Per text the bits are
counted by language, the counts are corrected for each filter's rate of false hits, and the largest wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.llm.blocks import Block, blocks, mix, text_array

GRAM = 4  # bytes
MIN_SHARE = 1e-4  # so a language has at most 10,000 n-grams
DOCS_PER_LANGUAGE = 4_000
MAX_LANGUAGES = 1_024
HASHES = 3
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text index, n-gram) for each place of each text; n-grams with a gap inside are left out.

    A gap may be the first or last byte, so the starts and ends of words count as characters.
    """
    data = block.data.astype(np.uint32)
    n = max(len(data) - GRAM + 1, 0)
    gram = np.zeros(n, dtype=np.uint32)
    for i in range(GRAM):
        gram = (gram << np.uint32(8)) | data[i:i + n]
    text = np.repeat(np.arange(block.n), np.diff(block.offsets))[:n]
    ok = text == np.repeat(np.arange(block.n), np.diff(block.offsets))[GRAM - 1:GRAM - 1 + n]
    gap = data == 0x20
    for i in range(1, GRAM - 1):
        ok &= ~gap[i:i + n]
    return text[ok], gram[ok]


@dataclass(frozen=True)
class Filters:
    """``table``: bit masks of languages per row, 64 languages a word; ``false``: false-hit rate per language."""

    languages: tuple[str, ...]
    share: np.ndarray
    table: np.ndarray
    false: np.ndarray

    def masks(self, gram: np.ndarray) -> np.ndarray:
        h = mix(gram.astype(np.uint64))
        bits = np.uint64(len(self.table) - 1)
        out = self.table[(h & bits).astype(np.int64)]
        for i in range(1, HASHES):
            out = out & self.table[((h >> np.uint64(20 * i)) & bits).astype(np.int64)]
        return out

    def votes(self, block: Block) -> np.ndarray:
        """Corrected count of n-grams of each text (rows) in each language (columns)."""
        text, gram = grams(block)
        mask = self.masks(gram)
        total = np.bincount(text, minlength=block.n)
        out = np.zeros((block.n, len(self.languages)))
        for k in range(len(self.languages)):
            bit = (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            hits = np.bincount(text[bit.astype(bool)], minlength=block.n)
            out[:, k] = np.maximum(hits - total * self.false[k], 0) / (1 - self.false[k])
        return out


def build(sets: dict[str, list[int]], docs: dict[str, int]) -> Filters:
    """Filters from the n-grams of each language; languages are ordered by name."""
    names = tuple(sorted(sets))
    size = 1 << int(np.clip(np.ceil(np.log2(max(max(map(len, sets.values()), default=1), 1) * 8 * HASHES)), 10, 20))
    table = np.zeros((size, max(-(-len(names) // 64), 1)), dtype=np.uint64)
    false = np.zeros(len(names))
    for k, name in enumerate(names):
        h = mix(np.array(sets[name], dtype=np.uint64))
        word, bit = k // 64, np.uint64(1) << np.uint64(k % 64)
        for i in range(HASHES):
            at = ((h >> np.uint64(20 * i)) & np.uint64(size - 1)).astype(np.int64)
            table[at, word] |= bit
        false[k] = ((table[:, word] & bit) > 0).mean() ** HASHES
    n = np.array([docs.get(x, 0) for x in names], dtype=float)
    return Filters(names, n / max(n.sum(), 1), table, np.minimum(false, 0.99))


def _counts(batches):
    for batch in batches:
        lang = batch.column(1)
        for rows, block in blocks(batch, "text", _FOLD):
            names, code = np.unique(np.array(lang.slice(rows.start, rows.stop - rows.start).to_pylist(), dtype=object),
                                    return_inverse=True)
            text, gram = grams(block)
            key, n = np.unique((code[text].astype(np.uint64) << np.uint64(32)) | gram, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[(key >> np.uint64(32)).astype(np.int64)], pa.string()),
                 pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def train(docs: DataFrame, where: Column | None = None, per_language: int = DOCS_PER_LANGUAGE,
          min_share: float = MIN_SHARE) -> Filters:
    """Filters from about ``per_language`` texts of each language, chosen by a hash of the id.

    Rows without a text, an id or a language are left out.  At most MAX_LANGUAGES languages, the most
    frequent, are learned; what reaches the driver is at most ``1 / min_share`` n-grams for each.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null")
    if where is not None:
        rows = rows.where(where)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return build({}, {})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = rows.where("text is not null").where(place < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    counts = (chosen.select("text", "lang").mapInArrow(_counts, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for k, n in (total or {"": 1}).items() for x in (k, n * min_share)])
    sets: dict[str, list[int]] = {k: [] for k in sizes}
    for r in counts.where(F.col("n") >= least[F.col("lang")]).select("lang", "gram").collect():
        sets[r["lang"]].append(r["gram"])
    return build(sets, sizes)


def predicted(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of (doc_id, text).

    The score is the winner's part of all votes.  A null text and one without a letter are ``und`` at 0, as
    is everything if no language was learned.  Letters without any known n-gram go to the most frequent
    language at 0.  Of equal votes the first language by name wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # at most 2**20 rows

    def run(batches):
        f = shared.value
        for batch in batches:
            for rows, block in blocks(batch, "text", _FOLD):
                part = batch.slice(rows.start, rows.stop - rows.start)
                letters = np.array([_LETTER.search(t.as_py()) is not None for t in text_array(part, "text")])
                names, score = np.full(block.n, UNKNOWN, dtype=object), np.zeros(block.n)
                if f.languages:
                    votes = f.votes(block)
                    best, total = votes.argmax(axis=1), votes.sum(axis=1)
                    best[total == 0] = f.share.argmax()
                    names[letters] = np.array(f.languages, dtype=object)[best[letters]]
                    ok = letters & (total > 0)
                    score[ok] = votes[ok, best[ok]] / total[ok]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)],
                                                 names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
