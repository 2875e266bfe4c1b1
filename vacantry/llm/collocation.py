"""Phrase collocation mining over sorted count streams.

1. Every block of texts is cut into pieces and words, and the sequences of up to three words that start at each
   word are sorted and counted: one run of the trigram stream in prefix order, which holds the bigram stream as
   its first two columns.  Runs are dealt out by (first, second) word and merged, so that no word, however
   frequent, meets in one task; runs of single words are dealt out by word and carry the spelling.
2. Sequences that occur too rarely are no candidates and no part of one; the others are stored as count streams.
3. The streams are joined by lockstep merges, never by hash tables: in prefix order (bigrams with their first
   word, trigrams with their first bigram) for the left counts and the counts of extensions to the right, and in
   suffix order (bigrams with their last word, trigrams with their last bigram) for the right counts and the
   counts of extensions to the left.

Words are told apart by 64-bit hashes of language and spelling; arithmetic is exact (38 decimal digits).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantry.llm.blocks import LOWER, Block, blocks, byte_set, keyed, mix
from vacantry.llm.scratch import Scratch

PIECE_ENDS = byte_set([*b".,;:!?", *range(0x0A, 0x0E)])
WORD = ~(PIECE_ENDS | byte_set(b" \t"))
LEAST = 10  # occurrences of a candidate
DROP_PERCENT = 50  # of a phrase's occurrences: one longer candidate with as many replaces it
TOP = 2000  # phrases listed per language
NO_LANGUAGE = "und"
BLOCK = 1 << 21
PART_BYTES = 8 << 20  # of text per part that runs are dealt to
MERGE_ROWS = 1 << 20  # entries gathered before runs are merged
_RUNS = "part int, firsts binary, seconds binary, thirds binary, counts binary, words binary, langs binary, totals binary, spelled binary"
_STREAM = "k int, a long, b long, c long, n long, word string"


def sequences(block: Block, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: start, end, text, the word and the two after it in its piece (0 for none), whether one follows."""
    starts, ends = block.edges(WORD)
    text = np.repeat(np.arange(block.n), np.diff(block.bounds(starts)))
    word = np.maximum(keyed(langs[text], block.hashes(starts, ends)), np.uint64(1))
    stops = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(PIECE_ENDS[block.data], out=stops[1:])
    joined = np.zeros(len(word) + 2, dtype=bool)
    joined[:max(len(word) - 1, 0)] = (stops[starts[1:]] == stops[ends[:-1]]) & (text[1:] == text[:-1])
    after = np.concatenate([word, np.zeros(2, dtype=np.uint64)])
    n = len(word)
    second = np.where(joined[:n], after[1:n + 1], np.uint64(0))
    third = np.where(joined[:n] & joined[1:n + 1], after[2:n + 2], np.uint64(0))
    return starts, ends, text, np.stack([word, second, third]), joined[:n]


def merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``grams`` in prefix order, with the sums of their counts."""
    order = np.lexsort(grams[::-1])
    grams, counts = grams[:, order], counts[order]
    new = np.ones(len(counts), dtype=bool)
    new[1:] = (grams[:, 1:] != grams[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    return grams[:, first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _first_part(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    return (mix(mix(a) + b) % np.uint64(parts)).astype(np.int64)


def _cuts(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _sorted_runs(parts: int):
    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for rows, block in blocks(batch, "text", LOWER, BLOCK):
                own = langs[rows]
                starts, ends, text, grams, joined = sequences(block, own)
                if not len(starts):
                    continue
                words, first, totals = np.unique(grams[0], return_index=True, return_counts=True)
                data = block.data.tobytes()
                spelled = [data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
                lang_of = own[text[first]]
                grams, counts = merged(grams[:, joined], np.ones(int(joined.sum()), dtype=np.int64))
                order, cuts = _cuts(_first_part(grams[0], grams[1], parts), parts)
                word_order, word_cuts = _cuts((mix(words) % np.uint64(parts)).astype(np.int64), parts)
                out = [[] for _ in range(9)]
                for p in range(parts):
                    mine, mine_words = order[cuts[p]:cuts[p + 1]], word_order[word_cuts[p]:word_cuts[p + 1]]
                    if not len(mine) and not len(mine_words):
                        continue
                    run = grams[:, mine]
                    values = (p, run[0].tobytes(), run[1].tobytes(), run[2].tobytes(), counts[mine].astype(np.uint32).tobytes(),
                              words[mine_words].tobytes(), lang_of[mine_words].tobytes(),
                              totals[mine_words].astype(np.uint32).tobytes(), b" ".join([spelled[i] for i in mine_words]))
                    for column, value in zip(out, values):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])],
                                                 names=[f.split()[0] for f in _RUNS.split(", ")])

    return run


class _Merge:
    """Runs of one part, merged whenever many entries have gathered."""

    def __init__(self, rows: int):
        self.runs, self.waiting = [(np.zeros((rows, 0), np.uint64), np.zeros(0, np.int64))], 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.runs.append((grams, counts))
        self.waiting += len(counts)
        if self.waiting > max(MERGE_ROWS, len(self.runs[0][1])):
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        self.runs = [merged(np.concatenate([g for g, _ in self.runs], axis=1), np.concatenate([c for _, c in self.runs]))]
        self.waiting = 0
        return self.runs[0]


def _stream_rows(k: int, grams: np.ndarray, counts: np.ndarray, words: list | None = None) -> pa.RecordBatch:
    n = len(counts)
    columns = [pa.array(g.view(np.int64)) for g in grams[:3]] + [pa.nulls(n, pa.int64())] * (3 - len(grams))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, k, dtype=np.int32)), *columns, pa.array(counts),
         pa.array(words, pa.string()) if words is not None else pa.nulls(n, pa.string())],
        names=[f.split()[0] for f in _STREAM.split(", ")])


def _merged_runs(least: int):
    def run(batches):
        grams, words, spelling = _Merge(3), _Merge(2), {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_buffer() for c in batch.columns[1:]]
                first, second, third, own, lang = (np.frombuffer(row[k], np.uint64) for k in (0, 1, 2, 4, 5))
                grams.add(np.stack([first, second, third]), np.frombuffer(row[3], np.uint32).astype(np.int64))
                if len(own):
                    words.add(np.stack([own, lang]), np.frombuffer(row[6], np.uint32).astype(np.int64))
                    for w, s in zip(own.tolist(), row[7].to_pybytes().split(b" ")):
                        spelling.setdefault(w, s)
        own, totals = words.done()
        if not len(totals):
            return
        langs, where = np.unique(own[1], return_inverse=True)
        sums = np.zeros(len(langs), np.int64)
        np.add.at(sums, where, totals)
        yield _stream_rows(0, langs[None], sums)
        often = totals >= least
        yield _stream_rows(1, own[:, often], totals[often], [spelling[w].decode() for w in own[0, often].tolist()])
        triples, counts = grams.done()
        pairs = np.flatnonzero(np.append(True, (triples[:2, 1:] != triples[:2, :-1]).any(axis=0))) if len(counts) else []
        if not len(pairs):
            return
        sums = np.add.reduceat(counts, pairs)
        yield _stream_rows(2, triples[:2, pairs][:, sums >= least], sums[sums >= least])
        often = (counts >= least) & (triples[2] > 0)
        yield _stream_rows(3, triples[:, often], counts[often])

    return run


def count_streams(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Stored counts (k, a, b, c, n, word): for k = 0 all words of language a, then for sequences of k words.

    Only sequences with at least ``least`` occurrences are listed; a, b, c are the words' hashes, and for k = 1 b is
    the language and ``word`` the spelling.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    runs = docs.select(_lang_key().alias("lang"), "text").mapInArrow(_sorted_runs(parts), _RUNS)
    return scratch.keep(runs.repartitionById(parts, F.col("part")).mapInArrow(_merged_runs(least), _STREAM), "streams")


def _lang() -> Column:
    return F.coalesce(F.col("lang"), F.lit(NO_LANGUAGE))


def _lang_key() -> Column:
    return F.xxhash64(_lang())


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in exact arithmetic."""
    a, left, right = (f"CAST({x} AS DECIMAL(18, 0))" for x in (a, left, right))
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({a} * {a})) DIV ({left} * {right})")


def candidates(streams: DataFrame, scratch: Scratch, drop_percent: int = DROP_PERCENT) -> DataFrame:
    """(lang_key, phrase, a, l, r, score) of all phrases of two and three words that no longer one replaces."""
    def stream(k, *names):
        return streams.where(F.col("k") == k).select(*names)

    def of_word(side, key):
        return stream(1, F.col("a").alias(key), F.col("n").alias(f"f_{side}"), F.col("word").alias(side),
                      F.col("b").alias(f"lang_{side}")).hint("merge")

    triples = stream(3, "a", "b", "c", "n")
    pairs = (stream(2, "a", "b", "n").join(of_word("x", "a"), "a")  # prefix order
             .join(of_word("y", "b").drop("lang_y"), "b")  # suffix order
             .select("a", "b", "n", F.col("lang_x").alias("lang_key"), "x", "f_x", "y", "f_y"))
    pairs = scratch.keep(pairs, "pairs")

    right = triples.groupBy("a", "b").agg(F.max("n").alias("most"))
    left = triples.groupBy(F.col("b").alias("a"), F.col("c").alias("b")).agg(F.max("n").alias("most"))
    longer = right.union(left).groupBy("a", "b").agg(F.max("most").alias("most"))
    two = (pairs.join(longer.hint("merge"), ["a", "b"], "left")
           .where(f"most IS NULL OR 100 * CAST(most AS DECIMAL(18, 0)) < {drop_percent} * CAST(n AS DECIMAL(18, 0))")
           .select("lang_key", F.concat_ws(" ", "x", "y").alias("phrase"), F.col("n").alias("a"), F.col("f_x").alias("l"),
                   F.col("f_y").alias("r"), _score("n", "f_x", "f_y").alias("score")))

    last = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("f_yz"), F.col("y").alias("z"),
                        F.col("f_y").alias("f_z"))
    first = pairs.select("lang_key", "a", "b", F.col("n").alias("f_xy"), "x", "f_x", "y")
    three = (triples.join(first.hint("merge"), ["a", "b"])  # prefix order
             .join(last.hint("merge"), ["b", "c"])  # suffix order
             .withColumn("cut_1", _score("n", "f_x", "f_yz")).withColumn("cut_2", _score("n", "f_xy", "f_z")))
    low = F.col("cut_2") < F.col("cut_1")
    three = three.select("lang_key", F.concat_ws(" ", "x", "y", "z").alias("phrase"), F.col("n").alias("a"),
                         F.when(low, F.col("f_xy")).otherwise(F.col("f_x")).alias("l"),
                         F.when(low, F.col("f_z")).otherwise(F.col("f_yz")).alias("r"),
                         F.least("cut_1", "cut_2").alias("score"))
    return two.union(three)


def collocations(docs: DataFrame, scratch: Scratch, least: int = LEAST, top: int | None = TOP,
                 drop_percent: int = DROP_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language of (text, lang).

    A-Z count as lower case; a null lang is ``und``, a null text is empty, and a text without words adds nothing.
    Repeated rows count again.  Rows of one score and count are ranked by phrase.  ``top`` None lists all phrases.
    Other columns are ignored; an empty table has no phrases.  A text is held whole in one task, with about fifty
    bytes for each of its bytes.
    """
    streams = count_streams(docs, scratch, least)
    order = Window.partitionBy("lang_key").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = candidates(streams, scratch, drop_percent).withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = streams.where("k = 0").groupBy(F.col("a").alias("lang_key")).agg(F.sum("n").alias("n"))
    names = docs.groupBy(_lang().alias("lang")).agg(F.first(_lang_key()).alias("lang_key"))
    return (ranked.join(totals, "lang_key").join(names, "lang_key")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
