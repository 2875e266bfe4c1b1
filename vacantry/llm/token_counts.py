"""Token counts of unigram vocabularies by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at a character; dynamic
programming keeps, for each end, the best score and its piece count, never the pieces.  The tie rule is the
tokenizer's: of equal scores the longest last piece stays, as it is found first from the left.  A character
that no single-character piece covers may stand alone at the unknown score and counts as its UTF-8 bytes
where the vocabulary falls back to bytes.  Pieces hold spaces only at their front, so each run of spaces with
the characters after it is solved on its own, once per distinct form and worker.  Scores are summed in
double precision, exactly for vocabularies with integer scores.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from vacantry.llm.blocks import text_array

SPACE_MARK = "▁"
CACHED = 1 << 19
_NONE = float("-inf")
_UNIT = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")


class Vocabulary:
    """Pieces and scores of a unigram model."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = False, dummy_prefix: bool = True):
        import ahocorasick

        for piece in pieces:
            if SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError(f"piece {piece!r} holds a space after its front")
        self.byte_fallback, self.dummy_prefix = byte_fallback, dummy_prefix
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.matcher = ahocorasick.Automaton()
        for piece, score in pieces.items():
            if piece:
                self.matcher.add_word(piece, (len(piece), score))
        if len(self.matcher):
            self.matcher.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        glued = {b for p in pieces for a, b in zip(p, p[1:]) if a.isalpha()}
        self.ends = "".join(c for c in ".,;:!?\n" if c not in glued)
        self.words = _Words(self)

    def solve(self, unit: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation."""
        n = len(unit)
        count, best = [0] * (n + 1), [_NONE] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(unit):
            for end, (length, score) in self.matcher.iter(unit):  # by end, longest first
                start = end + 1 - length
                total = best[start] + score
                if total > best[end + 1]:
                    best[end + 1], count[end + 1] = total, count[start] + 1
            return count[n], best[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.matcher):
            for end, found in self.matcher.iter(unit):
                ends[end].append(found)
        for end in range(n):
            for length, score in ends[end]:
                start = end + 1 - length
                total = best[start] + score
                if total > best[end + 1]:
                    best[end + 1], count[end + 1] = total, count[start] + 1
            total = best[end] + self.unknown
            if unit[end] not in self.single and total > best[end + 1]:
                best[end + 1] = total
                count[end + 1] = count[end] + (len(unit[end].encode()) if self.byte_fallback else 1)
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a whole text; an empty one has none."""
        if not text:
            return 0, 0.0
        if self.dummy_prefix and "  " not in text and SPACE_MARK not in text and text[0] != " " != text[-1]:
            total = sum(map(self.words.__getitem__, text.split(" ")), 0j)
        else:
            marked = (" " + text if self.dummy_prefix else text).replace(" ", SPACE_MARK)
            total = sum((complex(*self.solve(u)) for u in _UNIT.findall(marked)), 0j)
        return int(total.real), total.imag


class _Words(dict):
    """Pieces and score, as one complex number, of words that a single space precedes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.tails: dict[str, complex] = {}

    def __missing__(self, word: str) -> complex:
        if len(self) >= CACHED:
            self.clear()
            self.tails.clear()
        core = word.rstrip(self.vocabulary.ends)
        if core != word and core[-1:].isalpha():  # no piece holds a letter and an end mark after it
            tail = word[len(core):]
            if tail not in self.tails:
                self.tails[tail] = complex(*self.vocabulary.solve(tail))
            got = self[core] + self.tails[tail]
        else:
            got = complex(*self.vocabulary.solve(SPACE_MARK + word))
        if len(word) < 64:
            self[word] = got
        return got


_vocabularies: dict[str, Vocabulary] = {}


def load_vocabulary(path: str) -> Vocabulary:
    """Vocabulary of a public piece model, its scores read as unigram scores; one per worker process."""
    if path not in _vocabularies:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        skip = [model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(size) if not skip[i]}
        _vocabularies[path] = Vocabulary(pieces, any(model.is_byte(i) for i in range(size)))
    return _vocabularies[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score) of every row of (doc_id, text); whole texts, nothing is shuffled.

    A null or empty text has 0 tokens and score 0.  Equal texts get equal counts; other columns are ignored.
    """
    def run(batches):
        vocabulary = load_vocabulary(path)
        for batch in batches:
            got = [vocabulary.count(t.as_py()) for t in text_array(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
