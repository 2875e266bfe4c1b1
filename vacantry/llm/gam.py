"""Quality classifier: a generalised additive model with pairwise interactions over text statistics.

Shallow trees are boosted in turn, one feature at a time, on binned features; their sum is one lookup table
per feature.  Pairs whose tables would explain most of what is left get two-dimensional tables the same way.
A score is the logistic of a sum of table entries, one bin look-up per feature and pair, taken for whole
Arrow batches at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantry.llm.blocks import blocks
from vacantry.llm.labelled import MAX_TRAIN, bounded, fresh, labelled_sample
from vacantry.llm.text_stats import block_stats

RATIOS = (("word_chars", "n_words"), ("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"),
          ("n_repeat_words", "n_words"), ("n_upper", "n_letters"), ("n_letters", "word_chars"),
          ("n_digits", "word_chars"), ("n_marks", "n_words"), ("n_shouts", "n_words"), ("n_distinct", "n_words"),
          ("n_words", "n_lines"))
N_FEATURES = len(RATIOS) + 1


def feature_matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of features; a ratio over nothing is 0, the last feature is the logarithm of the word count."""
    cols = [np.divide(stats[a], stats[b], out=np.zeros(len(stats[a])), where=stats[b] > 0) for a, b in RATIOS]
    return np.stack([*cols, np.log1p(stats["n_words"])], axis=1)


@dataclass(frozen=True)
class Gam:
    """``cuts[f]``: inner bin edges; ``tables[f]``: one value per bin; ``pairs``: (f, g, table of both bins)."""

    bias: float
    cuts: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Likelihood of label 1 for rows of features."""
        b = self.bins(x)
        total = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            total += table[b[:, f]]
        for f, g, table in self.pairs:
            total += table[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Leaf value of each bin of a tree grown on summed gradients and curvatures per bin."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
        gain[(hl < least) | (hr < least)] = -1
        k = int(np.argmax(gain))
        if gain[k] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            return np.concatenate([_tree(g[:k + 1], h[:k + 1], depth - 1, least),
                                   _tree(g[k + 1:], h[k + 1:], depth - 1, least)])
    return np.full(len(g), g.sum() / (h.sum() + 1))


def _plane(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """Best table with one cut on each axis, and its gain."""
    def corner(a):
        return np.cumsum(np.cumsum(a, axis=0), axis=1)

    cg, ch = corner(g), corner(h)
    tg, th = cg[-1, -1], ch[-1, -1]
    quads = []
    for c, t in ((cg, tg), (ch, th)):
        a = c[:-1, :-1]
        quads.append((a, c[:-1, -1:] - a, c[-1:, :-1] - a, t - c[:-1, -1:] - c[-1:, :-1] + a))
    gain = sum(q * q / (w + 1) for q, w in zip(*quads))
    gain = np.where(np.minimum.reduce(quads[1]) >= least, gain, -1)
    if not gain.size or gain.max() <= tg * tg / (th + 1):
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [q[i, j] / (w[i, j] + 1) for q, w in zip(*quads)]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return out, float(gain[i, j] - tg * tg / (th + 1))


def fit(x: np.ndarray, y: np.ndarray, max_bins: int = 32, rounds: int = 150, n_pairs: int = 6, rate: float = 0.15,
        depth: int = 2, least: float = 0.5) -> Gam:
    """Boosts the model on rows of features and 0/1 labels.

    No rows give 0.5 everywhere; rows of one label only give a constant near that label.
    """
    n = len(y)
    bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    q = np.linspace(0, 1, max_bins + 1)[1:-1]
    cuts = tuple(np.unique(np.quantile(x[:, f], q, method="inverted_cdf")) if n else np.zeros(0)
                 for f in range(x.shape[1]))
    tables = tuple(np.zeros(len(c) + 1) for c in cuts)
    model = Gam(bias, cuts, tables, ())
    if not 0 < y.sum() < n:
        return model
    b = model.bins(x)
    total = np.full(n, bias)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(tables):
            g, h = slopes()
            size = len(table)
            step = rate * _tree(np.bincount(b[:, f], g, size), np.bincount(b[:, f], h, size), depth, least)
            table += step
            total += step[b[:, f]]

    def both(f, g_):
        g, h = slopes()
        shape = (len(tables[f]), len(tables[g_]))
        cell = b[:, f] * shape[1] + b[:, g_]
        return (np.bincount(cell, g, shape[0] * shape[1]).reshape(shape),
                np.bincount(cell, h, shape[0] * shape[1]).reshape(shape))

    found = [(_plane(*both(f, g), least)[1], f, g) for f in range(x.shape[1]) for g in range(f)]
    pairs = [(f, g, np.zeros((len(tables[f]), len(tables[g]))))
             for gain, f, g in sorted(found, key=lambda t: (-t[0], t[1:]))[:n_pairs] if gain > 0]
    for _ in range(rounds // 3):
        for f, g, table in pairs:
            step = rate * _plane(*both(f, g), least)[0]
            table += step
            total += step[b[:, f], b[:, g]]
    return Gam(bias, cuts, tables, tuple(pairs))


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, label, f0, f1, ...) of labelled texts."""
    names = [f"f{i}" for i in range(N_FEATURES)]

    def run(batches):
        for batch in batches:
            for rows, block in blocks(batch, "text"):
                x = feature_matrix(block_stats(block))
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(x[:, i]) for i in range(N_FEATURES))],
                    names=["doc_id", "label", *names])

    return docs.select("doc_id", "label", "text").mapInArrow(
        run, "doc_id long, label int, " + ", ".join(f"{n} double" for n in names))


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, max_train: int = MAX_TRAIN, **how) -> Gam:
    """Model from at most ``max_train`` labelled texts whose ids meet ``where``."""
    rows = bounded(_features(labelled_sample(docs, labels, "quality", where, max_train)), max_train, "doc_id", "f0", "f1")
    x = rows[[f"f{i}" for i in range(N_FEATURES)]].to_numpy(dtype=float)
    return fit(x, rows["label"].to_numpy(dtype=float), **how)


def scored(docs: DataFrame, model: Gam, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows with a last column ``score`` from 0 to 1, higher where label 1 is likelier.

    A null text counts as empty and gets the score of a text without words.  Equal texts get equal scores.
    If the rows have such a column, the new one gets underscores in front.
    """
    keep = [c for c in docs.columns if c not in drop]
    name, = fresh(keep, "score")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for rows, block in blocks(batch, text):
                part = batch.slice(rows.start, rows.stop - rows.start)
                score = model.score(feature_matrix(block_stats(block)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(batch.schema.get_field_index(c)) for c in keep), pa.array(score)], names=[*keep, name])

    return docs.mapInArrow(run, schema)


def held_out(modulus: int, value: int) -> Column:
    """Whether the CRC-32 of the id's digits leaves ``value``; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == value, F.lit(False))
