"""Quality rules as a learned decision list.

Sequential covering: each rule is a conjunction of thresholds on text statistics, grown on two thirds of a
labelled sample by information gain, pruned on the rest, and kept if it is precise there.  The texts a rule
covers leave the sample before the next rule is grown.  The finished list is one ordered Spark conditional
expression; applying it shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.llm.labelled import MAX_TRAIN, bounded, fresh, labelled_sample, quoted
from vacantry.llm.text_stats import with_stats

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "n_letters"), "letters": ("n_letters", "word_chars"),
    "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words"),
    "shouts": ("n_shouts", "n_words"), "distinct": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: float


Rule = tuple[Condition, ...]


def features(names: dict[str, str]) -> dict[str, Column]:
    """Scale-free features of the statistics; a ratio over nothing is 0."""
    col = {k: quoted(v)[0] for k, v in names.items()}
    out = {k: F.when(col[b] > 0, col[a] / col[b]).otherwise(F.lit(0.0)) for k, (a, b) in RATIOS.items()}
    return out | {"words": col["n_words"].cast("double")}


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for c in rule:
        hit &= (x[c.feature] > c.threshold) == c.above
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int, max_cuts: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < max_conditions and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        base, best, best_gain = np.log2(p0 / (p0 + n0)), None, 1e-9
        for name in sorted(x):
            v, b = x[name][inside], bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, max_cuts + 1), method="inverted_cdf"))[:-1]
            if not len(cuts):
                continue
            order = np.argsort(v, kind="stable")
            n_le = np.searchsorted(v[order], cuts, "right")
            p_le = np.concatenate([[0], np.cumsum(b[order])])[n_le]
            for above, p, n in ((True, p0 - p_le, (p0 + n0 - n_le) - (p0 - p_le)), (False, p_le, n_le - p_le)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Condition(name, above, float(cuts[k])), gain[k]
        if best is None:
            break
        rule += (best,)
        inside = _covers(rule, x, len(bad))
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the rule with the best worth on held-back texts, its precision and hits there."""
    best = (rule, 0.0, 0)
    top = -2.0
    for k in range(len(rule), 0, -1):
        hit = _covers(rule[:k], x, len(bad))
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= top:
            top, best = worth, (rule[:k], p / (p + n) if p + n else 0.0, p)
    return best


def learn_rules(sample, max_rules: int = 24, max_conditions: int = 4, min_precision: float = 0.95,
                min_hits: int = 3, max_cuts: int = 64) -> list[Rule]:
    """Ordered rules that name low quality.  ``sample``: pandas frame of features, ``label`` and ``fold``.

    No rules come from an empty sample or from one without both labels.
    """
    names = [c for c in sample.columns if c not in ("label", "fold")]
    x = {c: sample[c].to_numpy(dtype=float) for c in names}
    bad, held = sample["label"].to_numpy() == 0, sample["fold"].to_numpy() == 0
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    if not len(bad) or bad.all() or not bad.any():
        return rules
    while len(rules) < max_rules:
        grow, prune = left & ~held, left & held
        if not bad[grow].any() or bad[grow].all():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_conditions, max_cuts)
        rule, precision, hits = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        if not rule or precision < min_precision or hits < min_hits:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def rejected(rules: list[Rule], feature: dict[str, Column]) -> Column:
    """Number of the first rule that covers the row, from 0; null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for c in rule:
            test = test & ((feature[c.feature] > c.threshold) if c.above else (feature[c.feature] <= c.threshold))
        out = out.when(test, F.lit(i))
    return out


def train_rules(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **how) -> list[Rule]:
    """Rules from at most ``max_train`` labelled texts; every third one, by hash, is held back for pruning."""
    sample, names = with_stats(labelled_sample(docs, labels, "quality", max_rows=max_train), drop=("text",))
    cols = [c.alias(k) for k, c in features(names).items()]
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).alias("fold")
    rows = bounded(sample.select("doc_id", *cols, "label", fold), max_train, "doc_id", "words", "word_length")
    return learn_rules(rows.drop(columns="doc_id"), **how)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows with statistics, ``base_failed``, ``rule`` (first rule that covers it, else null) and ``kept``.

    A null or empty text has no words and fails the base test.  Equal texts get equal verdicts.  Columns of
    the rows with such names stay, and the new ones get underscores in front (see ``fresh``).
    """
    out, names = with_stats(docs, text, drop)
    n_words, repeats = quoted(names["n_words"], names["n_repeat_words"])
    failed, rule, kept = fresh(out.columns, "base_failed", "rule", "kept")
    out = out.withColumn(failed, (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words))
    out = out.withColumn(rule, rejected(rules, features(names)))
    return out.withColumn(kept, ~quoted(failed)[0] & quoted(rule)[0].isNull())


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that the base test and the rules keep, with their own columns only."""
    out = judge(docs, rules)
    return out.where(quoted(out.columns[-1])[0]).select(*quoted(*docs.columns))
