"""Personal data in texts by weak supervision, with DataFrame functions only.

Candidates are the base matches (email, ip, card, phone) and looser ones: long digit groups and long mixed
tokens.  Regex, gazetteer and context labelers vote on every candidate.  Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is and how likely each pattern is personal
data; these likelihoods train a logistic span classifier over span features.  Base matches always count;
the classifier decides on the others.  Both passes over the texts are narrow; what reaches the driver is
one count per combination of votes and features, a fixed number of cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.llm.labelled import fresh, quoted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "secret")
_NAME = "[A-Za-z0-9._%+-]"
# Runs are entered at their start only and never given back, so long runs cost linear time; the matches are
# those of the plain patterns.
EMAIL = rf"(?:(?<!{_NAME})|\G){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Gazetteers and context words.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at")
SECRET_WORDS = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "bearer", "credential")
CONTACT_WORDS = ("mail", "phone", "tel", "call", "fax", "contact", "card", "visa", "account", "iban", "ssn",
                 "address", "telefon", "konto", "teléfono", "cuenta", "téléphone", "compte")
PLAIN_WORDS = ("version", "page", "chapter", "isbn", "figure", "table", "section", "doi", "commit", "issue")

CONTEXT = 32  # characters before a candidate that the context labelers read
_BLOCK = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates the value once and uses it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of non-negative ints, the sum or maximum of all earlier ones (0 at first).

    Taken by blocks of 64, so that a text with very many matches does not cost their square.
    """
    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), join)

    def prefix(whole: Column, totals: Column) -> Column:
        return _let(F.transform(totals, lambda _, b: fold(F.slice(totals, 1, b))), lambda base: F.transform(
            whole, lambda _, i: join(F.get(base, (i / _BLOCK).cast("int")),
                                     fold(F.slice(whole, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))))

    return _let(values, lambda whole: _let(
        F.transform(F.sequence(F.lit(0), ((F.size(whole) - 1) / _BLOCK).cast("int")),
                    lambda b: fold(F.slice(whole, b * _BLOCK + 1, _BLOCK))),
        lambda totals: prefix(whole, totals)))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, value), in code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def spans(p: Column) -> Column:
        steps = F.transform(p["hit"], lambda h, i: F.char_length(h) + F.get(p["gap"], i))
        return _let(_before(steps, _add), lambda at: F.transform(p["hit"], lambda h, i: F.struct(
            (F.get(at, i) + F.get(p["gap"], i)).alias("start"),
            (F.get(at, i) + F.get(p["gap"], i) + F.char_length(h)).alias("end"), h.alias("value"))))

    pair = F.struct(F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"),
                    F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    return F.when(text.rlike(pattern), _let(pair, spans)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _card(value: Column) -> Column:
    return _let(_digits(value), lambda d: F.when(F.char_length(d).between(13, 19), _luhn(d)).otherwise(False))


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"),
                                                 s["end"].alias("end"), s["value"].alias("value")))


def _valued(spans: Column, good: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: good(s["value"]))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def base_spans(text: Column) -> Column:
    """Valid base matches as an array of (kind, start, end, value), by kind in listed order, then by start."""
    valid = {
        "email": (EMAIL, "@", lambda v: F.lit(True)),
        "ip": (IP, ".", lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
        "card": (CARD, None, _card),
        "phone": (PHONE, "+", lambda v: F.char_length(_digits(v)).between(9, 15)),
    }
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    out = []
    for kind, (pattern, mark, good) in valid.items():
        found = _valued(_tagged(matches(text, pattern), kind), good)
        out.append(F.when(F.instr(text, mark) > 0, found).otherwise(empty) if mark else found)
    return F.when(text.rlike("[0-9@]"), F.concat(*out)).otherwise(empty)


def loose_spans(text: Column, base: Column) -> Column:
    """Further candidates apart from the base spans: long digit groups and long tokens of letters and digits."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    numbers = F.filter(_tagged(matches(text, CARD), "number"),
                       lambda s: F.char_length(_digits(s["value"])) >= 9)
    tokens = F.filter(_tagged(matches(text, TOKEN), "secret"),
                      lambda s: s["value"].rlike("[0-9][^0-9]*[0-9]") & s["value"].rlike("[A-Za-z]"))
    apart = F.filter(F.concat(numbers, tokens), lambda s: ~F.exists(
        base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.when(text.rlike("[0-9]"), apart).otherwise(empty)


def _words(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("(?i)(?:" + "|".join(words) + ")")


def judged(text: Column, span: Column) -> dict[str, Column]:
    """Votes of the labelers (v_*: 1 yes, 0 abstains, -1 no) and span features (f_*), all small ints."""
    value, kind = span["value"], span["kind"]
    lead = F.greatest(span["start"] - CONTEXT, F.lit(0))
    context = text.substr(lead + 1, span["start"] - lead)
    n, n_digits = F.char_length(value), F.char_length(_digits(value))
    variety = F.size(F.array_distinct(F.split(F.substring(value, 1, 64), "")))

    def vote(yes: Column, no: Column | None = None) -> Column:
        out = F.when(yes, 1)
        return (out.when(no, -1) if no is not None else out).otherwise(0)

    domain = F.lower(F.substring_index(value, ".", -1))
    gazetteer = (F.when(kind == "email", vote(domain.isin(*DOMAINS), n < 6))
                 .when(kind.isin("card", "number"), vote(value.rlike("^[3-6]"), value.rlike("^0")))
                 .when(kind == "secret", vote(value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"),
                                              value.rlike("^[A-Za-z]+[0-9]{1,4}$|[-/_].*[-/_].*[-/_]")))
                 .when(kind == "phone", vote(value.rlike(r"^\+[1-9]"))).otherwise(0))
    return {
        "v_regex": vote(kind.isin(*BASE) | ((kind == "number") & n_digits.between(13, 19))
                        | ((kind == "secret") & value.rlike("^[A-Za-z0-9]{32,}$")), n_digits > 40),
        "v_gazetteer": gazetteer,
        "v_context": vote(_words(context, SECRET_WORDS + CONTACT_WORDS), _words(context, PLAIN_WORDS)),
        "v_shape": vote(variety >= 8, variety <= 3),
        "v_mark": vote(context.rlike(r"[=:\"'(]\s*$"), context.rlike(r"[#/$€%]\s*$")),
        "f_kind": F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1,
        "f_length": F.least(F.floor(F.log2(n.cast("double"))).cast("int"), F.lit(7)),
        "f_digits": F.least(F.floor(5 * n_digits / n).cast("int"), F.lit(5)),
        "f_variety": F.least((variety / 4).cast("int"), F.lit(5)),
        "f_context": F.when(_words(context, SECRET_WORDS), 2).when(_words(context, CONTACT_WORDS), 1)
        .when(_words(context, PLAIN_WORDS), 3).otherwise(0),
    }


VOTES = ("v_regex", "v_gazetteer", "v_context", "v_shape", "v_mark")
FEATURES = {"f_kind": len(KINDS), "f_length": 8, "f_digits": 6, "f_variety": 6, "f_context": 4}


@dataclass(frozen=True)
class SpanModel:
    """``accuracy``: labeler to its estimated share of right votes; ``weights``: feature to weight per value."""

    prior: float
    accuracy: dict[str, float]
    bias: float
    weights: dict[str, tuple[float, ...]]


def estimate(votes: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float, dict[str, float]]:
    """Expectation-maximisation: likelihood of each vote pattern, prior, and accuracy of each labeler."""
    score = votes.sum(axis=1)
    q = 1 / (1 + np.exp(-score.astype(float)))
    n_values = 3
    for _ in range(rounds):
        prior = (q @ count + 1) / (count.sum() + 2)
        log = np.stack([np.full(len(q), math.log(1 - prior)), np.full(len(q), math.log(prior))])
        right = []
        for j in range(votes.shape[1]):
            table = np.ones((2, n_values))
            for v in range(n_values):
                at = votes[:, j] == v - 1
                table[1, v] += (q * count)[at].sum()
                table[0, v] += ((1 - q) * count)[at].sum()
            table /= table.sum(axis=1, keepdims=True)
            log += np.log(table[:, votes[:, j] + 1])
            cast = prior * (table[1, 2] + table[1, 0]) + (1 - prior) * (table[0, 2] + table[0, 0])
            right.append((prior * table[1, 2] + (1 - prior) * table[0, 0]) / cast)
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return q, float(prior), dict(zip(VOTES, map(float, right)))


def fit(cells: list, steps: int = 400, decay: float = 1.0) -> SpanModel:
    """Span classifier from rows of votes, features and their ``count``; with no rows it accepts nothing."""
    if not cells:
        return SpanModel(0.0, dict.fromkeys(VOTES, 0.5), -10.0, {k: (0.0,) * n for k, n in FEATURES.items()})
    count = np.array([r["count"] for r in cells], dtype=float)
    votes = np.array([[r[v] for v in VOTES] for r in cells])
    q, prior, accuracy = estimate(votes, count)
    at = np.cumsum([0, *FEATURES.values()])
    x = np.zeros((len(cells), at[-1]))
    for j, f in enumerate(FEATURES):
        x[np.arange(len(cells)), at[j] + np.array([r[f] for r in cells])] = 1
    w, bias = np.zeros(at[-1]), 0.0
    for _ in range(steps):  # Newton steps on the diagonal, damped
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        gap, curve = count * (q - p), count * p * (1 - p)
        w += 0.2 * (x.T @ gap - decay * w) / (x.T @ curve + decay)
        bias += 0.2 * gap.sum() / (curve.sum() + decay)
    return SpanModel(prior, accuracy, float(bias),
                     {f: tuple(map(float, w[at[j]:at[j + 1]])) for j, f in enumerate(FEATURES)})


def _spans_of(df: DataFrame, text: Column, base: str, loose: str) -> DataFrame:
    """Adds both span arrays, each fixed before it is used."""
    df = df.withColumn(base, base_spans(text))
    return df.withColumn(loose, loose_spans(text, quoted(base)[0]))


def train_spans(docs: DataFrame) -> SpanModel:
    """Model from the candidates of all texts."""
    rows = _spans_of(docs.select("text").where(F.col("text").rlike("[0-9@]")), F.col("text"), "base", "loose")
    rows = rows.select("text", F.explode(F.concat("base", "loose")).alias("span"))
    cells = rows.select(*[c.alias(k) for k, c in judged(F.col("text"), F.col("span")).items()])
    return fit(cells.groupBy(*VOTES, *FEATURES).count().orderBy(*VOTES, *FEATURES).collect())


def accepts(text: Column, span: Column, model: SpanModel) -> Column:
    """Whether the classifier takes a span for personal data."""
    features = judged(text, span)
    score = F.lit(model.bias)
    for f, weights in model.weights.items():
        score = score + F.get(F.array(*map(F.lit, weights)), features[f])
    return score > 0


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_spans(docs: DataFrame, model: SpanModel, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows with two arrays of spans (kind, start, end, value): the base ones and all of them.

    Both are ordered by kind as in KINDS, then by start; positions are code points, ends exclusive.  A null
    text has none.  Returns the names of the two columns, which get underscores in front where taken.
    """
    names = fresh(docs.columns, "base_spans", "all_spans", "text_or_empty")
    base, every, body = names
    out = docs.withColumn(body, F.coalesce(*quoted(text), F.lit("")))
    col = quoted(body)[0]
    out = _spans_of(out, col, base, every)
    added = F.filter(quoted(every)[0], lambda s: accepts(col, s, model))
    return out.withColumn(every, F.concat(quoted(base)[0], added)).drop(body), [base, every]


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans blot out their union."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def pieces(o: Column) -> Column:
        ends = F.transform(o, lambda s: s["end"])
        return _let(_before(ends, _larger), lambda done: F.concat(
            F.array_join(F.transform(o, lambda s, i: F.when(
                s["start"] >= F.get(done, i),
                F.concat(text.substr(F.get(done, i) + 1, s["start"] - F.get(done, i)), F.lit("<"), s["kind"], F.lit(">")))
                .otherwise("")), ""),
            text.substr(F.array_max(ends) + 1, F.char_length(text))))

    return F.when(F.size(spans) > 0, _let(ordered, pieces)).otherwise(text)


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """The rows with personal data in ``text`` replaced; other columns and null texts stay as they are."""
    out, (_, every) = find_spans(docs, model)
    text = [F.when(F.col("text").isNotNull(), redacted(F.col("text"), quoted(every)[0])).alias("text")
            if c == "text" else quoted(c)[0] for c in docs.columns]
    return out.select(*text)


def digest(docs: DataFrame, model: SpanModel) -> DataFrame:
    """Counts and listed spans per row of (doc_id, text)."""
    out, (base, every) = find_spans(docs.select("doc_id", "text"), model)
    count = [F.size(_of_kind(quoted(base)[0], k)).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *count, F.sha2(_listed(quoted(base)[0]), 256).alias("base_sha256"),
                      _listed(quoted(every)[0]).alias("spans"))
