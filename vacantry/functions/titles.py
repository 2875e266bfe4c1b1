"""Title, seniority and industry normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.folding import compatible, without_marks
from vacantry.functions.staging import by_distinct
from vacantry.functions.text import escape, literal_map, longest_first, squeeze, strip_accents


def _join_phrases(text: Column) -> Column:
    """Known phrases become one word each, longest first.

    The phrases are folded over the text one by one, because an earlier replacement can
    make a later phrase match; a plain substring test keeps the pattern from running
    where its phrase does not occur.
    """
    steps = F.array(*[
        F.struct(F.lit(p).alias("phrase"), F.lit(rf"(?<!\w){escape(p)}(?!\w)").alias("pattern"),
                 F.lit(f" {lx.COMPOUND_PHRASES[p]} ").alias("word"))
        for p in longest_first(lx.COMPOUND_PHRASES)])
    return F.aggregate(steps, text, lambda acc, s: F.when(
        F.contains(acc, s["phrase"]), F.regexp_replace(acc, s["pattern"], s["word"])).otherwise(acc))


def normalize_title(c: Column) -> Column:
    """Canonical title: phrases joined, filler and places dropped, synonyms applied.

    Word order is kept, so "solutions architect" and "architect solutions" differ.
    """
    folded = F.lower(strip_accents(F.coalesce(c, F.lit(""))))
    out = F.regexp_replace(_join_phrases(squeeze(folded)), r"[^\w\s\-]", " ")
    dropped = lx.TITLE_STOPWORDS + lx.TITLE_FILLERS + lx.REMOTE_WORDS + lx.LOCATION_WORDS
    tokens = F.filter(F.split(out, r"\s+"), lambda t: (t != "") & ~t.isin(dropped))
    synonyms = literal_map(lx.TITLE_SYNONYMS)
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(synonyms[t], t)), " ")


def titled_rows(df: DataFrame, column: str) -> DataFrame:
    """Adds ``normalized_title`` and ``seniority`` of a title column, worked out once per distinct title.

    Titles are compatibility-folded first, so ligatures, full-width letters and combining accents read as plain
    letters; only distinct titles that hold other than ASCII characters pass through Python.
    """
    value = F.col("_value")
    folded = by_distinct(df, column, _compatible=compatible(value))
    made = by_distinct(folded, "_compatible", normalized_title=normalize_title(without_marks(value)), seniority=seniority(value))
    return made.drop("_compatible")


def _first_bucket(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    """Bucket, in table order, of the words found by one pass over the text."""
    rank: dict[str, int] = {}
    for i, (_, words) in enumerate(table):
        for w in words:
            rank.setdefault(w, i)
    pattern = r"(?<!\w)(" + "|".join(escape(w) for w in longest_first(rank)) + r")(?!\w)"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    best = F.array_min(F.transform(hits, lambda h: literal_map(rank)[h]))
    names = F.array(*[F.lit(name) for name, _ in table])
    return F.coalesce(F.get(names, best), F.lit("_any"))


def seniority(c: Column) -> Column:
    """First seniority bucket, in table order, with a matching word."""
    return _first_bucket(squeeze(F.lower(F.coalesce(c, F.lit("")))), lx.SENIORITY_TABLE)


def industry(c: Column) -> Column:
    """Exact code, else the first code, in table order, with a matching word."""
    text = squeeze(F.lower(F.coalesce(c, F.lit(""))))
    codes = [name for name, _ in lx.INDUSTRY_TABLE]
    return F.when(text.isin(codes), text).otherwise(_first_bucket(text, lx.INDUSTRY_TABLE))


def candidate_slugs(title: Column) -> Column:
    """Ordered look-up slugs for a title, most specific first."""
    aliases = literal_map(lx.SLUG_ALIASES)
    raw = F.lower(F.trim(F.regexp_replace(F.replace(title, F.lit("_"), F.lit(" ")), r"\s+", " ")))
    base = F.regexp_replace(raw, r"^(senior|lead|principal|staff|chief|head of|junior)\s+", "")
    head = F.split(base, r"\s*(?:\|\||\||–|—|,|:|/|\s-\s|\bat\b)\s*", 2)[0]
    head = F.trim(F.regexp_replace(F.regexp_replace(head, r"\([^)]*\)", ""), r"\s+", " "))
    core = F.when(head != "", head).otherwise(base)
    words = F.filter(F.split(core, " "), lambda w: w != "")
    slugs = F.array(
        aliases[raw], raw, aliases[base], base,
        F.when(head != "", aliases[head]), F.when(head != "", head),
        F.when(F.size(words) > 2, F.array_join(F.slice(words, -2, 2), " ")),
        F.when(F.size(words) > 1, F.element_at(words, -1)),
    )
    return F.array_distinct(F.filter(slugs, lambda s: s.isNotNull() & (s != "")))
