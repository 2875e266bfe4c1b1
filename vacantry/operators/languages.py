"""Language requirements in descriptions and the language filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.staging import computed_once
from vacantry.functions.text import any_phrase, clauses, literal_map


def _alias_index(with_names: bool) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, (name, aliases) in enumerate(lx.LANGUAGES.items()):
        for alias in ([name.lower()] if with_names else []) + aliases:
            out.setdefault(alias.lower(), i)
    return out


def names_in(text: Column) -> Column:
    """Words of a text, in lower case, that name a language; each once."""
    aliases = F.array(*[F.lit(a) for a in _alias_index(with_names=True)])
    return F.array_intersect(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), aliases)


def languages_in(text: Column) -> Column:
    """Languages named in a text, in dictionary order.

    Every alias is one word, so the text's words are looked up in a hash set; no pattern
    with an alternative per alias runs over the text.
    """
    index = _alias_index(with_names=True)
    places = F.array_sort(F.array_distinct(F.transform(names_in(text), lambda h: literal_map(index)[h])))
    names = F.array(*[F.lit(n) for n in lx.LANGUAGES])
    return F.transform(places, lambda p: F.get(names, p))


def languages_between(text: Column, before: str, after: str) -> Column:
    """Languages named with the given edges; patterns run only where a word was found."""
    index = _alias_index(with_names=True)

    def edged(name):
        aliases = [a for a, i in index.items() if list(lx.LANGUAGES)[i] == name]
        return any_phrase(aliases, before, after)

    patterns = F.create_map(*[x for n in lx.LANGUAGES for x in (F.lit(n), F.lit(edged(n)))])
    return F.filter(languages_in(text), lambda n: F.rlike(text, patterns[n]))


def _given(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("required", "nice")]


def sentence_requirements(df: DataFrame, text: str) -> DataFrame:
    """Adds required and nice: the wording of the naming sentence decides.

    A sentence with nice-to-have wording never makes a language required; a language
    required anywhere is not also listed as nice.
    """
    # the whole text's words are looked up once; then only clauses that hold one of the names found are read
    given = _given(df)
    df = computed_once(df.withColumn("_names", names_in(F.col(text))), given)
    listed = F.when(F.size("_names") > 0, clauses(F.col(text))).otherwise(F.array().cast("array<string>"))
    naming = F.filter(listed, lambda s: F.exists("_names", lambda a: F.contains(F.lower(s), a)))
    named = F.filter(
        F.transform(naming, lambda s: F.struct(s.alias("s"), languages_in(s).alias("langs"))),
        lambda x: F.size(x["langs"]) > 0)
    graded = F.transform(named, lambda x: F.struct(
        x["langs"].alias("langs"),
        F.when(x["s"].rlike(lx.LANGUAGE_NICE_CONTEXT), F.lit("nice"))
        .when(x["s"].rlike(lx.LANGUAGE_REQUIRED_CONTEXT)
              | x["s"].rlike(lx.LANGUAGE_GENERAL_CONTEXT), F.lit("required")).alias("grade")))

    def of(grade):
        return F.array_distinct(F.flatten(F.transform(
            F.filter("_graded", lambda x: x["grade"] == grade), lambda x: x["langs"])))

    return computed_once(
        df.withColumn("_graded", graded).withColumn("required", of("required"))
        .withColumn("nice", F.array_except(of("nice"), "required")).drop("_graded", "_names"), given)


def proximity_requirements(df: DataFrame, text: str) -> DataFrame:
    """Adds required and nice: wording within 80 characters of the language name."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))

    def near(words, name):
        w, n = words, rf"\b{name.lower()}\b"
        return body.rlike(rf"(?i){w}[^.\n]{{0,80}}{n}|{n}[^.\n]{{0,80}}{w}")

    def listed(words):
        # the proximity test runs only for languages the text names at all
        return F.array_compact(F.array(*[
            F.when(F.array_contains("_named", n) & near(words, n), F.lit(n)) for n in lx.LANGUAGES]))

    return computed_once(
        df.withColumn("_named", languages_in(body))
        .withColumn("required", listed(lx.PROXIMITY_REQUIRED))
        .withColumn("nice", F.array_except(listed(lx.PROXIMITY_NICE), "required")).drop("_named"), _given(df))


def phrase_requirements(df: DataFrame, text: str) -> DataFrame:
    """Adds required and nice from fixed requirement phrases that end in a language."""
    names = "|".join(lx.LANGUAGES)
    body = F.coalesce(F.col(text), F.lit(""))

    def found(*patterns):
        hits = [F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in patterns]
        return F.array_distinct(F.transform(F.concat(*hits), lambda h: F.initcap(h)))

    required = found(
        rf"(?i)(?:Required|Requirement|Must|Fluent|Proficient|Mandatory|Essential)[^.]*?"
        rf"(?:in|speak|speaking|language|fluent|proficient)[^.]*?\b({names})\b",
        rf"(?i)(?:Required|Requirements):\s*({names})")
    nice = found(
        rf"(?i)(?:Nice|Plus|Bonus|Preferred|Optional|Good to have)[^.]*?"
        rf"(?:to have|skill|language|speak|speaking)[^.]*?\b({names})\b",
        rf"(?i)({names})[^.]*?(?:is a plus|is nice to have|nice to have)")
    return df.withColumn("required", required).withColumn("nice", F.array_except(nice, "required"))


VARIANTS = {
    "sentence": sentence_requirements,
    "proximity": proximity_requirements,
    "phrase": phrase_requirements,
}


def language_filter(required: Column, speaks: list[str], excluded: list[str]) -> Column:
    """Struct (verdict, reason): FAIL only on an explicit exclusion, UNKNOWN when unconfirmed."""
    def among(names):
        low = [n.lower() for n in names]
        return lambda x: F.lower(x).isin(low)

    blocked = F.filter(required, among(excluded))
    missing = F.filter(required, lambda x: ~among(speaks)(x))
    none = F.size(required) == 0
    verdict = (
        F.when(none, F.lit("PASS")).when(F.size(blocked) > 0, F.lit("FAIL"))
        .when(F.size(missing) > 0, F.lit("UNKNOWN")).otherwise(F.lit("PASS")))
    reason = (
        F.when(none, F.lit("No language requirements detected in JD"))
        .when(F.size(blocked) > 0, F.concat(
            F.lit("JD requires "), F.array_join(blocked, ", "), F.lit(" (user does not speak it/them)")))
        .when(F.size(missing) > 0, F.concat(
            F.lit("Confirm proficiency in "), F.array_join(missing, ", ")))
        .otherwise(F.concat(
            F.lit("JD requires "), F.array_join(required, ", "), F.lit(" (user speaks all)"))))
    return F.struct(verdict.alias("verdict"), reason.alias("reason"))


def strict_language_filter(required: Column, language: str) -> Column:
    """True when nothing is required or everything required is this one language."""
    return F.forall(required, lambda x: F.lower(x) == language.lower())
