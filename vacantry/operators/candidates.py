"""Candidate profiles from resume text: skills, skill-section items, languages, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.staging import computed_once
from vacantry.functions.text import any_phrase, first_items, literal_map, squeeze
from vacantry.operators.languages import languages_between, names_in

# fixed values: headings
SKILL_HEADING = (r"(?i)^(skills|key skills|technical skills|competencies|expertise|technologies|"
                 r"certifications|licenses|licences|credentials)\s*:?\s*(.*)$")
CREDENTIAL_HEADING = r"(?i)certifications|licen[cs]es|credentials"
OTHER_HEADING = r"(?i)^(?:experience|employment|education|languages|summary|profile|interests|awards)\b"
LANGUAGE_HEADING = r"(?i)^(languages?|sprachen|lingue|langues|idiomas)\b[:\s]*$"
AFTER_LANGUAGES = (r"(?i)^(experience|education|skills|projects|summary|profile|certifications?|"
                   r"employment|work history)\b")
TITLE_HEADING = (r"(?i)^(skills|key skills|technical skills|competencies|expertise|technologies|"
                 r"languages|certifications|licenses|licences|credentials|experience|employment|"
                 r"work history|education|summary|profile|projects)\s*:?.*$")
TERM_BEFORE, TERM_AFTER = r"(?<![\p{L}\p{N}+#.])", r"(?![\p{L}\p{N}+#])"
MAX_TITLES = 15


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _sectioned(df: DataFrame, lines: Column, kind, wanted=None) -> DataFrame:
    """Adds ``_rows``: lines as (line, i, section), the section being the last non-NULL
    ``kind(line)`` at or above the line; only lines that are ``wanted``, if that is given.

    Each head takes the slice of lines down to the next one, so a line is read once however many heads there are.
    """
    heads = F.filter(F.transform("_lines", lambda s, i: F.struct(i.alias("i"), kind(s).alias("k"))),
                     lambda h: h["k"].isNotNull())
    top = F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("k")))

    def below(h, n):
        until = F.coalesce(F.get("_heads", n + 1)["i"], F.size("_lines"))
        return F.transform(F.slice("_lines", h["i"] + 1, until - h["i"]), lambda s, j: F.struct(
            s.alias("line"), (h["i"] + j).alias("i"), h["k"].alias("section")))

    def kept(rows):
        return rows if wanted is None else F.filter(rows, lambda x: wanted(x["line"]))

    return computed_once(df.withColumn("_lines", lines).withColumn("_heads", F.concat(top, heads)).withColumn(
        "_rows", F.flatten(F.transform("_heads", lambda h, n: kept(below(h, n))))).drop("_lines", "_heads"), df.columns)


def skills(resumes: DataFrame, vocabulary) -> DataFrame:
    """(resume_id, term, matched, position): the first spelling of each known term."""
    aliases = F.regexp_extract_all(
        F.col("text"), F.lit(any_phrase(vocabulary.canonical, TERM_BEFORE, TERM_AFTER)), F.lit(1))
    hits = F.array_distinct(F.transform(aliases, lambda a: squeeze(F.lower(a))))
    canonical = literal_map(vocabulary.canonical)
    order = literal_map({a: i for i, a in enumerate(vocabulary.canonical)})
    return (
        resumes.select("resume_id", F.explode(F.transform(hits, lambda a: F.struct(
            canonical[a].alias("term"), a.alias("matched"),
            F.position(a, F.lower(F.col("text"))).alias("position"), order[a].alias("o")))).alias("h"))
        .groupBy("resume_id", F.col("h.term").alias("term"))
        .agg(F.min_by(F.struct("h.matched", "h.position"), "h.o").alias("m"))
        .select("resume_id", "term", "m.matched", (F.col("m.position") - 1).cast("bigint").alias("position"))
    )


def section_items(resumes: DataFrame) -> DataFrame:
    """(resume_id, kind, term): comma-like items listed under a skills or credentials heading."""
    def kind(s):
        t = F.trim(s)
        return (F.when(t.rlike(SKILL_HEADING), F.when(t.rlike(CREDENTIAL_HEADING), F.lit("certification"))
                       .otherwise(F.lit("skill")))
                .when(t.rlike(OTHER_HEADING), F.lit("")))

    def items(x):
        t = F.trim(x["line"])
        body = F.when(t.rlike(SKILL_HEADING), F.regexp_extract(t, SKILL_HEADING, 2)).otherwise(x["line"])
        terms = F.transform(F.split(body, r"[,;|•]"),
                            lambda p: F.lower(F.regexp_replace(F.trim(p), r"^[-*]\s*", "")))
        ok = F.filter(terms, lambda p: F.length(p).between(2, 80) & (F.size(F.split(p, r"\s+")) <= 8)
                      & ~p.rlike(r"[@:]|\b\d{4}\b"))
        return F.transform(ok, lambda p: F.struct(x["section"].alias("kind"), p.alias("term")))

    inside = F.filter("_rows", lambda x: x["section"] != "")
    return (
        _sectioned(resumes, _lines(F.col("text")), kind).select("resume_id", F.posexplode(F.flatten(F.transform(inside, items))).alias("pos", "x"))
        .groupBy("resume_id", F.col("x.term").alias("term"))
        .agg(F.min_by("x.kind", "pos").alias("kind"))
    )


def languages(resumes: DataFrame) -> DataFrame:
    """(resume_id, language, level): a line naming a language with a level, or listing it."""
    def level(s):
        out = F.lit(None).cast("string")
        for name, words in reversed(lx.PROFICIENCY.items()):
            out = F.when(F.lower(s).rlike(any_phrase(words, TERM_BEFORE, TERM_AFTER)),
                         F.lit(name)).otherwise(out)
        return out

    def kind(s):
        return F.when(s.rlike(LANGUAGE_HEADING), F.lit("languages")).when(
            s.rlike(AFTER_LANGUAGES), F.lit(""))

    # the whole text's words are looked up once; then only lines that hold one of the names found are read
    given = resumes.columns
    found = computed_once(resumes.withColumn("_names", names_in(F.coalesce(F.col("text"), F.lit("")))), given)
    lines = F.filter(F.transform(_lines(F.col("text")), lambda s: F.trim(s)), lambda s: s != "")
    lines = F.when(F.size("_names") > 0, lines).otherwise(F.array().cast("array<string>"))
    rows = _sectioned(found, lines, kind, lambda s: F.exists("_names", lambda a: F.contains(F.lower(s), a)))
    named = F.filter(
        F.transform("_rows", lambda x: F.struct(
            x["line"].alias("line"), x["section"].alias("section"),
            languages_between(x["line"], TERM_BEFORE, TERM_AFTER).alias("langs"))),
        lambda x: (F.size(x["langs"]) > 0) & ~x["line"].rlike(LANGUAGE_HEADING))
    leveled = F.transform(named, lambda x: F.struct(x["line"], x["section"], x["langs"], level(x["line"]).alias("level")))
    ok = F.filter(leveled, lambda x: x["level"].isNotNull() | (
        (x["section"] == "languages") & (F.length(x["line"]) <= 40)))
    flat = F.flatten(F.transform(ok, lambda x: F.transform(x["langs"], lambda g: F.struct(
        g.alias("language"), F.coalesce(x["level"], F.lit("unspecified")).alias("level")))))
    return (
        rows.select("resume_id", F.posexplode(flat).alias("pos", "x"))
        .groupBy("resume_id", F.col("x.language").alias("language"))
        .agg(F.min_by("x.level", "pos").alias("level"))
    )


def titles(resumes: DataFrame, limit: int | None = None) -> DataFrame:
    """(resume_id, titles): short lines that read as job titles; all, or the first ``limit``."""
    def kind(s):
        return F.when(s.rlike(TITLE_HEADING), F.lower(F.regexp_extract(s, TITLE_HEADING, 1)))

    lines = F.transform(F.filter(_lines(F.col("text")), lambda s: F.trim(s) != ""), squeeze)
    rows = F.filter("_rows", lambda x: (
        (x["i"] > 0) & (F.length(x["line"]) <= 90) & ~x["line"].rlike(TITLE_HEADING)
        & F.coalesce(x["section"].isin("experience", "employment", "work history"), F.lit(True))
        & ((x["i"] <= 3) | x["line"].rlike(r"(?i)\s[|–—]\s|^(?:role|title):"))
        & ~x["line"].rlike(r"@|https?:") & ~x["line"].rlike(r"[.;]$")))

    def clean(s):
        for pattern in (r"(?i)^(?:role|title):\s*", r"\s*[|@–—]\s*.*$", r"\s+-\s+.*$", r"\s*\(.*\)$"):
            s = F.regexp_replace(s, pattern, "")
        return F.trim(s)

    kept = F.filter(F.transform(rows, lambda x: clean(x["line"])), lambda t: (
        (t != "") & (F.length(t) <= 60) & ~t.rlike(r"\d{4}") & (F.size(F.split(t, " ")) <= 8)))
    keys = F.array_distinct(F.transform("_kept", F.lower))
    first = F.transform(keys, lambda k: F.get(F.filter("_kept", lambda t: F.lower(t) == k), F.lit(0)))
    return (_sectioned(resumes, lines, kind).withColumn("_kept", kept)
            .select("resume_id", first_items(first, limit).alias("titles")))
