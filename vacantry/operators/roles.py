"""Role classification and query planning from explicit preferences.

Preferences are small and live on the driver; they compile into one alternation per
list, so classifying a posting is a narrow expression and never a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.fields import host_of
from vacantry.functions.staging import computed_once
from vacantry.functions.text import (any_phrase, every_phrase_at, fold_phrase, is_blank,
                                     literal_map)


@dataclass(frozen=True)
class TitleFamily:
    name: str
    title_terms: tuple[str, ...]
    exempt_terms: tuple[str, ...] = ()
    summary: str = "excluded title family"


@dataclass(frozen=True)
class Taxonomy:
    primary: tuple[str, ...] = ()
    adjacent: tuple[str, ...] = ()
    leadership: tuple[str, ...] = ()
    conditional: tuple[str, ...] = ()
    excluded_titles: tuple[str, ...] = ()
    excluded_duties: tuple[str, ...] = ()
    families: tuple[TitleFamily, ...] = ()
    expansions: tuple[str, ...] = field(default=())

    def groups(self) -> list[tuple[str, tuple[str, ...]]]:
        return [("Primary role", self.primary), ("Adjacent role", self.adjacent),
                ("Leadership progression", self.leadership), ("Conditional", self.conditional)]


def _folded(term: str) -> str:
    return " ".join(term.lower().split())


def _best_hit(text: Column, ranks: dict[str, int], longest: bool) -> Column:
    """Hit phrase that is longest (or listed first); NULL when none occurs."""
    if not ranks:
        return F.lit(None).cast("string")
    hits = F.regexp_extract_all(text, F.lit(every_phrase_at(ranks)), F.lit(1))
    rank = literal_map(ranks)
    size = (lambda h: -F.length(h)) if longest else (lambda h: F.lit(0))
    best = F.array_min(F.transform(hits, lambda h: F.struct(
        size(h).alias("size"), rank[h].alias("rank"), h.alias("term"))))
    return best["term"]


def _first_phrase(text: Column, terms: tuple[str, ...]) -> Column:
    ranks: dict[str, int] = {}
    for i, t in enumerate(terms):
        if t.strip():
            ranks.setdefault(_folded(t), i)
    hit = _best_hit(text, ranks, longest=False)
    return literal_map({_folded(t): t for t in reversed(terms) if t.strip()})[hit] if ranks else hit


def exclusion(title: Column, body: Column, taxonomy: Taxonomy) -> Column:
    """Reason a role is excluded, or NULL: title phrase, duty phrase, then family."""
    name = fold_phrase(title)
    phrase = _first_phrase(name, taxonomy.excluded_titles)
    duty = _first_phrase(fold_phrase(body), taxonomy.excluded_duties)
    family = F.lit(None).cast("string")
    for rule in reversed(taxonomy.families):
        hit = name.rlike(any_phrase(rule.title_terms))
        if rule.exempt_terms:
            hit = hit & ~name.rlike(any_phrase(rule.exempt_terms))
        family = F.when(hit, F.lit(f"User excluded title family: {rule.name}")).otherwise(family)
    return F.coalesce(
        F.concat(F.lit("User excluded title phrase: "), phrase),
        F.concat(F.lit("User excluded responsibility phrase: "), duty),
        family)


def classify(df: DataFrame, taxonomy: Taxonomy, title: str = "title",
             description: str = "description_text", provisional: Column | None = None) -> DataFrame:
    """Adds role_label, role_confidence, role_provisional, role_reason to each row.

    Exclusion wins; else the longest preferred term in the title decides (ties go to the
    earlier group).  A row without a description is provisional.
    """
    ranks: dict[str, int] = {}
    label_of, shown = {}, {}
    for g, (label, terms) in enumerate(taxonomy.groups()):
        for t in terms:
            if t.strip() and _folded(t) not in ranks:
                ranks[_folded(t)] = g
                label_of[_folded(t)] = label
                shown[_folded(t)] = t.strip()
    t, d = F.col(title), F.col(description)
    rows = df.withColumn("_excluded", exclusion(t, d, taxonomy)).withColumn(
        "_hit", _best_hit(fold_phrase(t), ranks, longest=True))
    excluded, hit = F.col("_excluded"), F.col("_hit")
    none = F.lit(None).cast("string")
    term = literal_map(shown)[hit] if ranks else none
    matched = literal_map(label_of)[hit] if ranks else none
    guess = is_blank(d) if provisional is None else (is_blank(d) | provisional)
    found = excluded.isNotNull() | hit.isNotNull()
    summary = F.coalesce(
        excluded,
        F.concat(F.lit("Matches the user's "), F.lower(matched), F.lit(" preference: "), term,
                 F.lit(".")),
        F.lit("No confirmed role matches this title; review with the user."))
    evidence = F.coalesce(excluded, F.concat(F.lit("Title matches confirmed role: "), term))
    return computed_once(rows.select(
        *df.columns,
        F.when(excluded.isNotNull(), F.lit(lx.OUT_OF_SCOPE))
        .otherwise(F.coalesce(matched, F.lit(lx.UNCLASSIFIED))).alias("role_label"),
        F.when(~found, 0.1).when(guess, 0.65).otherwise(0.9).alias("role_confidence"),
        guess.alias("role_provisional"),
        F.struct(
            summary.alias("summary"),
            F.array_compact(F.array(evidence)).alias("evidence"),
            F.array_compact(F.array(F.when(~found, F.lit("confirmed role match")))).alias("gaps"),
        ).alias("role_reason"),
    ), df.columns)


def title_excluded(title: Column, families: tuple[TitleFamily, ...],
                   literals: tuple[str, ...] = ()) -> Column:
    """Struct (family, reason) of the first exclusion that applies; NULL when none does."""
    text = F.lower(F.coalesce(title, F.lit("")))
    found = F.lit(None).cast("struct<family:string,reason:string>")
    for literal in reversed(literals):
        found = F.when(text.rlike(any_phrase([literal])), F.struct(
            F.lit("literal").alias("family"),
            F.lit(f'title matches excluded phrase "{literal}"').alias("reason"))).otherwise(found)
    for rule in reversed(families):
        hit = text.rlike(any_phrase(rule.title_terms))
        if rule.exempt_terms:
            hit = hit & ~text.rlike(any_phrase(rule.exempt_terms))
        found = F.when(hit, F.struct(F.lit(rule.name).alias("family"),
                                     F.lit(rule.summary).alias("reason"))).otherwise(found)
    return found


def retain_provisional(df: DataFrame) -> DataFrame:
    """Listing-only rows survive unless they are out of scope."""
    return df.filter(F.col("role_label") != lx.OUT_OF_SCOPE)


MOST_QUERIES = 32


def expand_queries(requests: DataFrame, taxonomy: Taxonomy, cap: int = 16) -> DataFrame:
    """Per request: queries in order, repeats and excluded roles dropped, the first ``cap`` kept.

    ``requests`` has request_id, ordinal, query.  Dedup is a partial aggregate and the cap
    is pushed below the shuffle, so a huge request stays cheap.
    """
    if not 0 <= cap <= MOST_QUERIES:
        raise ValueError(f"a plan has 0 to {MOST_QUERIES} queries, not {cap}")
    kept = (
        requests.filter(~is_blank(F.col("query")))
        .filter(exclusion(F.col("query"), F.lit(""), taxonomy).isNull())
        .withColumn("query", F.trim("query"))
        .groupBy("request_id", fold_phrase(F.col("query")).alias("query_key"))
        .agg(F.min_by("query", "ordinal").alias("query"), F.min("ordinal").alias("ordinal"))
    )
    order = W.partitionBy("request_id").orderBy("ordinal", "query_key")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def query_plan(explicit: DataFrame, own: DataFrame, expansions: DataFrame, taxonomy: Taxonomy,
               cap: int = 32) -> DataFrame:
    """Explicit queries when a request has any, else its own roles followed by expansions."""
    chosen = explicit.filter(~is_blank(F.col("query"))).withColumn("query", F.trim("query"))
    chosen = (
        chosen.groupBy("request_id", fold_phrase(F.col("query")).alias("query_key"))
        .agg(F.min_by("query", "ordinal").alias("query"), F.min("ordinal").alias("ordinal"))
    )
    implied = own.withColumn("ordinal", F.col("ordinal").cast("bigint")).unionByName(
        expansions.withColumn("ordinal", F.col("ordinal").cast("bigint") + F.lit(1 << 40)))
    implied = implied.join(explicit.select("request_id").distinct(), "request_id", "left_anti")
    return chosen.unionByName(expand_queries(implied, taxonomy, cap).drop("rank"))


def query_family(query: Column, primary: list[str], adjacent: list[str], leadership: list[str],
                 user_supplied: list[str] = (), expansion: list[str] = ()) -> Column:
    """Family of a search query: profile roles by containment, then exact lists."""
    q = fold_phrase(query)

    def contains(roles):
        found = F.lit(False)
        for r in roles:
            if r.strip():
                found = found | F.contains(q, F.lit(_folded(r)))
        return found

    return (
        F.when(q == "", F.lit("user-supplied"))
        .when(q == "explicit refresh", F.lit("explicit-refresh"))
        .when(contains(primary), F.lit("primary"))
        .when(contains(adjacent), F.lit("adjacent"))
        .when(contains(leadership), F.lit("leadership"))
        .when(q.isin([_folded(x) for x in user_supplied]), F.lit("user-supplied"))
        .when(q.isin([_folded(x) for x in expansion]), F.lit("expansion"))
        .otherwise(F.lit("user-supplied"))
    )


def portal_relevant(url: Column, text: Column) -> Column:
    """A known portal marker in the host or text, on a host that is not a job board."""
    host = host_of(url)
    hay = F.array(F.lower(F.concat_ws(" ", host, text)))  # bound once, searched for every marker

    def marked(h: Column) -> Column:
        found = F.lit(False)
        for marker in lx.PORTAL_MARKERS:
            found = found | F.contains(h, F.lit(marker))
        return found

    return F.coalesce(~host.rlike(lx.EXCLUDED_HOST_PATTERN) & F.exists(hay, marked), F.lit(False))


def expired_page(title: Column, text: Column) -> Column:
    """True for a posting page that is gone or has no title."""
    return is_blank(title) | F.concat_ws("\n", title, text).rlike(lx.EXPIRED_PAGE_PATTERN)
