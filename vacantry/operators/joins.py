"""Joins between postings, scores, stages, evidence and queues.

Join keys are the full posting key, so no single source is ever a join key; many-row
sides are reduced to one row per key before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.functions.staging import computed_once
from vacantry.functions.text import any_phrase
from vacantry.operators.selection import JOB, latest_observation
from vacantry.session import work_dir


def scored_postings(matches: DataFrame, postings: DataFrame) -> DataFrame:
    clash = [c for c in postings.columns if c in matches.columns and c not in JOB]
    return matches.join(postings.drop(*clash), JOB)


def staged_postings(events: DataFrame, postings: DataFrame) -> DataFrame:
    return events.withColumnRenamed("job_source", "source").join(postings, JOB)


def without_match(postings: DataFrame, matches: DataFrame) -> DataFrame:
    """Postings nobody has scored."""
    return postings.join(matches.select(*JOB), JOB, "left_anti")


def queued_postings(postings: DataFrame, queue: DataFrame) -> DataFrame:
    """Postings named in a queue; an entry without a source matches any source.

    Two hash semi-joins instead of one join with an OR condition.
    """
    exact = queue.filter(F.col("source").isNotNull()).select(*JOB)
    loose = queue.filter(F.col("source").isNull()).select("job_id").withColumn("_any", F.lit(True)).distinct()
    marked = postings.join(exact.distinct().withColumn("_exact", F.lit(True)), JOB, "left").join(
        loose, "job_id", "left")
    return marked.filter(F.col("_exact") | F.col("_any")).drop("_exact", "_any")


def apply_with_latest(matches: DataFrame, obs: DataFrame) -> DataFrame:
    """Apply rows with their newest pay evidence, if any."""
    latest = latest_observation(obs.select("job_source", "job_id", "observation_id", "observed_at",
                                           "is_posted", "benchmark_id"))
    return matches.filter(F.col("cta") == "Apply").join(
        latest.withColumnRenamed("job_source", "source"), JOB, "left")


def display_facts(matches: DataFrame, postings: DataFrame) -> DataFrame:
    """Scores with the facts a report shows; a score without its posting stays."""
    return matches.join(postings.select(*JOB, "title", "company", "country_code", "url"), JOB, "left")


HEAVY_KEYS = 64  # keys that may be spread
TRACKED_KEYS = 10_000  # keys that the sketch follows


def heavy_keys(rows: DataFrame, key: str, parts: int, most: int = HEAVY_KEYS) -> dict:
    """Keys that hold more than a fair share of one of ``parts`` tasks, with their estimated share of all rows.

    One aggregate with a mergeable frequent-items sketch; at most ``most`` keys come to the driver, and more than
    ``parts`` keys cannot be that frequent.
    """
    listed = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {TRACKED_KEYS})").alias("top")).first()
    return {r["item"]: r["count"] / listed["n"] for r in listed["top"] or [] if r["item"] is not None and r["count"] * parts > listed["n"]}


def spread_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", parts: int | None = None) -> DataFrame:
    """``rows`` joined with ``side`` on one key, of which few values may hold most of ``rows``.

    Rows of a heavy key are dealt to as many salts as its share of all rows fills tasks, twice over, and the side's
    rows with that key are copied to each salt; all other rows have salt 0.  The salt comes from the row itself, so
    a task that runs again deals alike.  Keys that the sketch misses only cost time.  ``how`` is inner or left.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(rows, key, parts)
    if not heavy:
        return rows.join(side, key, how)
    salts = F.lit(1)
    for value, share in heavy.items():
        salts = F.when(F.col(key) == value, F.lit(max(1, round(2 * share * parts)))).otherwise(salts)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if rows.schema[c].dataType.typeName() != "map"]), salts))
    copied = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint"))))
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


# words, and every other character that is no space by itself
TOKEN = r"\w+|[^\w\s]"


def tokens(c: Column) -> Column:
    """Lower-case tokens of a text; what stands between them does not count."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"(?U)({TOKEN})"), F.lit(1))


HEAD_BITS, RUN_BITS = 23, 25  # sizes of the two bit tables: 1 MB and 4 MB


def _places(hashed: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(hashed, n).bitwiseAND((1 << bits) - 1) for n in (0, 20)]


def bit_table(hashes: DataFrame, bits: int) -> Column:
    """Bloom table of the hashes in the only column, as one array value of 2^bits bits."""
    place = hashes.select(F.explode(F.array(*_places(F.col(hashes.columns[0]), bits))).alias("_place"))
    words = place.groupBy(F.shiftright("_place", 6).alias("id")).agg(F.bit_or(
        F.expr("shiftleft(1L, CAST(_place & 63 AS INT))")).alias("_word"))
    filled = hashes.sparkSession.range(0, 1 << (bits - 6), 1, 1).join(words, "id", "left")
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("_word", F.lit(0).cast("bigint")).alias("_word"))))
    return filled.agg(listed["_word"].alias("_words")).scalar()


def may_hold(table: Column, hashed: Column, bits: int) -> Column:
    """False only where the table of ``bit_table`` cannot hold the hash."""
    found = [F.get(table, F.shiftright(p, 6).cast("int")).bitwiseAND(F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), p.bitwiseAND(63).cast("int"))) != 0 for p in _places(hashed, bits)]
    return found[0] & found[1]


def _head(n: Column, tokens: Column) -> Column:
    return F.xxhash64(n.cast("int"), F.get(tokens, F.lit(0)), F.when(n != 1, F.get(tokens, F.lit(1))))


def term_matches(df: DataFrame, key: list[str], text: str, terms: DataFrame, most_tokens: int = 8) -> DataFrame:
    """(key, term, n): terms of a large vocabulary in each text and how often, for a vocabulary of any size.

    ``terms`` has term.  Texts and terms are compared by tokens: runs of up to ``most_tokens`` tokens meet the
    terms in one hash join, so the cost does not grow with the number of terms, and a frequent run is spread over
    tasks.  Only runs that two bit tables of fixed size do not rule out are shuffled, by their length with their first two
    tokens and as a whole; the join decides.  Terms and these runs are written once, as several steps read them.
    From left to right the longest term at each place counts and what it covers is used up.  Terms of more
    tokens raise; ``key`` names the rows.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, "terms")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    joiner = "\u0001"
    listed = terms.select("term", tokens(F.col("term")).alias("_t")).filter(F.size("_t") > 0)
    longest = F.when(F.size("_t") > most_tokens, F.raise_error(F.lit(f"a term has more than {most_tokens} tokens")))
    listed = stored(listed.select(F.coalesce(longest, F.array_join("_t", joiner)).alias("_run"), "term").groupBy("_run").agg(
        F.min("term").alias("term")), "listed")
    split = F.split("_run", joiner)
    # a run of one token is marked as 1; a longer one as 0, which lets its place pass, and with its length
    heads = bit_table(listed.select(F.explode(F.array_distinct(F.array(
        _head(F.when(F.size(split) == 1, 1).otherwise(0), split), _head(F.size(split), split)))).alias("h")).distinct(), HEAD_BITS)
    wholes = bit_table(listed.select(F.xxhash64("_run").alias("h")), RUN_BITS)
    ahead = computed_once(df.select(*key, tokens(F.col(text)).alias("_t")), key).select(*key, F.posexplode_outer(F.when(
        F.size("_t") > 0, F.transform(F.sequence(F.lit(1), F.size("_t")), lambda i: F.slice("_t", i, most_tokens)))).alias("_at", "_s"))
    ahead = ahead.withColumn("_heads", heads)
    ahead = ahead.filter(may_hold(F.col("_heads"), _head(F.lit(0), F.col("_s")), HEAD_BITS)
                         | may_hold(F.col("_heads"), _head(F.lit(1), F.col("_s")), HEAD_BITS))
    runs = ahead.select("*", F.explode(F.sequence(F.lit(1), F.size("_s"))).alias("_n")).filter(
        may_hold(F.col("_heads"), _head(F.col("_n"), F.col("_s")), HEAD_BITS)).select(
        *key, "_at", (F.col("_n") - 1).alias("_more"), F.array_join(F.slice("_s", F.lit(1), F.col("_n")), joiner).alias("_run"))
    runs = stored(runs.withColumn("_wholes", wholes).filter(
        may_hold(F.col("_wholes"), F.xxhash64("_run"), RUN_BITS)).drop("_wholes"), "runs")
    # at one place the longest comes first and covers the others
    found = F.struct("_at", (-F.col("_more")).alias("_less"), "term")
    placed = spread_join(runs, listed, "_run").groupBy(*key).agg(F.array_sort(F.collect_list(found)).alias("_hits"))
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("terms"))
    taken = F.aggregate("_hits", start, lambda acc, h: F.when(h["_at"] > acc["end"], F.struct(
        (h["_at"] - h["_less"]).alias("end"), F.concat(acc["terms"], F.array(h["term"])).alias("terms"))).otherwise(acc))
    return placed.select(*key, F.explode(taken["terms"]).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"))


def phrase_matches(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """One row per (row, term found in its text): a containment join as one regex pass."""
    hits = F.regexp_extract_all(F.lower(F.col(text)), F.lit(any_phrase(terms)), F.lit(1))
    return df.withColumn("term", F.explode(F.array_distinct(hits)))
