"""Top-1 per key, first-seen dedup, queues and boards.

Top-1 picks are ``min_by`` aggregates, so every task keeps one row per key before the
shuffle and a key holding most rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.clock import as_timestamp
from vacantry.functions.text import is_blank, literal_map
from vacantry.operators.ranks import with_position

JOB = ["source", "job_id"]
OBS_JOB = ["job_source", "job_id"]
LAST = float("inf")


def newest(c: Column) -> Column:
    """Ascending sort key that puts the newest instant first and NULL last."""
    return F.coalesce(-F.unix_micros(c), F.lit(2**63 - 1))


def biggest(c: Column) -> Column:
    return F.coalesce(-c.cast("double"), F.lit(LAST))


def rank_in(c: Column, order: list[str]) -> Column:
    """Position of a value in a fixed list; unknown values after all of them."""
    return F.coalesce(literal_map({v: i for i, v in enumerate(order)})[c], F.lit(len(order)))


def first_per_key(df: DataFrame, keys: list[str], *order: Column, columns: list[str] | None = None) -> DataFrame:
    """The row of each key that sorts first by ``order`` (all ascending, NULL first).

    ``columns`` names the columns that are wanted besides the keys; no other is read,
    packed or shuffled.
    """
    rest = [c for c in (df.columns if columns is None else columns) if c not in keys]
    rank = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*")


def first_seen(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Ordered dedup: for each key keep the row with the smallest ordinal."""
    return first_per_key(df, keys, F.col(ordinal))


# -- stage events ----------------------------------------------------------
def latest_stage(events: DataFrame) -> DataFrame:
    """Latest stage per job; ties on time go to the larger event id."""
    return first_per_key(events, OBS_JOB, newest(F.col("occurred_at")), -F.col("id"))


# -- salary observations ---------------------------------------------------
def latest_observation(obs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Newest observation per job, then smallest id."""
    return first_per_key(obs, OBS_JOB, newest(F.col("observed_at")), F.col("observation_id"), columns=columns)


def latest_posted_first(obs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One observation per job: posted pay before estimates, then newest."""
    return first_per_key(
        obs, OBS_JOB, -F.col("is_posted").cast("int"), newest(F.col("observed_at")),
        newest(F.col("created_at")), F.col("observation_id"), columns=columns)


def best_observation(obs: DataFrame, country: Column | None = None,
                     source_priority: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Best pay evidence per job; amounts are never compared.

    Confidence label, posted, not predicted, newest, finest place, expected currency of
    ``country`` (skipped when not given), source priority, id.
    """
    place = (
        F.when(~is_blank(F.col("city")), 0).when(~is_blank(F.col("region")), 1).otherwise(2))
    keys = [
        rank_in(F.col("confidence_label"), lx.CONFIDENCE_ORDER),
        -F.col("is_posted").cast("int"),
        F.col("is_predicted").cast("int"),
        newest(F.col("observed_at")),
        place,
    ]
    if country is not None:
        expected = literal_map(lx.EXPECTED_CURRENCY)[country]
        keys.append(F.when(expected.isNull() | (F.col("currency") == expected), 0).otherwise(1))
    if source_priority:
        keys.append(rank_in(F.col("data_source"), source_priority))
    return first_per_key(obs, OBS_JOB, *keys, F.col("observation_id"), columns=columns)


def observation_history(obs: DataFrame) -> DataFrame:
    """All observations with their ``position``: by job, newest first."""
    return with_position(obs, "job_source", "job_id", F.desc("observed_at"), "observation_id")


def find_observation(obs: DataFrame, source: str, job_id: str, observation_id: str) -> DataFrame:
    """One observation by its full key; the predicates reach the scan."""
    return obs.filter((F.col("job_source") == source) & (F.col("job_id") == job_id)
                      & (F.col("observation_id") == observation_id))


def observations_by_label(obs: DataFrame) -> DataFrame:
    return obs.groupBy(*OBS_JOB, "confidence_label").agg(F.count(F.lit(1)).alias("n"))


# -- benchmarks ------------------------------------------------------------
def latest_benchmark(benchmarks: DataFrame, as_of: str | Column,
                     max_age_days: int = lx.BENCHMARK_MAX_AGE_DAYS) -> DataFrame:
    """Newest snapshot per series with ``is_stale`` (strictly older than the limit)."""
    picked = first_per_key(benchmarks, ["series_id"], newest(F.col("fetched_at")),
                           F.col("benchmark_id"))
    limit = F.col("fetched_at") + F.make_dt_interval(F.lit(max_age_days))
    return picked.withColumn("is_stale", as_timestamp(as_of) > limit)


# -- queues and boards -----------------------------------------------------
SUBMITTED = ["submitted", "success", "completed"]


def apply_queue(matches: DataFrame, postings: DataFrame, runs: DataFrame, threshold: float,
                size: int | None = 15) -> DataFrame:
    """Best unapplied matches; unreviewed role labels leave before the queue is cut."""
    from vacantry.functions.fields import role_label

    done = runs.filter(F.col("status").isin(SUBMITTED)).select(
        F.col("job_source").alias("source"), "job_id").distinct()
    queue = (
        matches.filter((F.col("fit_score") >= threshold) & (F.col("cta") == "Apply"))
        .join(postings.select(*JOB, "title", "company", "role_label"), JOB)
        .join(done, JOB, "left_anti")
        .withColumn("role_label", role_label(F.col("role_label")))
        .filter(~F.col("role_label").isin(lx.OUT_OF_SCOPE, lx.UNCLASSIFIED))
        .orderBy(F.desc("fit_score"), "source", "job_id", "search_id")
    )
    return queue.limit(size) if size else queue


def top_apply(matches: DataFrame, size: int) -> DataFrame:
    """Highest-scoring Apply rows, ties broken by key."""
    return (matches.filter(F.col("cta") == "Apply")
            .orderBy(F.desc("fit_score"), "source", "job_id", "search_id").limit(size))


def stage_board(events: DataFrame, postings: DataFrame) -> DataFrame:
    """Latest stage of every job with its ``position``: offers first, newest first inside a stage."""
    rows = (
        latest_stage(events)
        .withColumnRenamed("job_source", "source")
        .join(postings.select(*JOB, "title", "company"), JOB)
        .withColumn("board_rank", rank_in(F.col("stage"), lx.BOARD_ORDER))
    )
    return with_position(rows, "board_rank", F.desc("occurred_at"), "source", "job_id")


def salary_queue(matches: DataFrame, postings: DataFrame, search_id: str | None = None) -> DataFrame:
    """Apply rows for pay research with their ``position``: core fits, then stretches, then fit and title."""
    rows = matches.filter(F.col("cta") == "Apply")
    if search_id is not None:
        rows = rows.filter(F.col("search_id") == search_id)
    rank = F.when(F.col("stretch_label") == "Core fit", 0).when(
        F.col("stretch_label") == "Stretch", 1).otherwise(2)
    rows = rows.join(postings.select(*JOB, "title", "company", "country_code"), JOB).withColumn("queue_rank", rank)
    return with_position(rows, "queue_rank", F.desc("fit_score"), F.lower("title"), "source", "job_id", "search_id")


SCAN_COUNTRIES = ["GB", "IE", "NL", "DK"]


def scan_queue(matches: DataFrame, postings: DataFrame, obs: DataFrame,
               search_id: str | None = None) -> DataFrame:
    """Apply rows whose latest pay evidence is not posted, with their ``position`` in scan order."""
    rows = matches.filter(F.col("cta") == "Apply")
    if search_id is not None:
        rows = rows.filter(F.col("search_id") == search_id)
    latest = latest_posted_first(obs, ["is_posted", "data_source"]).withColumnRenamed("job_source", "source")
    rows = (
        rows.select(*JOB, "search_id")
        .join(postings.select(*JOB, "title", "company", "country_code"), JOB)
        .join(latest, JOB, "left")
        .filter(~F.coalesce(F.col("is_posted"), F.lit(False)))
        .withColumn("country_rank", rank_in(F.col("country_code"), SCAN_COUNTRIES))
    )
    return with_position(rows, "country_rank", "company", "title", "source", "job_id", "search_id")


def backfill_candidates(postings: DataFrame, source: str | None = None, retry_failed: bool = False,
                        size: int | None = None) -> DataFrame:
    """Postings without a description with their ``position``, last updated first; the first ``size`` of them if given."""
    reason = F.col("language_reason")
    wanted = is_blank(F.col("description_text"))
    if retry_failed:
        wanted = wanted | F.coalesce(
            reason.startswith("FAIL: Could not extract JD")
            | reason.startswith("FAIL: Error fetching page:")
            | reason.startswith("scrape_failed:"), F.lit(False))
    rows = postings.filter(wanted)
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    rows = rows.select(*JOB, "url", "title", "company", "language_reason", "updated_at")
    order = [F.desc("updated_at"), F.lower("title"), "source", "job_id"]
    return with_position(rows.orderBy(*order).limit(size) if size else rows, *order)


def detail_budget(ids: DataFrame, existing: DataFrame, cap: int) -> DataFrame:
    """Unseen ids admitted under one cap consumed by queries in order.

    ``ids`` has query, query_order, position, job_id.  An id belongs to the first query
    that lists it; the cap then admits the first ``cap`` ids overall.
    """
    fresh = first_per_key(ids, ["job_id"], F.col("query_order"), F.col("position")).join(
        existing, "job_id", "left_anti")
    return fresh.orderBy("query_order", "position", "job_id").limit(cap)


def union_first_seen(explicit: DataFrame, listed: DataFrame) -> DataFrame:
    """Explicit ids first; they leave every other query, duplicates keep the first place."""
    head = explicit.select("job_id", F.lit("explicit refresh").alias("query"),
                           F.lit(-1).cast("bigint").alias("query_order"), "position")
    tail = listed.select("job_id", "query", F.col("query_order").cast("bigint").alias("query_order"),
                         "position")
    return first_per_key(head.unionByName(tail), ["job_id"], F.col("query_order"), F.col("position"))
