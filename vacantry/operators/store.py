"""Merges and idempotent appends over immutable snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.text import is_blank
from vacantry.operators.selection import JOB, first_per_key

ROLE_COLUMNS = ["role_label", "role_confidence", "role_reason", "taxonomy_version"]
KEPT_COLUMNS = ["created_at", "application_status", "applied_at"]


def last_rows(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key: the last in the stated order (ascending, NULL first).

    Without an order all other columns rank the rows, so the result is fixed anyway.
    Rows with a NULL in the key name no stored row and stay apart unless they are equal.
    """
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.select(*key).distinct()
    rank = F.struct(*(order or [F.to_json(F.struct(*rest))]))
    nameless = F.when(F.greatest(*[F.col(k).isNull() for k in key], F.lit(False)), F.xxhash64(*rows.columns))
    picked = rows.groupBy(*key, nameless.alias("_apart")).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*key, "_row.*").select(*rows.columns)


def merge_postings(existing: DataFrame, incoming: DataFrame, *order: Column) -> DataFrame:
    """New snapshot of the postings table after an upsert on (source, job_id).

    Plain columns are overwritten.  A sparse update (no description) cannot overwrite
    role columns whose stored label is a known one; otherwise they fall back to the old
    value.  Creation time and application status always survive.  Of several incoming
    rows for a key the last by ``order`` counts.  One full outer join.
    """
    incoming = last_rows(incoming, JOB, *order)
    e, i = existing.alias("e"), incoming.alias("i")
    joined = e.join(i, [F.col(f"e.{k}") == F.col(f"i.{k}") for k in JOB], "full_outer")
    arrived = F.col("i.job_id").isNotNull()
    stored = F.col("e.job_id").isNotNull()
    sparse = is_blank(F.col("i.description_text")) & F.coalesce(
        F.col("e.role_label").isin(lx.ROLE_LABELS), F.lit(False))
    out = [F.coalesce(F.col(f"i.{k}"), F.col(f"e.{k}")).alias(k) for k in JOB]
    for c in existing.columns:
        if c in JOB:
            continue
        old = F.col(f"e.{c}")
        if c not in incoming.columns:
            out.append(old.alias(c))
            continue
        new = F.col(f"i.{c}")
        if c in ROLE_COLUMNS:
            value = F.when(sparse, F.coalesce(old, new)).otherwise(F.coalesce(new, old))
        elif c in KEPT_COLUMNS:
            value = F.when(stored, old).otherwise(new)
        else:
            value = F.when(arrived, new).otherwise(old)
        out.append(value.alias(c))
    return joined.select(*out)


def replace_children(child: DataFrame, touched: DataFrame, new_rows: DataFrame,
                     keys: list[str] = JOB) -> DataFrame:
    """Child rows of the touched keys are replaced by the new ones."""
    return child.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(new_rows)


def insert_ignore(log: DataFrame, rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Rows to append: one per key (first by ``order``), keys already stored left out."""
    rank = order or tuple(F.col(c) for c in rows.columns if c not in key)
    return first_per_key(rows, key, *rank).join(log.select(*key), key, "left_anti")


def insert_summary(rows: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: how many arrived, were inserted, already existed."""
    counts = rows.select(F.lit(1).alias("arrived"), F.lit(0).alias("ins")).unionAll(
        inserted.select(F.lit(0).alias("arrived"), F.lit(1).alias("ins")))
    return counts.agg(
        F.coalesce(F.sum("arrived"), F.lit(0)).alias("arrived"),
        F.coalesce(F.sum("ins"), F.lit(0)).alias("inserted"),
    ).withColumn("existing", F.col("arrived") - F.col("inserted"))


def store_snapshot(benchmarks: DataFrame, new: DataFrame) -> DataFrame:
    """Surviving row for every (series_id, payload_hash) that arrived.

    A pair already stored keeps its row (``inserted`` is false); else the earliest
    arrival becomes the immutable snapshot.
    """
    key = ["series_id", "payload_hash"]
    columns = benchmarks.columns
    arrived = new.select(*columns, F.lit(1).alias("_new"))
    stored = benchmarks.select(*columns, F.lit(0).alias("_new")).join(
        new.select(*key).distinct(), key, "left_semi")
    both = first_per_key(stored.unionByName(arrived), key, F.col("_new"), F.col("fetched_at"),
                         F.col("benchmark_id"))
    return both.select(*columns, (F.col("_new") == 1).alias("inserted"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """All columns of a key are overwritten when it arrives again, by its last row in ``order``."""
    new = last_rows(new, key, *order)
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def existing_ids(postings: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Keys that already carry a description; failed scrapes count as missing on retry."""
    have = ~is_blank(F.col("description_text"))
    if retry_failed:
        have = have & ~F.coalesce(F.col("language_reason").startswith("scrape_failed:"), F.lit(False))
    return postings.filter(have).select(*JOB)


def export_to_score(postings: DataFrame, matches: DataFrame, since: str,
                    max_chars: int | None = None) -> DataFrame:
    """New, saved, described postings nobody has scored; optionally cut descriptions."""
    text = F.col("description_text")
    return (
        postings.filter((F.col("created_at") >= F.lit(since).cast("timestamp"))
                        & (F.col("application_status") == "saved") & ~is_blank(text))
        .join(matches.select(*JOB).distinct(), JOB, "left_anti")
        .select(*JOB, "title", "company", "city", "country_code",
                (F.substring(text, 1, max_chars) if max_chars else text).alias("description"),
                "url", "created_at")
    )


def backfill_stage_events(postings: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Applied postings with no stage event get one, dated when they were applied."""
    missing = postings.filter(F.col("application_status") == "applied").join(
        events.select(F.col("job_source").alias("source"), "job_id").distinct(), JOB, "left_anti")
    return missing.select(
        F.col("source").alias("job_source"), "job_id", F.lit("applied").alias("stage"),
        F.lit("backfilled from jobs.applied_at").alias("note"),
        F.coalesce(F.col("applied_at"), F.lit(as_of).cast("timestamp")).alias("occurred_at"))


def set_stage(postings: DataFrame, events: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append stage changes of known postings and mirror applied / withdrawn on them.

    ``changes`` has id, job_source, job_id, stage, note, occurred_at.
    Returns (events to append, new postings snapshot).
    """
    valid = changes.filter(F.col("stage").isin(lx.STAGES)).join(
        postings.select(F.col("source").alias("job_source"), "job_id"),
        ["job_source", "job_id"], "left_semi")
    mirrored = (
        valid.filter(F.col("stage").isin("applied", "withdrawn"))
        .groupBy(F.col("job_source").alias("source"), "job_id")
        .agg(F.max_by("stage", F.struct("occurred_at", "id")).alias("_stage"),
             F.min(F.when(F.col("stage") == "applied", F.col("occurred_at"))).alias("_applied"))
    )
    updated = (
        postings.join(mirrored, JOB, "left")
        .withColumn("application_status", F.coalesce(F.col("_stage"), F.col("application_status")))
        .withColumn("applied_at", F.coalesce(F.col("applied_at"), F.col("_applied")))
        .drop("_stage", "_applied")
    )
    return valid, updated
