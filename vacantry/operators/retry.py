"""Retry schedule, enrichment state and due selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.clock import as_timestamp
from vacantry.operators.selection import JOB
from vacantry.operators.store import last_rows

AXES = ["exact", "benchmark"]
AXIS_FIELDS = ["status", "attempts", "next_retry_at", "last_attempt_at", "error"]


def fetch_event(candidates: Column, usable: Column, http_status: Column, error_code: Column,
                message: Column) -> Column:
    """Kind of a fetch outcome: success, not_found, transient_error or unrecoverable_error.

    ``candidates`` is the number of rows a parser returned (NULL when it did not run) and
    ``usable`` how many of them state posted pay.
    """
    stated = F.regexp_extract(message, r"^HTTP (\d{3})", 1)
    status = F.coalesce(http_status.cast("int"), F.when(stated != "", stated.try_cast("int")))
    return (
        F.when(candidates.isNotNull(), F.when(usable > 0, "success").otherwise("not_found"))
        .when(status.isNotNull(), F.when(status == 404, "not_found")
              .when(status >= 500, "transient_error").otherwise("unrecoverable_error"))
        .when(error_code.isin("ECONNRESET", "ETIMEDOUT", "TypeError"), F.lit("transient_error"))
        .when(message.rlike("Job title not found"), F.lit("not_found"))
        .otherwise(F.lit("unrecoverable_error"))
    )


def next_state(axis: str, attempts: Column, kind: Column, message: Column,
               as_of: str | Column) -> Column:
    """Struct (status, attempts, next_retry_at, last_attempt_at, error) after one outcome."""
    if axis not in AXES:
        raise ValueError(f"unknown axis: {axis}")
    now = as_timestamp(as_of)
    n = (F.coalesce(attempts, F.lit(0)) + 1).cast("int")
    transient = kind == "transient_error"
    backoff = F.least(F.pow(F.lit(2.0), n - 1), F.lit(float(lx.BACKOFF_CAP_DAYS))).cast("int")
    days = F.when(kind == "not_found", F.lit(lx.NOT_FOUND_DAYS[axis])).when(
        transient & (n <= lx.MAX_TRANSIENT_ATTEMPTS), backoff)
    failed = kind.isin("transient_error", "unrecoverable_error")
    return F.struct(
        F.when(kind == "success", "found").when(kind == "not_found", "not_found")
        .when(failed, "error").alias("status"),
        n.alias("attempts"), (now + F.make_dt_interval(days)).alias("next_retry_at"),
        now.alias("last_attempt_at"), F.when(failed, message).alias("error"))


def apply_outcomes(state: DataFrame, outcomes: DataFrame, axis: str, as_of: str, *order: Column) -> DataFrame:
    """New state table after one outcome per job on one axis; the other axis is untouched.

    ``outcomes`` has job_source, job_id, kind, message; of several rows for a job the last
    by ``order`` counts.
    """
    key = ["job_source", "job_id"]
    outcomes = last_rows(outcomes, key, *order)
    joined = state.join(outcomes.select(*key, F.col("kind").alias("_kind"),
                                        F.col("message").alias("_message")), key, "full_outer")
    moved = F.col("_kind").isNotNull()
    nxt = next_state(axis, F.col(f"{axis}_attempts"), F.col("_kind"), F.col("_message"), as_of)
    joined = joined.withColumn("_next", nxt)
    out = []
    for c in state.columns:
        if c in key:
            out.append(F.col(c))
        elif c.startswith(axis + "_"):
            out.append(F.when(moved, F.col(f"_next.{c[len(axis) + 1:]}")).otherwise(F.col(c)).alias(c))
        elif c.endswith("_status"):
            out.append(F.coalesce(F.col(c), F.lit("pending")).alias(c))
        elif c.endswith("_attempts"):
            out.append(F.coalesce(F.col(c), F.lit(0)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def reset_axis(state: DataFrame, jobs: DataFrame, axis: str) -> DataFrame:
    """State with one axis of the given jobs back at pending."""
    key = ["job_source", "job_id"]
    hit = jobs.select(*key).distinct().withColumn("_hit", F.lit(True))
    joined = state.join(hit, key, "left")
    out = []
    for f in state.schema.fields:
        if f.name.startswith(axis + "_"):
            fresh = {"status": F.lit("pending"), "attempts": F.lit(0)}.get(
                f.name[len(axis) + 1:], F.lit(None))
            out.append(F.when(F.col("_hit"), fresh.cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return joined.select(*out)


def due_jobs(postings: DataFrame, state: DataFrame, as_of: str, axis: str = "exact") -> DataFrame:
    """Postings never tried, pending, or whose retry time has come."""
    s = state.select(F.col("job_source").alias("source"), "job_id",
                     F.col(f"{axis}_status").alias("_status"),
                     F.col(f"{axis}_next_retry_at").alias("_next"))
    due = (
        F.col("_status").isNull() | (F.col("_status") == "pending")
        | (F.col("_status").isin("not_found", "error") & (F.col("_next") <= as_timestamp(as_of))))
    return postings.join(s, JOB, "left").filter(due).drop("_status", "_next")


def never_posted(postings: DataFrame, obs: DataFrame) -> DataFrame:
    """Postings without any posted pay, whatever their retry state (forced retry)."""
    posted = obs.filter("is_posted").select(F.col("job_source").alias("source"), "job_id").distinct()
    return postings.join(posted, JOB, "left_anti")


def batch(candidates: DataFrame, size: int) -> DataFrame:
    """First ``size`` candidates by key."""
    if size <= 0:
        raise ValueError("size must be a positive integer")
    return candidates.orderBy("source", "job_id").limit(size)


def exit_code(has_best: Column, exact_kind: Column, exact_exhausted: Column,
              benchmark_kind: Column, benchmark_exhausted: Column, exact_status: Column) -> Column:
    """Outcome code: 5 unrecoverable, 6 retries used up, 0 done or scheduled, 1 otherwise."""
    def is_kind(c, k):
        return F.coalesce(c == k, F.lit(False))

    unrecoverable = is_kind(exact_kind, "unrecoverable_error") | is_kind(benchmark_kind, "unrecoverable_error")
    exhausted = (is_kind(exact_kind, "transient_error") & exact_exhausted) | (
        is_kind(benchmark_kind, "transient_error") & benchmark_exhausted)
    done = (has_best | F.coalesce(exact_status.isin("not_found", "found"), F.lit(False))
            | is_kind(benchmark_kind, "success"))
    scheduled = is_kind(exact_kind, "transient_error") | is_kind(benchmark_kind, "transient_error")
    return (F.when(unrecoverable, 5).when(exhausted, 6).when(done | scheduled, 0).otherwise(1)
            .cast("bigint"))
