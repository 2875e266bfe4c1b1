"""User-facing reports composed from operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.functions.clock import as_timestamp, posting_age
from vacantry.functions.fields import role_label
from vacantry.functions.keys import number_text
from vacantry.operators import aggregates as agg
from vacantry.operators.ranks import with_position
from vacantry.operators.selection import (JOB, apply_queue, first_per_key, latest_observation,
                                          latest_stage, newest)

FRESH_DAYS = 30


# -- freshness -------------------------------------------------------------
def freshness(postings: DataFrame, as_of: str | Column, cutoff_days: int = FRESH_DAYS) -> DataFrame:
    """Adds age_days, age_method, verdict (fresh / stale / unverified).

    Without a dating signal a posting found before the cutoff is certainly stale; found
    later, it is unverified and keeps no age.
    """
    aged = postings.withColumn(
        "_age", posting_age(F.col("job_posting_date"), F.col("created_at"), as_of))
    age, old = F.col("_age.age_days"), F.col("_age.created_age_days") > cutoff_days
    return aged.select(
        *postings.columns, age.alias("age_days"),
        F.when(age.isNull() & old, "no_signal_but_discovery_exceeds_cutoff")
        .otherwise(F.col("_age.method")).alias("age_method"),
        F.when(age.isNotNull(), F.when(age <= cutoff_days, "fresh").otherwise("stale"))
        .otherwise(F.when(old, "stale").otherwise("unverified")).alias("verdict"))


def freshness_summary(postings: DataFrame, as_of: str, cutoff_days: int = FRESH_DAYS) -> DataFrame:
    return freshness(postings, as_of, cutoff_days).groupBy("source", "verdict", "age_method").agg(
        agg.n_rows().alias("n"), F.min("age_days").alias("youngest"), F.max("age_days").alias("oldest"))


def fresh_matches(matches: DataFrame, postings: DataFrame, as_of: str, cutoff_days: int = FRESH_DAYS,
                  include_unverified: bool = False) -> DataFrame:
    """Apply rows of fresh postings, best fit first; unverified ones on request."""
    kept = ["fresh", "unverified"] if include_unverified else ["fresh"]
    fresh = freshness(postings, as_of, cutoff_days).filter(F.col("verdict").isin(kept)).select(
        *JOB, "title", "company", "age_days", "age_method", "verdict")
    return (matches.filter(F.col("cta") == "Apply").select(*JOB, "search_id", "fit_score")
            .join(fresh, JOB).orderBy(F.desc("fit_score"), *JOB, "search_id"))


# -- report gate -----------------------------------------------------------
def gate_findings(matches: DataFrame, postings: DataFrame, obs: DataFrame, as_of: str,
                  cutoff_days: int = FRESH_DAYS) -> DataFrame:
    """Apply rows that hold a report back: (search_id, source, job_id, finding).

    Pay needs provenance (posted, or an estimate tied to a benchmark) in the newest
    observation, and the posting must not be stale.
    """
    apply_rows = matches.filter(F.col("cta") == "Apply").select("search_id", *JOB)
    newest_obs = latest_observation(obs.select(
        "job_source", "job_id", "observation_id", "observed_at", "is_posted", "benchmark_id"))
    proven = newest_obs.select(
        F.col("job_source").alias("source"), "job_id",
        (F.col("is_posted") | F.col("benchmark_id").isNotNull()).alias("_proven"))
    verdicts = freshness(postings.select(*JOB, "job_posting_date", "created_at"), as_of,
                         cutoff_days).select(*JOB, "verdict")
    rows = apply_rows.join(verdicts, JOB).join(proven, JOB, "left")
    findings = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("_proven"), F.lit(False)), F.lit("missing_provenance")),
        F.when(F.col("verdict") == "stale", F.lit("stale_posting"))))
    return rows.select("search_id", *JOB, F.explode(findings).alias("finding"))


def report_gate(matches: DataFrame, postings: DataFrame, obs: DataFrame, run_states: DataFrame,
                as_of: str, cutoff_days: int = FRESH_DAYS) -> DataFrame:
    """One row per search: may its report be published?

    ``run_states`` has search_id, status; every run must be ok.
    """
    found = gate_findings(matches, postings, obs, as_of, cutoff_days).groupBy("search_id").agg(
        F.count_if(F.col("finding") == "missing_provenance").alias("missing_provenance"),
        F.count_if(F.col("finding") == "stale_posting").alias("stale_postings"))
    totals = (matches.filter(F.col("cta") == "Apply").join(postings.select(*JOB), JOB, "left_semi")
              .groupBy("search_id").agg(agg.n_rows().alias("apply_rows")))
    runs = run_states.groupBy("search_id").agg(F.count_if(F.col("status") != "ok").alias("degraded_runs"))
    searches = matches.select("search_id").distinct()
    counts = ["apply_rows", "missing_provenance", "stale_postings", "degraded_runs"]
    rows = (searches.join(totals, "search_id", "left").join(found, "search_id", "left")
            .join(runs, "search_id", "left").fillna(0, counts))
    return rows.select("search_id", *counts, (
        (F.col("missing_provenance") == 0) & (F.col("stale_postings") == 0)
        & (F.col("degraded_runs") == 0)).alias("passed"))


# -- dashboard and digest --------------------------------------------------
def status_dashboard(postings: DataFrame, matches: DataFrame, obs: DataFrame, runs: DataFrame,
                     threshold: float) -> DataFrame:
    """Long form (section, item, n) of the status page."""
    def section(name, df, item, n="n"):
        return df.select(F.lit(name).alias("section"), F.col(item).cast("string").alias("item"),
                         F.col(n).cast("bigint").alias("n"))

    # one pass over the postings and their scores gives every per-source count
    scored = matches.select(*JOB).distinct().withColumn("_scored", F.lit(True))
    blank = F.length(F.trim(F.coalesce("description_text", F.lit("")))) == 0
    base = postings.join(scored, JOB, "left").groupBy("source").agg(
        agg.n_rows().alias("jobs"), F.count_if(blank).alias("missing_description"),
        F.count_if(F.col("_scored").isNull()).alias("unscored"))
    out = section("jobs", base, "source", "jobs").unionByName(
        section("missing_description", base, "source", "missing_description")).unionByName(
        section("unscored", base, "source", "unscored"))
    out = out.unionByName(section("roles", agg.role_counts(postings), "label"))
    out = out.unionByName(section("applications", agg.status_counts(runs), "status"))
    covered = agg.salary_coverage(postings, obs)
    out = out.unionByName(section("salary_coverage", covered.withColumn(
        "item", F.lit("jobs with pay evidence")), "item", "covered"))
    queue = apply_queue(matches, postings, runs, threshold, size=None).groupBy("search_id").agg(
        agg.n_rows().alias("n"))
    return out.unionByName(section("apply_queue", queue, "search_id"))


def digest(postings: DataFrame, matches: DataFrame, events: DataFrame, since: str,
           threshold: float) -> DataFrame:
    """Everything newer than the watermark: (kind, source, job_id, at, detail, role columns).

    Kinds are new_job, new_hit and stage_change; backfilled stage events are left out.
    """
    mark = F.lit(since).cast("timestamp")
    full = F.length(F.trim(F.coalesce("description_text", F.lit("")))) > 0
    facts = postings.select(*JOB, role_label(F.col("role_label")).alias("role_label"),
                            F.when(full, "full-JD").otherwise("provisional").alias("role_stage"))
    new_jobs = postings.filter(F.col("created_at") > mark).select(
        *JOB, F.lit("new_job").alias("kind"), F.col("created_at").alias("at"), F.col("title").alias("detail"))
    hits = matches.filter((F.col("created_at") > mark) & (F.col("fit_score") >= threshold)).select(
        *JOB, F.lit("new_hit").alias("kind"), F.col("created_at").alias("at"),
        F.concat_ws(" ", F.col("cta"), F.col("fit_score").cast("decimal(6,1)").cast("string")).alias("detail"))
    changes = events.filter((F.col("occurred_at") > mark) & (
        F.col("note").isNull() | ~F.col("note").startswith("backfilled"))).select(
        F.col("job_source").alias("source"), "job_id", F.lit("stage_change").alias("kind"),
        F.col("occurred_at").alias("at"), F.col("stage").alias("detail"))
    return new_jobs.unionByName(hits).unionByName(changes).join(facts, JOB).select(
        "kind", *JOB, "at", "detail", "role_label", "role_stage")


def digest_audit(rows: DataFrame) -> DataFrame:
    """Role audit of a digest: counts per kind and canonical role label."""
    return rows.groupBy("kind", "role_label").agg(
        agg.n_rows().alias("n"), F.count_if(F.col("role_stage") == "full-JD").alias("full_jd"))


def digest_state(state: DataFrame | None, as_of: str, default_days: int = 7) -> Column:
    """Watermark to read from: the stored one, else ``default_days`` before ``as_of``."""
    fallback = as_timestamp(as_of) - F.make_dt_interval(F.lit(default_days))
    if state is None:
        return fallback
    return F.coalesce(state.agg(F.max("last_run")).scalar(), fallback)


# -- stages ----------------------------------------------------------------
def follow_ups(events: DataFrame, postings: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Jobs whose latest stage is applied or screening and at least ``days`` old, with their ``position``, oldest first."""
    age = (F.unix_micros(as_timestamp(as_of)) - F.unix_micros(F.col("occurred_at"))) / F.lit(86400e6)
    rows = (
        latest_stage(events).filter(F.col("stage").isin("applied", "screening"))
        .withColumn("_age", age).filter(F.col("_age") >= days)
        .withColumn("days_ago", F.floor("_age").cast("bigint")).drop("_age")
        .withColumnRenamed("job_source", "source")
        .join(postings.select(*JOB, "title", "company", "url"), JOB)
    )
    return with_position(rows, F.desc("days_ago"), *JOB)


def stage_history(events: DataFrame) -> DataFrame:
    """All stage events with their ``position``: by job, in order of time."""
    return with_position(events, "job_source", "job_id", "occurred_at", "id")


# -- pay line --------------------------------------------------------------
def salary_line(source: Column, job_id: Column, best: Column, exact_status: Column,
                next_retry: Column, error: Column) -> Column:
    """One-line text for a job: posted pay, best estimate, or why there is none.

    ``best`` is a struct with is_posted, currency, amount_min, amount_max, amount_median,
    benchmark_id; NULL when nothing was selected.
    """
    where = F.concat(source, F.lit(" "), job_id)
    # fixed values: the wording of the line, which readers of reports compare as text
    retry = F.coalesce(F.concat(F.lit("next retry "), F.date_format(next_retry, "yyyy-MM-dd")),
                       F.lit("no further retries (manual)"))
    cur = F.coalesce(best["currency"], F.lit(""))
    span = F.trim(F.when(
        best["amount_min"].isNotNull() & best["amount_max"].isNotNull(),
        F.concat(cur, F.lit(" "), number_text(best["amount_min"]), F.lit("–"), number_text(best["amount_max"])))
        .when(best["amount_median"].isNotNull(), F.concat(cur, F.lit(" ~"), number_text(best["amount_median"])))
        .otherwise(cur))
    return (
        F.when(best.isNull() & (exact_status == "error"), F.concat(
            F.lit("Error fetching "), where, F.lit(": "), F.coalesce(error, F.lit("unknown")),
            F.lit(" — "), retry))
        .when(best.isNull() & (exact_status == "not_found"), F.concat(
            F.lit("No salary found ("), where, F.lit(") — "), retry))
        .when(best.isNull(), F.concat(F.lit("No salary found ("), where, F.lit(")")))
        .when(best["is_posted"], F.concat(F.lit("Posted salary "), span, F.lit(" ("), where, F.lit(")")))
        .otherwise(F.concat(F.lit("Best estimate "), span, F.lit(" ("), where, F.lit(" benchmark="),
                            F.coalesce(best["benchmark_id"], F.lit("unknown")), F.lit(")"))))


def newest_runs(runs: DataFrame) -> DataFrame:
    """Latest application run per job."""
    return first_per_key(runs, ["job_source", "job_id"], newest(F.col("at")))
