"""Queries that run a stream over the event files to its end and return the final table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantry.plans.registry import query
from vacantry.plans.selection_queries import top
from vacantry.plans.state_queries import HALTS, PAGES_READ, PAGING, RUNS
from vacantry.plans.testbed import FETCH_LOG, SCHEMAS, STAGE_EVENTS
from vacantry.session import work_dir
from vacantry.sources.tables import json_roundtrip
from vacantry.streaming import jobs
from vacantry.streaming.runner import read_files


def view_stream(t, view):
    stream = read_files(t.spark, t.sf_dir, SCHEMAS[view.base], f"{view.base}.parquet")
    return stream.selectExpr(*[f"{c[1]} AS {c[0]}" for c in view.columns])


@query("stage_stream", top("stage_events", "job_source, job_id", "occurred_at DESC, id DESC",
                           "job_source, job_id, id, stage, note, occurred_at"), ("stage_events",))
def _(t):
    stream = jobs.latest_stage(view_stream(t, STAGE_EVENTS))
    return jobs.keep_current(stream, ["job_source", "job_id"], work_dir(t.spark, "stages"))


KIND = "CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN 'not_found' WHEN 'purchase' THEN 'unrecoverable_error' ELSE 'transient_error' END"


@query("retry_stream",
       "SELECT job_id, CASE kind WHEN 'success' THEN 'found' WHEN 'not_found' THEN 'not_found' ELSE 'error' END AS status, n AS attempts, CASE WHEN kind = 'not_found' THEN ts + INTERVAL 14 DAY "
       "WHEN kind = 'transient_error' AND n <= 5 THEN ts + to_days(least(CAST(pow(2, n - 1) AS INT), 7)) END AS next_retry_at FROM (SELECT job_id, count(*) AS n, arg_max(kind, ts) AS kind, "
       f"max(ts) AS ts FROM (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 40 AS VARCHAR) AS job_id, ts, {KIND} AS kind FROM events) e GROUP BY job_id) s")
def _(t):
    stream = read_files(t.spark, t.sf_dir, SCHEMAS["events"], "events.parquet").selectExpr(
        "event_id AS id", "'linkedin' AS job_source", "CAST(user_id AS STRING) || '-' || CAST(event_id % 40 AS STRING) AS job_id",
        f"{KIND} AS kind", "'m' AS message", "ts AS at")
    rows = jobs.keep_current(jobs.retry_state(stream, "exact"), ["job_source", "job_id"], work_dir(t.spark, "retry"))
    return rows.select("job_id", "status", "attempts", "next_retry_at")


@query("breaker_stream", "SELECT id, source, run, run >= 3 AS at_threshold FROM runs_of", ("fetch_log",), runs_of=RUNS)
def _(t):
    rows = jobs.breaker_runs(view_stream(t, FETCH_LOG), work_dir(t.spark, "breaker"))
    return rows.select("id", "source", "run", "at_threshold")


@query("rate_stream",
       "SELECT source, w AS start, w + INTERVAL 900 SECOND AS \"end\", count(*) AS requests FROM (SELECT source, unnest([time_bucket(INTERVAL 300 SECOND, \"at\"), "
       "time_bucket(INTERVAL 300 SECOND, \"at\") - INTERVAL 300 SECOND, time_bucket(INTERVAL 300 SECOND, \"at\") - INTERVAL 600 SECOND]) AS w FROM fetch_log) s GROUP BY source, w", ("fetch_log",))
def _(t):
    windows, _ = jobs.rate_windows(view_stream(t, FETCH_LOG), work_dir(t.spark, "rate"), None, 900, 300)
    return windows


@query("rate_stream_late",
       "SELECT id, source, 'no_time' AS reason FROM (SELECT id, source, CASE WHEN id % 7 <> 0 THEN \"at\" END AS \"at\" FROM fetch_log) r WHERE \"at\" IS NULL", ("fetch_log",))
def _(t):
    log = view_stream(t, FETCH_LOG).withColumn("at", F.when(F.col("id") % 7 != 0, F.col("at")))
    _, missed = jobs.rate_windows(log, work_dir(t.spark, "rate"), 120, 900, 300)
    return missed.select("id", "source", "reason")


@query("paging_stream", PAGES_READ, ("fetch_log",), pg=PAGING)
def _(t):
    pages = view_stream(t, FETCH_LOG).select("id", F.col("key").alias("query"), "new_ids", "at")
    return jobs.paging(pages, work_dir(t.spark, "paging")).select("id", "query", "run")


@query("halted_stream", HALTS, ("fetch_log",))
def _(t):
    queue = view_stream(t, FETCH_LOG).select("id", F.col("key").alias("source"), F.col("id").alias("position"), "state")
    return jobs.halted(queue, work_dir(t.spark, "halted")).select("id", "outcome")


@query("digest_stream", "SELECT id, job_source, job_id, stage FROM stage_events WHERE note IS NULL OR note NOT LIKE 'backfilled%'", ("stage_events",))
def _(t):
    fresh = view_stream(t, STAGE_EVENTS).filter("note IS NULL OR NOT startswith(note, 'backfilled')")
    return jobs.new_since_last_run(fresh, work_dir(t.spark, "digest")).select("id", "job_source", "job_id", "stage")


@query("json_sink", "SELECT source, job_id, title, company, created_at FROM postings", ("postings",))
def _(t):
    rows = t.postings.select("source", "job_id", "title", "company", "created_at")
    return json_roundtrip(rows, work_dir(t.spark, "json"))
