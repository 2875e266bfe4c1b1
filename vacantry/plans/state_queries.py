"""Queries: retry state, due selection, breaker, rate budget, paging and halts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantry.operators import fetchlog as L
from vacantry.operators import retry as M
from vacantry.plans.registry import query
from vacantry.plans.testbed import AS_OF, words

TS = f"TIMESTAMP '{AS_OF}'"
KIND = words("c_custkey", "success", "not_found", "transient_error", "unrecoverable_error", "transient_error")


@query("fetch_events",
       "SELECT event_id, CASE event_id % 9 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'success' ELSE 'not_found' END WHEN 1 THEN 'not_found' WHEN 2 THEN 'unrecoverable_error' WHEN 3 THEN 'transient_error' "
       "WHEN 4 THEN 'transient_error' WHEN 5 THEN 'transient_error' WHEN 6 THEN 'not_found' WHEN 7 THEN 'unrecoverable_error' ELSE 'transient_error' END AS kind FROM events")
def _(t):
    rows = t.table("events").selectExpr(
        "event_id", "CASE WHEN event_id % 9 = 0 THEN 2 END AS candidates", "CASE WHEN event_id % 9 = 0 THEN 1 - user_id % 2 END AS usable",
        "CASE event_id % 9 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 503 END AS http", "CASE event_id % 9 WHEN 4 THEN 'ETIMEDOUT' WHEN 8 THEN 'TypeError' END AS code",
        "CASE event_id % 9 WHEN 5 THEN 'HTTP 502 from host' WHEN 6 THEN 'Job title not found in table' WHEN 7 THEN 'boom' END AS message")
    return rows.select("event_id", M.fetch_event(F.col("candidates"), F.col("usable"), F.col("http"), F.col("code"), F.col("message")).alias("kind"))


NEXT = ("SELECT *, n AS attempts, CASE kind WHEN 'success' THEN 'found' WHEN 'not_found' THEN 'not_found' ELSE 'error' END AS status, CASE WHEN kind = 'not_found' THEN {days} "
        "WHEN kind = 'transient_error' AND n <= 5 THEN least(CAST(pow(2, n - 1) AS INT), 7) END AS days FROM (SELECT *, exact_attempts + 1 AS n, benchmark_attempts + 1 AS bn, " + KIND.replace("c_custkey", "CAST(job_id AS BIGINT)")
        + " AS kind FROM state) s")


@query("retry_schedule",
       "SELECT job_id, status AS exact_status, attempts AS exact_attempts, " + TS + " + to_days(days) AS exact_next_retry_at, CASE WHEN status = 'error' THEN 'msg' END AS exact_error, "
       "benchmark_status, benchmark_attempts FROM nx", ("state",), nx=NEXT.format(days=14))
def _(t):
    outcomes = t.table("customer").selectExpr(
        words("c_custkey", "linkedin", "indeed", "external") + " AS job_source", "CAST(c_custkey AS STRING) AS job_id", f"{KIND} AS kind", "'msg' AS message")
    return M.apply_outcomes(t.state, outcomes, "exact", AS_OF).select(
        "job_id", "exact_status", "exact_attempts", "exact_next_retry_at", "exact_error", "benchmark_status", "benchmark_attempts")


@query("retry_schedule_benchmark",
       "SELECT CAST(job_id AS BIGINT) AS job, CASE kind WHEN 'success' THEN 'found' WHEN 'not_found' THEN 'not_found' ELSE 'error' END AS benchmark_status, " + TS
       + " + to_days(CASE WHEN kind = 'not_found' THEN 30 WHEN kind = 'transient_error' THEN CAST(pow(2, bn - 1) AS INT) END) AS benchmark_next_retry_at, exact_status FROM nx",
       ("state",), nx=NEXT.format(days=30))
def _(t):
    outcomes = t.table("customer").selectExpr(
        words("c_custkey", "linkedin", "indeed", "external") + " AS job_source", "CAST(c_custkey AS STRING) AS job_id", f"{KIND} AS kind", "'msg' AS message")
    return M.apply_outcomes(t.state, outcomes, "benchmark", AS_OF).select(
        F.col("job_id").cast("bigint").alias("job"), "benchmark_status", "benchmark_next_retry_at", "exact_status")


@query("reset_axis",
       "SELECT job_id, CASE WHEN r THEN 'pending' ELSE exact_status END AS exact_status, CASE WHEN r THEN 0 ELSE exact_attempts END AS exact_attempts, CASE WHEN NOT r THEN exact_next_retry_at END "
       "AS exact_next_retry_at, benchmark_status FROM (SELECT *, CAST(job_id AS BIGINT) IN (SELECT s_suppkey FROM supplier) AND job_source = 'indeed' AS r FROM state) x", ("state",))
def _(t):
    jobs = t.table("supplier").selectExpr("'indeed' AS job_source", "CAST(s_suppkey AS STRING) AS job_id")
    return M.reset_axis(t.state, jobs, "exact").select("job_id", "exact_status", "exact_attempts", "exact_next_retry_at", "benchmark_status")


DUE = ("SELECT p.source, p.job_id FROM postings p LEFT JOIN state s ON s.job_source = p.source AND s.job_id = p.job_id WHERE s.job_id IS NULL OR exact_status = 'pending' OR "
       f"(exact_status IN ('not_found', 'error') AND exact_next_retry_at <= {TS})")


@query("due_jobs", DUE, ("postings", "state"))
def _(t):
    return M.due_jobs(t.postings, t.state, AS_OF).select("source", "job_id")


@query("due_batch", f"SELECT * FROM ({DUE}) d ORDER BY source, job_id LIMIT 50", ("postings", "state"))
def _(t):
    return M.batch(M.due_jobs(t.postings, t.state, AS_OF), 50).select("source", "job_id")


@query("never_posted",
       "SELECT source, job_id FROM postings p WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.job_source = p.source AND o.job_id = p.job_id AND is_posted)", ("postings", "observations"))
def _(t):
    return M.never_posted(t.postings, t.observations).select("source", "job_id")


@query("exit_codes",
       "SELECT c_custkey, CASE WHEN kind = 'unrecoverable_error' THEN 5 WHEN kind = 'transient_error' AND c_custkey % 7 > 4 THEN 6 ELSE CASE WHEN kind = 'transient_error' OR c_acctbal > 5000 "
       f"OR kind IN ('success', 'not_found') THEN 0 ELSE 1 END END AS exit_code FROM (SELECT *, {KIND} AS kind FROM customer) s")
def _(t):
    rows = t.table("customer").selectExpr("c_custkey", "c_acctbal > 5000 AS has_best", f"{KIND} AS kind", "c_custkey % 7 > 4 AS exhausted")
    status = F.when(F.col("kind") == "success", "found").when(F.col("kind") == "not_found", "not_found").otherwise("error")
    none = F.lit(None).cast("string")
    return rows.select("c_custkey", M.exit_code(F.col("has_best"), F.col("kind"), F.col("exhausted"), none, F.lit(False), status)
                       .cast("int").alias("exit_code"))


# -- fetch log -------------------------------------------------------------
BLOCKING = "state IN ('blocked', 'rate_limited', 'active_challenge')"
RUNS = (f"SELECT *, CASE WHEN hit THEN row_number() OVER (PARTITION BY source, grp ORDER BY \"at\", id) - CASE WHEN grp = 0 THEN 0 ELSE 1 END ELSE 0 END AS run FROM (SELECT *, "
        f"sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY \"at\", id) AS grp FROM (SELECT *, {BLOCKING} AS hit FROM fetch_log) a) b")
BREAK = ("SELECT r.id, r.source, r.run, CASE WHEN {strict} (r.\"at\", r.id) > (b.\"at\", b.id) THEN 'circuit_broken' WHEN r.nth > 3 THEN 'key_exhausted' ELSE 'allowed' END AS verdict FROM (SELECT *, "
         "row_number() OVER (PARTITION BY source, key ORDER BY \"at\", id) AS nth FROM runs_of) r LEFT JOIN (SELECT source, min(\"at\") AS \"at\", arg_min(id, \"at\") AS id FROM runs_of WHERE run >= 3 GROUP BY 1) b "
         "ON b.source = r.source LEFT JOIN (SELECT source, min(\"at\") AS \"at\" FROM fetch_log WHERE state IN ('blocked', 'rate_limited', 'active_challenge', 'login_required') GROUP BY 1) e ON e.source = r.source")


@query("breaker_verdicts", BREAK.format(strict=""), ("fetch_log",), runs_of=RUNS)
def _(t):
    return L.breaker(t.fetch_log).select("id", "source", "run", "verdict")


@query("breaker_verdicts_strict", BREAK.format(strict="r.\"at\" > e.\"at\" THEN 'source_terminated' WHEN"), ("fetch_log",), runs_of=RUNS)
def _(t):
    return L.breaker(t.fetch_log, strict=True).select("id", "source", "run", "verdict")


@query("breaker_stats",
       "SELECT source, count(*) AS requests, arg_max(run, \"at\") AS open_run, max(run) AS longest_run, max(run) >= 3 AS broken FROM runs_of GROUP BY source", ("fetch_log",), runs_of=RUNS)
def _(t):
    return L.breaker_stats(t.fetch_log)


@query("rate_usage",
       "SELECT id, source, n AS in_window, n > 2 AS over_budget FROM (SELECT id, source, count(*) OVER (PARTITION BY source ORDER BY \"at\" RANGE BETWEEN INTERVAL 900 SECOND PRECEDING AND CURRENT ROW) AS n "
       "FROM fetch_log) s", ("fetch_log",))
def _(t):
    # the events are minutes apart, so the window and budget are scaled to their rate
    return L.rate_usage(t.fetch_log, window_seconds=900, budget=2).select("id", "source", "in_window", "over_budget")


PAGING = ("SELECT *, CASE WHEN hit THEN row_number() OVER (PARTITION BY key, grp ORDER BY \"at\", id) - CASE WHEN grp = 0 THEN 0 ELSE 1 END ELSE 0 END AS run FROM (SELECT *, "
          "sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY \"at\", id) AS grp FROM (SELECT *, new_ids = 0 AS hit FROM fetch_log) a) b")


PAGES_READ = (
    "SELECT r.id, r.key AS query, r.run FROM pg r LEFT JOIN (SELECT key, min(\"at\") AS \"at\" FROM pg WHERE run >= 3 GROUP BY 1) s ON s.key = r.key WHERE s.\"at\" IS NULL OR r.\"at\" <= s.\"at\"")


@query("paging_stop", PAGES_READ, ("fetch_log",), pg=PAGING)
def _(t):
    pages = t.fetch_log.select("id", F.col("key").alias("query"), "new_ids", "at")
    return L.paging_stop(pages).select("id", "query", "run")


HALTS = (
    "SELECT q.id, CASE WHEN q.id > h.halt THEN 'deferred' WHEN q.id = h.halt THEN 'restricted' ELSE 'done' END AS outcome FROM fetch_log q LEFT JOIN (SELECT key, min(id) AS halt FROM fetch_log "
    "WHERE state IN ('blocked', 'rate_limited', 'active_challenge', 'login_required') GROUP BY 1) h ON h.key = q.key")


@query("halted_queue", HALTS, ("fetch_log",))
def _(t):
    queue = t.fetch_log.select("id", F.col("key").alias("source"), F.col("id").alias("position"), "state")
    return L.halt_on_restriction(queue).select("id", "outcome")
