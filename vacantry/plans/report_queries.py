"""Queries: freshness, gate, dashboard, digest, follow-ups, vectors and the enrichment pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantry.operators import prototypes as V
from vacantry.operators import selection as S
from vacantry.operators.aggregates import confusion
from vacantry.plans import enrichment
from vacantry.plans import reports as Q
from vacantry.plans.registry import query
from vacantry.plans.salary_queries import FACTS as PAY_FACTS
from vacantry.plans.salary_queries import pay_text
from vacantry.plans.selection_queries import BLANK, CANON, top
from vacantry.plans.testbed import AS_OF, words
from vacantry.session import work_dir

CUTOFF = 900
_k = "posting_key"
_asof = f"TIMESTAMP '{AS_OF}'"
# posting instant from the numbers the text was built from
POSTED = (f"CASE {_k} % 8 WHEN 0 THEN created_at - to_days(CAST({_k} % 50 AS INT)) WHEN 1 THEN created_at - to_days(CAST({_k} % 45 AS INT)) "
          f"WHEN 2 THEN created_at - to_days(CAST(7 * ({_k} % 9 + 1) AS INT)) WHEN 3 THEN created_at - to_hours({_k} % 23 + 1) "
          f"WHEN 4 THEN created_at - to_days(CAST(30 * ({_k} % 11 + 1) AS INT)) WHEN 5 THEN created_at - INTERVAL 1 DAY END")
METHOD = (f"CASE {_k} % 8 WHEN 0 THEN 'posting_date_iso' WHEN 1 THEN 'relative_day' WHEN 2 THEN 'relative_week' WHEN 3 THEN 'relative_hour' "
          f"WHEN 4 THEN 'relative_month' WHEN 5 THEN 'yesterday' ELSE 'no_signal' END")


def age(ts: str) -> str:
    return f"CAST(floor((epoch({_asof}) - epoch({ts})) / 86400.0 + 0.5) AS BIGINT)"


FRESH = (f"SELECT source, job_id, age_days, CASE WHEN age_days IS NULL AND created_age > {CUTOFF} THEN 'no_signal_but_discovery_exceeds_cutoff' ELSE method END AS age_method, "
         f"CASE WHEN age_days IS NOT NULL THEN CASE WHEN age_days <= {CUTOFF} THEN 'fresh' ELSE 'stale' END WHEN created_age > {CUTOFF} THEN 'stale' ELSE 'unverified' END AS verdict "
         f"FROM (SELECT source, job_id, {METHOD} AS method, {age(POSTED)} AS age_days, {age('created_at')} AS created_age FROM postings) s")


@query("freshness_verdicts", "SELECT * FROM fresh", ("postings",), fresh=FRESH)
def _(t):
    return Q.freshness(t.postings, AS_OF, CUTOFF).select("source", "job_id", "age_days", "age_method", "verdict")


@query("freshness_summary",
       "SELECT source, verdict, age_method, count(*) AS n, min(age_days) AS youngest, max(age_days) AS oldest FROM fresh GROUP BY ALL", ("postings",), fresh=FRESH)
def _(t):
    return Q.freshness_summary(t.postings, AS_OF, CUTOFF)


@query("fresh_matches",
       "SELECT m.search_id, m.source, m.job_id, fit_score, age_days, verdict FROM matches m JOIN fresh f ON f.source = m.source AND f.job_id = m.job_id "
       "WHERE cta = 'Apply' AND verdict IN ('fresh', 'unverified')", ("postings", "matches"), fresh=FRESH)
def _(t):
    return Q.fresh_matches(t.matches, t.postings, AS_OF, CUTOFF, include_unverified=True).select(
        "search_id", "source", "job_id", "fit_score", "age_days", "verdict")


FINDINGS = ("SELECT search_id, source, job_id, finding FROM (SELECT m.search_id, m.source, m.job_id, unnest(list_value(CASE WHEN NOT coalesce(lo.is_posted OR lo.benchmark_id "
            "IS NOT NULL, false) THEN 'missing_provenance' END, CASE WHEN f.verdict = 'stale' THEN 'stale_posting' END)) AS finding FROM matches m JOIN fresh f ON f.source = m.source "
            "AND f.job_id = m.job_id LEFT JOIN (" + top("observations", "job_source, job_id", "observed_at DESC, observation_id", "*")
            + ") lo ON lo.job_source = m.source AND lo.job_id = m.job_id WHERE cta = 'Apply') s WHERE finding IS NOT NULL")


@query("gate_findings", FINDINGS, ("postings", "matches", "observations"), fresh=FRESH)
def _(t):
    return Q.gate_findings(t.matches, t.postings, t.observations, AS_OF, CUTOFF)


RUN_STATES = "SELECT o_orderpriority AS search_id, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'blocked' ELSE 'ok' END AS status FROM orders"


@query("report_gate",
       "SELECT s.search_id, coalesce(a.n, 0) AS apply_rows, coalesce(f.missing, 0) AS missing_provenance, coalesce(f.stale, 0) AS stale_postings, coalesce(r.bad, 0) AS degraded_runs, "
       "coalesce(f.missing, 0) + coalesce(f.stale, 0) + coalesce(r.bad, 0) = 0 AS passed FROM (SELECT DISTINCT search_id FROM matches) s LEFT JOIN (SELECT search_id, count(*) AS n FROM matches "
       "WHERE cta = 'Apply' GROUP BY 1) a ON a.search_id = s.search_id LEFT JOIN (SELECT search_id, count(*) FILTER (finding = 'missing_provenance') AS missing, count(*) FILTER "
       "(finding = 'stale_posting') AS stale FROM findings GROUP BY 1) f ON f.search_id = s.search_id LEFT JOIN (SELECT search_id, count(*) FILTER (status <> 'ok') AS bad FROM runs_of "
       "GROUP BY 1) r ON r.search_id = s.search_id", ("postings", "matches", "observations"), fresh=FRESH, findings=FINDINGS, runs_of=RUN_STATES)
def _(t):
    runs = t.table("orders").selectExpr("o_orderpriority AS search_id",
                                        "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'blocked' ELSE 'ok' END AS status")
    return Q.report_gate(t.matches, t.postings, t.observations, runs, AS_OF, CUTOFF)


@query("status_dashboard",
       f"SELECT 'jobs' AS section, source AS item, count(*) AS n FROM postings GROUP BY source UNION ALL SELECT 'missing_description', source, count(*) FILTER ({BLANK}) FROM postings GROUP BY source "
       "UNION ALL SELECT 'unscored', source, count(*) FILTER (NOT EXISTS (SELECT 1 FROM matches m WHERE m.source = p.source AND m.job_id = p.job_id)) FROM postings p GROUP BY source "
       f"UNION ALL SELECT 'roles', {CANON}, count(*) FROM postings GROUP BY 2 UNION ALL SELECT 'applications', status, count(*) FROM runs GROUP BY status UNION ALL SELECT 'salary_coverage', "
       "'jobs with pay evidence', count(*) FROM (SELECT DISTINCT job_source, job_id FROM observations) o UNION ALL SELECT 'apply_queue', m.search_id, count(*) FROM matches m JOIN postings p ON "
       "p.source = m.source AND p.job_id = m.job_id WHERE fit_score >= 60 AND cta = 'Apply' AND NOT EXISTS (SELECT 1 FROM runs a WHERE a.job_source = m.source AND a.job_id = m.job_id AND a.status "
       f"IN ('submitted', 'success', 'completed')) AND {CANON} NOT IN ('Out of scope', 'Unclassified') GROUP BY m.search_id", ("postings", "matches", "observations", "runs"))
def _(t):
    return Q.status_dashboard(t.postings, t.matches, t.observations, t.runs, 60)


SINCE = "2001-01-15"
DIGEST = (f"SELECT kind, d.source, d.job_id, \"at\", detail, {CANON} AS role_label, CASE WHEN coalesce(trim(description_text), '') <> '' THEN 'full-JD' ELSE 'provisional' END AS role_stage FROM ("
          f"SELECT 'new_job' AS kind, source, job_id, created_at AS \"at\", title AS detail FROM postings WHERE created_at > TIMESTAMP '{SINCE}' UNION ALL SELECT 'new_hit', source, job_id, created_at, "
          f"cta || ' ' || CAST(CAST(fit_score AS DECIMAL(6, 1)) AS VARCHAR) FROM matches WHERE created_at > TIMESTAMP '{SINCE}' AND fit_score >= 60 UNION ALL SELECT 'stage_change', job_source, job_id, "
          f"occurred_at, stage FROM stage_events WHERE occurred_at > TIMESTAMP '{SINCE}' AND (note IS NULL OR note NOT LIKE 'backfilled%')) d JOIN postings p ON p.source = d.source AND p.job_id = d.job_id")


@query("digest", DIGEST, ("postings", "matches", "stage_events"))
def _(t):
    return Q.digest(t.postings, t.matches, t.stage_events, SINCE, 60)


@query("digest_audit", "SELECT kind, role_label, count(*) AS n, count(*) FILTER (role_stage = 'full-JD') AS full_jd FROM dg GROUP BY ALL",
       ("postings", "matches", "stage_events"), dg=DIGEST)
def _(t):
    return Q.digest_audit(Q.digest(t.postings, t.matches, t.stage_events, SINCE, 60))


@query("follow_ups",
       "SELECT l.job_source AS source, l.job_id, stage, CAST(floor((epoch(TIMESTAMP '2024-02-08') - epoch(occurred_at)) / 86400.0) AS BIGINT) AS days_ago, title, url, "
       "row_number() OVER (ORDER BY CAST(floor((epoch(TIMESTAMP '2024-02-08') - epoch(occurred_at)) / 86400.0) AS BIGINT) DESC, l.job_source NULLS FIRST, l.job_id) AS position FROM ("
       + top("stage_events", "job_source, job_id", "occurred_at DESC, id DESC", "*") + ") l JOIN postings p ON p.source = l.job_source AND p.job_id = l.job_id "
       "WHERE stage IN ('applied', 'screening') AND epoch(TIMESTAMP '2024-02-08') - epoch(occurred_at) >= 7 * 86400", ("stage_events", "postings"))
def _(t):
    return Q.follow_ups(t.stage_events, t.postings, "2024-02-08").select("source", "job_id", "stage", "days_ago", "title", "url", "position")


@query("stage_history",
       "SELECT id, job_source, job_id, stage, occurred_at, row_number() OVER (ORDER BY job_source NULLS FIRST, job_id, occurred_at NULLS FIRST, id) AS position "
       "FROM stage_events", ("stage_events",))
def _(t):
    return Q.stage_history(t.stage_events).select("id", "job_source", "job_id", "stage", "occurred_at", "position")


@query("salary_lines",
       "SELECT p.source, p.job_id, CASE WHEN o.job_id IS NULL THEN CASE s.exact_status WHEN 'error' THEN 'Error fetching ' || p.source || ' ' || p.job_id || ': unknown — next retry ' || "
       "strftime(exact_next_retry_at, '%Y-%m-%d') WHEN 'not_found' THEN 'No salary found (' || p.source || ' ' || p.job_id || ') — ' || coalesce('next retry ' || strftime(exact_next_retry_at, '%Y-%m-%d'), "
       "'no further retries (manual)') ELSE 'No salary found (' || p.source || ' ' || p.job_id || ')' END WHEN o.is_posted THEN 'Posted salary ' || o.currency || ' ' || CAST(CAST(amount_min AS BIGINT) AS VARCHAR) "
       "|| '–' || CAST(CAST(amount_max AS BIGINT) AS VARCHAR) || ' (' || p.source || ' ' || p.job_id || ')' ELSE 'Best estimate ' || o.currency || ' ' || CAST(CAST(amount_min AS BIGINT) AS VARCHAR) || '–' || "
       "CAST(CAST(amount_max AS BIGINT) AS VARCHAR) || ' (' || p.source || ' ' || p.job_id || ' benchmark=' || benchmark_id || ')' END AS line FROM postings p LEFT JOIN ("
       + top("observations", "job_source, job_id", "is_posted DESC, observed_at DESC, created_at DESC, observation_id", "*")
       + ") o ON o.job_source = p.source AND o.job_id = p.job_id LEFT JOIN state s ON s.job_source = p.source AND s.job_id = p.job_id", ("postings", "observations", "state"))
def _(t):
    shown = ["is_posted", "currency", "amount_min", "amount_max", "amount_median", "benchmark_id"]
    best = S.latest_posted_first(t.observations, shown).select(
        F.col("job_source").alias("source"), "job_id", F.struct(*shown).alias("best"))
    state = t.state.withColumnRenamed("job_source", "source")
    rows = t.postings.select("source", "job_id").join(best, ["source", "job_id"], "left").join(state, ["source", "job_id"], "left")
    return rows.select("source", "job_id", Q.salary_line(
        F.col("source"), F.col("job_id"), F.col("best"), F.col("exact_status"), F.col("exact_next_retry_at"),
        F.col("exact_error")).alias("line"))


# -- enrichment pass -------------------------------------------------------
# parts are postings with pay text; suppliers give the state; cohorts publish one benchmark each
def pass_inputs(t):
    titles = words("p_size", "Data Engineer", "Nurse", "Cook")
    postings = t.dealt("part", "p_partkey").selectExpr(
        "'linkedin' AS source", "CAST(p_partkey AS STRING) AS job_id", "'https://x.example/' || CAST(p_partkey AS STRING) AS url", f"{titles} AS title",
        f"{pay_text()} AS description_text", "'GB' AS country_code", "CASE WHEN p_size % 2 = 0 THEN 'England' END AS region", "CAST(NULL AS STRING) AS city")
    from vacantry.functions.keys import series_id
    from vacantry.functions.titles import normalize_title, seniority
    b = t.table("supplier").selectExpr(
        "s_suppkey", words("s_suppkey", "Data Engineer", "Nurse") + " AS title", "CAST(floor(s_acctbal) + 50000 AS DOUBLE) AS amount_median",
        "TIMESTAMP '2001-08-01 00:00:00' + make_dt_interval(CAST(s_suppkey % 9 AS INT)) AS fetched_at")
    benchmarks = b.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("benchmark_id"), series_id(
            normalize_title(F.col("title")), seniority(F.col("title")), F.lit("_any"), F.lit("GB"), F.lit(""), F.lit(""),
            F.lit("base_salary"), F.lit("year")).alias("series_id"),
        F.lit("indeed").alias("data_source"), F.lit("https://b.example").alias("data_source_url"), F.lit("GBP").alias("currency"),
        F.lit("year").alias("period"), F.lit("base_salary").alias("compensation_type"),
        F.lit(None).cast("double").alias("amount_min"), F.lit(None).cast("double").alias("amount_max"), "amount_median", "fetched_at")
    # every eighth posting has already been found, and its state says so
    state = t.table("part").selectExpr(
        "'linkedin' AS job_source", "CAST(p_partkey AS STRING) AS job_id", words("p_partkey", "found", *["pending"] * 7) + " AS exact_status",
        "1 AS exact_attempts", "CAST(NULL AS TIMESTAMP) AS exact_next_retry_at", "CAST(NULL AS TIMESTAMP) AS exact_last_attempt_at",
        "CAST(NULL AS STRING) AS exact_error", "'pending' AS benchmark_status", "0 AS benchmark_attempts",
        "CAST(NULL AS TIMESTAMP) AS benchmark_next_retry_at", "CAST(NULL AS TIMESTAMP) AS benchmark_last_attempt_at", "CAST(NULL AS STRING) AS benchmark_error")
    from vacantry.schemas import SALARY_OBSERVATIONS
    observations = t.spark.createDataFrame([], SALARY_OBSERVATIONS)
    return postings, observations, benchmarks, state


def enrich_all(t):
    return enrichment.enrich(*pass_inputs(t), AS_OF, work=work_dir(t.spark, "enrich"))


PASS = (f"SELECT p_partkey, v, lo, hi, d, k, p_size % 3 AS r FROM f JOIN (SELECT p_partkey AS pk, p_size FROM part) p ON pk = p_partkey WHERE p_partkey % 8 <> 0")
BEST_SUPPLIER = ("SELECT nr, arg_min(med, ord) AS med, arg_min(id, ord) AS id FROM (SELECT s_suppkey % 2 AS nr, CAST(floor(s_acctbal) + 50000 AS DOUBLE) AS med, "
                 "'s' || CAST(s_suppkey AS VARCHAR) AS id, CAST(8 - s_suppkey % 9 AS VARCHAR) || 's' || CAST(s_suppkey AS VARCHAR) AS ord FROM supplier) x GROUP BY nr")


@query("enrichment_selected",
       "SELECT CAST(p_partkey AS VARCHAR) AS job_id, posted AS is_posted, CASE WHEN posted THEN 'posted_exact' ELSE 'estimated_market' END AS confidence_label, "
       "CASE WHEN posted THEN NULL ELSE id END AS benchmark_id, CASE WHEN posted THEN NULL ELSE med END AS amount_median FROM (SELECT *, v NOT IN (7, 8, 9) AS posted FROM pass) a "
       "LEFT JOIN best b ON b.nr = a.r WHERE posted OR r < 2", f=PAY_FACTS, **{"pass": PASS, "best": BEST_SUPPLIER})
def _(t):
    out = enrich_all(t)
    return out.selected.select("job_id", "is_posted", "confidence_label", "benchmark_id", "amount_median")


@query("enrichment_state",
       f"SELECT CAST(p_partkey AS VARCHAR) AS job_id, CASE WHEN p_partkey % 8 = 0 OR p_partkey % 12 NOT IN (7, 8, 9) THEN 'found' ELSE 'not_found' END AS exact_status, "
       f"CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 2 END AS exact_attempts, CASE WHEN p_partkey % 8 <> 0 AND p_partkey % 12 IN (7, 8, 9) THEN {_asof} + INTERVAL 14 DAY END AS next_retry, "
       f"CASE WHEN p_partkey % 8 = 0 OR p_partkey % 12 NOT IN (7, 8, 9) THEN 'pending' WHEN p_size % 3 < 2 THEN 'found' ELSE 'not_found' END AS benchmark_status, "
       f"CASE WHEN p_partkey % 8 = 0 OR p_partkey % 12 NOT IN (7, 8, 9) THEN 0 ELSE 1 END AS benchmark_attempts, "
       f"CASE WHEN p_partkey % 8 <> 0 AND p_partkey % 12 IN (7, 8, 9) AND p_size % 3 = 2 THEN {_asof} + INTERVAL 30 DAY END AS benchmark_next_retry FROM part")
def _(t):
    out = enrich_all(t)
    return out.state.select("job_id", "exact_status", "exact_attempts", F.col("exact_next_retry_at").alias("next_retry"),
                            "benchmark_status", "benchmark_attempts", F.col("benchmark_next_retry_at").alias("benchmark_next_retry"))


# every supplier brings a figure of two sources for its own cohort; a third are stored already
@query("enrichment_snapshots",
       "SELECT 'new' || s_suppkey AS benchmark_id, 'indeed' AS data_source, CAST(s_suppkey AS DOUBLE) AS amount_median FROM supplier WHERE s_suppkey % 3 <> 0")
def _(t):
    postings, observations, _benchmarks, state = pass_inputs(t)
    both = t.table("supplier").selectExpr(
        "s_suppkey", "CAST(s_suppkey AS STRING) AS series_id", "'GB' AS country_code", "CAST(s_suppkey AS DOUBLE) AS amount_median",
        "explode(array('indeed', 'somewhere else')) AS data_source", f"TIMESTAMP '{AS_OF}' AS fetched_at",
        "'https://b.example' AS data_source_url", "'GBP' AS currency", "'year' AS period", "'base_salary' AS compensation_type",
        "CAST(NULL AS DOUBLE) AS amount_min", "CAST(NULL AS DOUBLE) AS amount_max")
    both = both.withColumn("payload_hash", F.sha2(F.concat_ws("|", "series_id", "data_source"), 256))
    fetched = both.withColumn("benchmark_id", F.concat(F.lit("new"), "s_suppkey"))
    stored = both.filter("s_suppkey % 3 = 0 AND data_source = 'indeed'").withColumn("benchmark_id", F.concat(F.lit("old"), "s_suppkey"))
    keep = [c for c in fetched.columns if c != "s_suppkey"]
    out = enrichment.enrich(postings, observations, stored.select(*keep), state, AS_OF, fetched=fetched.select(*keep))
    return out.snapshots.select("benchmark_id", "data_source", "amount_median")


@query("enrichment_new_observations",
       "SELECT job_id, amount_min, kind FROM (SELECT CAST(p_partkey AS VARCHAR) AS job_id, CASE WHEN v = 2 OR v = 5 THEN d WHEN v = 6 THEN k * 1000 ELSE lo END AS amount_min, 'base_salary' AS kind "
       "FROM pass WHERE v NOT IN (7, 8, 9) UNION ALL SELECT CAST(p_partkey AS VARCHAR), k, 'base_salary' FROM pass WHERE v = 5 UNION ALL SELECT CAST(p_partkey AS VARCHAR), hi + 20000, 'ote' FROM pass WHERE v = 10 "
       "UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, 'base_salary' FROM pass WHERE v IN (7, 8, 9) AND r < 2) u", f=PAY_FACTS, **{"pass": PASS})
def _(t):
    return enrich_all(t).new_observations.select("job_id", "amount_min", F.col("compensation_type").alias("kind"))


# -- vectors ---------------------------------------------------------------
MEANS = ("SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS pos FROM embeddings {w}) u GROUP BY label, pos")


@query("mean_vectors", "SELECT CAST(label AS VARCHAR) AS category, max(n) AS n, round(sum(m), 6) AS total, round(max(CASE WHEN pos = 7 THEN m END), 6) AS seventh FROM means GROUP BY label",
       means=MEANS.format(w=""))
def _(t):
    rows = V.mean_vectors(t.table("embeddings").withColumn("category", F.col("label").cast("string")), 64)
    total = F.aggregate("mean", F.lit(0.0), lambda a, x: a + x)
    return rows.select("category", "n", F.round(total, 6).alias("total"), F.round(F.get("mean", F.lit(6)), 6).alias("seventh"))


SIMS = ("SELECT e.vec_id, m.label, m.label % 2 = 0 AS eligible, list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * m.v[i])) / sqrt(list_sum(list_transform(e.embedding, "
        "lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(m.v, lambda x: x * x))) AS sim, e.label AS truth FROM embeddings e CROSS JOIN (SELECT label, list(m ORDER BY pos) AS v FROM means GROUP BY label) m "
        "WHERE e.vec_id % 2 = 1")
VERDICT = ("SELECT vec_id, truth, p AS best_eligible, n AS best_other, p >= 0.1 AND p - n >= 0.02 AS is_eligible, CAST(CASE WHEN p >= 0.1 AND p - n >= 0.02 THEN pc ELSE nc END AS VARCHAR) AS predicted_category FROM "
           "(SELECT vec_id, any_value(truth) AS truth, max(sim) FILTER (eligible) AS p, max(sim) FILTER (NOT eligible) AS n, arg_max(label, sim) FILTER (eligible) AS pc, arg_max(label, sim) FILTER (NOT eligible) AS nc "
           "FROM sims GROUP BY vec_id) s")


def classified_vectors(t):
    vectors = t.table("embeddings").withColumn("category", F.col("label").cast("string"))
    number = F.col("category").cast("int")
    means = V.mean_vectors(vectors.filter("vec_id % 2 = 0"), 64).withColumn("eligible", number % 2 == 0).withColumn("ordinal", number)
    return V.classify(vectors.filter("vec_id % 2 = 1"), means, 0.1, 0.02, 64)


@query("classified_vectors",
       "SELECT vec_id, predicted_category, is_eligible, round(best_eligible, 6) AS best_eligible, round(best_other, 6) AS best_other FROM verdict",
       means=MEANS.format(w="WHERE vec_id % 2 = 0"), sims=SIMS, verdict=VERDICT)
def _(t):
    return classified_vectors(t).select("vec_id", "predicted_category", "is_eligible", F.round("best_eligible", 6).alias("best_eligible"),
                                        F.round("best_other", 6).alias("best_other"))


@query("vector_confusion",
       "SELECT count(*) FILTER (e AND p) AS true_positive, count(*) FILTER (NOT e AND NOT p) AS true_negative, count(*) FILTER (NOT e AND p) AS false_positive, count(*) FILTER (e AND NOT p) AS false_negative, "
       "count(*) FILTER (u AND e) AS unknown_total, count(*) FILTER (u AND e AND p) AS unknown_recovered, count(*) FILTER (p <> r) AS disagreements FROM (SELECT truth % 2 = 0 AS e, is_eligible AS p, "
       "vec_id % 3 = 0 AS u, truth < 5 AS r FROM verdict) s", means=MEANS.format(w="WHERE vec_id % 2 = 0"), sims=SIMS, verdict=VERDICT)
def _(t):
    rows = classified_vectors(t).select((F.col("label") % 2 == 0).alias("expected"), F.col("is_eligible").alias("predicted"),
                                        (F.col("vec_id") % 3 == 0).alias("unknown_title"), (F.col("label") < 5).alias("rule_predicted"))
    return confusion(rows)


@query("label_confusion",
       "SELECT count(*) FILTER (e AND p) AS true_positive, count(*) FILTER (NOT e AND NOT p) AS true_negative, count(*) FILTER (NOT e AND p) AS false_positive, count(*) FILTER (e AND NOT p) AS false_negative, "
       "count(*) FILTER (u AND e) AS unknown_total, count(*) FILTER (u AND e AND p) AS unknown_recovered, count(*) FILTER (p <> r) AS disagreements FROM (SELECT quality = 1 AS e, n_chars >= 500 AS p, toxic = 1 AS u, "
       "lang = 'en' AS r FROM labels l JOIN documents d ON d.doc_id = l.doc_id) s")
def _(t):
    rows = t.table("labels").join(t.table("documents").select("doc_id", "n_chars", "lang"), "doc_id").select(
        (F.col("quality") == 1).alias("expected"), (F.col("n_chars") >= 500).alias("predicted"),
        (F.col("toxic") == 1).alias("unknown_title"), (F.col("lang") == "en").alias("rule_predicted"))
    return confusion(rows)
