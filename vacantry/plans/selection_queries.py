"""Queries: keys, top-1 picks, queues, joins, merges and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantry.functions import keys as K
from vacantry.operators import aggregates as A
from vacantry.operators import joins as J
from vacantry.operators import quality as D
from vacantry.operators import selection as S
from vacantry.operators import store
from vacantry.operators.buckets import BucketedTable
from vacantry.plans.registry import ORACLES, query
from vacantry.plans.testbed import AS_OF, choose, text, words
from vacantry.session import work_dir

TS = f"TIMESTAMP '{AS_OF}'"
RANK = ("CASE confidence_label WHEN 'posted_exact' THEN 0 WHEN 'external_exact' THEN 1 "
        "WHEN 'api_exact_match' THEN 2 WHEN 'aggregated_exact_title' THEN 3 WHEN 'company_benchmark' THEN 4 "
        "WHEN 'estimated_market' THEN 5 WHEN 'official_baseline' THEN 6 WHEN 'unknown_exact' THEN 7 ELSE 8 END")


def top(view: str, keys: str, order: str, cols: str) -> str:
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn "
            f"FROM {view}) t WHERE rn = 1")


@query("latest_stage", top("stage_events", "job_source, job_id", "occurred_at DESC, id DESC",
                           "job_source, job_id, id, stage, note, occurred_at"), ("stage_events",))
def _(t):
    return S.latest_stage(t.stage_events)


OBS_COLS = "job_source, job_id, observation_id, data_source, confidence_label, is_posted, observed_at"


@query("latest_posted_observation",
       top("observations", "job_source, job_id",
           "is_posted DESC, observed_at DESC, created_at DESC, observation_id", OBS_COLS), ("observations",))
def _(t):
    return S.latest_posted_first(t.observations, OBS_COLS.split(", ")).select(*OBS_COLS.split(", "))


PRIORITY = ["itjobswatch", "indeed", "levels_fyi", "robert_half", "salaryexpert"]


@query("best_observation",
       top("observations", "job_source, job_id",
           f"{RANK}, is_posted DESC, is_predicted, observed_at DESC, "
           "CASE WHEN city IS NOT NULL THEN 0 WHEN region IS NOT NULL THEN 1 ELSE 2 END, "
           "CASE WHEN country_code = 'DK' THEN 0 WHEN currency = CASE country_code WHEN 'GB' THEN 'GBP' "
           "WHEN 'US' THEN 'USD' ELSE 'EUR' END THEN 0 ELSE 1 END, "
           "CASE data_source WHEN 'itjobswatch' THEN 0 WHEN 'indeed' THEN 1 WHEN 'levels_fyi' THEN 2 "
           "WHEN 'robert_half' THEN 3 WHEN 'salaryexpert' THEN 4 ELSE 5 END, observation_id",
           OBS_COLS + ", currency, amount_median"), ("observations",))
def _(t):
    wanted = [*OBS_COLS.split(", "), "currency", "amount_median"]
    return S.best_observation(t.observations, F.col("country_code"), PRIORITY, wanted).select(*wanted)


@query("latest_observation_per_job",
       top("observations", "job_source, job_id", "observed_at DESC, observation_id", OBS_COLS), ("observations",))
def _(t):
    return S.latest_observation(t.observations, OBS_COLS.split(", ")).select(*OBS_COLS.split(", "))


@query("observation_history",
       f"SELECT {OBS_COLS}, row_number() OVER (ORDER BY job_source NULLS FIRST, job_id, observed_at DESC, observation_id) AS position FROM observations",
       ("observations",))
def _(t):
    return S.observation_history(t.observations).select(*OBS_COLS.split(", "), "position")


@query("observations_by_label", "SELECT job_source, job_id, confidence_label, count(*) AS n FROM observations "
       "GROUP BY ALL", ("observations",))
def _(t):
    return S.observations_by_label(t.observations)


SERIES_SQL = ("substr(sha256(concat_ws('|', lower(normalized_title), lower(coalesce(seniority, '_any')), "
              "lower(coalesce(industry, '_any')), country_code, lower(region), lower(city), compensation_type, "
              "period)), 1, 16)")


def series(b):
    return K.series_id(*[F.col(c) for c in (
        "normalized_title", "seniority", "industry", "country_code", "region", "city",
        "compensation_type", "period")])


def snapshots(t):
    b = t.benchmarks
    return b.withColumn("series_id", series(b)).withColumn("payload_hash", K.payload_hash(F.col("payload")))


PAYLOAD_SQL = ("substr(sha256('{\"a\":{\"x\":\"' || split_part(split_part(payload, '\"x\":\"', 2), '\"', 1) "
               "|| '\",\"y\":1},\"b\":' || split_part(split_part(payload, ':', 2), ',', 1) || '}'), 1, 16)")


@query("benchmark_keys",
       f"SELECT benchmark_id, {SERIES_SQL} AS series_id, {PAYLOAD_SQL} AS payload_hash, "
       f"substr(sha256({SERIES_SQL} || '|' || {PAYLOAD_SQL} || '|' || strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%g') "
       "|| 'Z'), 1, 16) AS snapshot_id FROM benchmarks", ("benchmarks",))
def _(t):
    return snapshots(t).select("benchmark_id", "series_id", "payload_hash", K.benchmark_id(
        F.col("series_id"), F.col("payload_hash"), F.col("fetched_at")).alias("snapshot_id"))


@query("latest_benchmark",
       top(f"(SELECT *, {SERIES_SQL} AS series_id FROM benchmarks)", "series_id",
           "fetched_at DESC, benchmark_id", "series_id, benchmark_id, fetched_at, amount_median, "
           f"{TS} > fetched_at + INTERVAL 30 DAY AS is_stale"), ("benchmarks",))
def _(t):
    return S.latest_benchmark(snapshots(t), AS_OF).select(
        "series_id", "benchmark_id", "fetched_at", "amount_median", "is_stale")


@query("observation_ids",
       "SELECT job_source, job_id, observation_id, substr(sha256(concat_ws('|', currency, "
       "CAST(CAST(amount_min AS BIGINT) AS VARCHAR), CAST(CAST(amount_max AS BIGINT) AS VARCHAR), '', period, "
       "data_source, data_source_url, country_code, lower(coalesce(region, '')), lower(coalesce(city, '')))), 1, 16) "
       "AS content_id FROM observations", ("observations",))
def _(t):
    none = F.lit(None).cast("double")
    return t.observations.select("job_source", "job_id", "observation_id", K.observation_id(
        F.col("currency"), F.col("amount_min"), F.col("amount_max"), none, F.col("period"),
        F.col("data_source"), F.col("data_source_url"), F.col("country_code"), F.col("region"),
        F.col("city")).alias("content_id"))


@query("url_job_ids", "SELECT page_id, substr(sha1(url), 1, 20) AS job_id FROM pages")
def _(t):
    return t.table("pages").select("page_id", K.url_job_id(F.col("url")).alias("job_id"))


# -- queues ----------------------------------------------------------------
CANON = ("CASE regexp_replace(lower(trim(coalesce(role_label, ''))), '[-_ ]+', ' ', 'g') "
         "WHEN 'primary role' THEN 'Primary role' WHEN 'adjacent role' THEN 'Adjacent role' "
         "WHEN 'leadership progression' THEN 'Leadership progression' WHEN 'conditional' THEN 'Conditional' "
         "WHEN 'out of scope' THEN 'Out of scope' WHEN 'data domain stretch' THEN 'Data-domain stretch' "
         "ELSE 'Unclassified' END")
QUEUE_SQL = (
    f"SELECT m.search_id, m.source, m.job_id, fit_score, title, company, {CANON} AS role_label FROM matches m "
    "JOIN postings p ON p.source = m.source AND p.job_id = m.job_id WHERE fit_score >= 60 AND cta = 'Apply' "
    "AND NOT EXISTS (SELECT 1 FROM runs a WHERE a.job_source = m.source AND a.job_id = m.job_id "
    "AND a.status IN ('submitted', 'success', 'completed')) "
    f"AND {CANON} NOT IN ('Out of scope', 'Unclassified')")


@query("apply_queue", QUEUE_SQL + " ORDER BY fit_score DESC, m.source, m.job_id, m.search_id LIMIT 15",
       ("matches", "postings", "runs"))
def _(t):
    return S.apply_queue(t.matches, t.postings, t.runs, 60).select(
        "search_id", "source", "job_id", "fit_score", "title", "company", "role_label")


@query("apply_queue_all", QUEUE_SQL, ("matches", "postings", "runs"))
def _(t):
    return S.apply_queue(t.matches, t.postings, t.runs, 60, size=None).select(
        "search_id", "source", "job_id", "fit_score", "title", "company", "role_label")


@query("top_apply", "SELECT search_id, source, job_id, fit_score FROM matches WHERE cta = 'Apply' "
       "ORDER BY fit_score DESC, source, job_id, search_id LIMIT 20", ("matches",))
def _(t):
    return S.top_apply(t.matches, 20).select("search_id", "source", "job_id", "fit_score")


BOARD = ("CASE stage WHEN 'offer' THEN 0 WHEN 'interview' THEN 1 WHEN 'screening' THEN 2 WHEN 'applied' THEN 3 "
         "WHEN 'ghosted' THEN 4 WHEN 'rejected' THEN 5 ELSE 6 END")


@query("stage_board",
       f"SELECT l.job_source AS source, l.job_id, stage, occurred_at, title, company, {BOARD} AS board_rank, "
       f"row_number() OVER (ORDER BY {BOARD}, occurred_at DESC, l.job_source NULLS FIRST, l.job_id) AS position FROM ("
       + top("stage_events", "job_source, job_id", "occurred_at DESC, id DESC", "*")
       + ") l JOIN postings p ON p.source = l.job_source AND p.job_id = l.job_id", ("stage_events", "postings"))
def _(t):
    return S.stage_board(t.stage_events, t.postings).select(
        "source", "job_id", "stage", "occurred_at", "title", "company",
        F.col("board_rank").cast("int").alias("board_rank"), "position")


@query("salary_queue",
       "SELECT m.search_id, m.source, m.job_id, fit_score, title, country_code, CASE stretch_label "
       "WHEN 'Core fit' THEN 0 WHEN 'Stretch' THEN 1 ELSE 2 END AS queue_rank, row_number() OVER (ORDER BY CASE stretch_label "
       "WHEN 'Core fit' THEN 0 WHEN 'Stretch' THEN 1 ELSE 2 END, fit_score DESC NULLS LAST, lower(title) NULLS FIRST, m.source NULLS FIRST, "
       "m.job_id, m.search_id) AS position FROM matches m JOIN postings p "
       "ON p.source = m.source AND p.job_id = m.job_id WHERE cta = 'Apply'", ("matches", "postings"))
def _(t):
    return S.salary_queue(t.matches, t.postings).select(
        "search_id", "source", "job_id", "fit_score", "title", "country_code", "queue_rank", "position")


@query("scan_queue",
       "SELECT m.search_id, m.source, m.job_id, p.country_code, company, lo.data_source, "
       "CASE p.country_code WHEN 'GB' THEN 0 WHEN 'IE' THEN 1 WHEN 'NL' THEN 2 WHEN 'DK' THEN 3 ELSE 4 END "
       "AS country_rank, row_number() OVER (ORDER BY CASE p.country_code WHEN 'GB' THEN 0 WHEN 'IE' THEN 1 WHEN 'NL' THEN 2 WHEN 'DK' THEN 3 ELSE 4 END, "
       "company NULLS FIRST, title NULLS FIRST, m.source NULLS FIRST, m.job_id, m.search_id) AS position FROM matches m JOIN postings p ON p.source = m.source AND p.job_id = m.job_id LEFT JOIN ("
       + top("observations", "job_source, job_id", "is_posted DESC, observed_at DESC, created_at DESC, observation_id", "*")
       + ") lo ON lo.job_source = p.source AND lo.job_id = p.job_id WHERE cta = 'Apply' "
       "AND NOT coalesce(lo.is_posted, false)", ("matches", "postings", "observations"))
def _(t):
    return S.scan_queue(t.matches, t.postings, t.observations).select(
        "search_id", "source", "job_id", "country_code", "company", "data_source", "country_rank", "position")


@query("backfill_candidates",
       "SELECT source, job_id, updated_at, language_reason, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, lower(title) NULLS FIRST, "
       "source NULLS FIRST, job_id) AS position FROM postings WHERE description_text IS NULL "
       "OR trim(description_text) = '' OR language_reason LIKE 'FAIL: Could not extract JD%' "
       "OR language_reason LIKE 'scrape_failed:%'", ("postings",))
def _(t):
    return S.backfill_candidates(t.postings, retry_failed=True).select(
        "source", "job_id", "updated_at", "language_reason", "position")


# queries of a search plan: each supplier stands for a query, its parts for the listed ids
IDS = ("lineitem", (("query", f"'query ' || {text('l_suppkey % 20')}"), ("query_order", "l_suppkey % 20"),
                    ("position", "l_orderkey"), ("job_id", text("l_partkey"))))
IDS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in IDS[1]) + " FROM lineitem"
KNOWN_SQL = "SELECT CAST(c_custkey AS STRING) AS job_id FROM customer WHERE c_acctbal < 2000"


def listed_ids(t):
    return t.table("lineitem").selectExpr(*[f"{e} AS {n}" for n, e in IDS[1]])


def known_ids(t):
    return t.table("customer").filter("c_acctbal < 2000").selectExpr("CAST(c_custkey AS STRING) AS job_id")


BUDGET_SQL = ("SELECT job_id, query, query_order, position FROM ("
              + top("ids", "job_id", "query_order, position", "*") + ") f WHERE job_id NOT IN "
              "(SELECT job_id FROM known) ORDER BY query_order, position, job_id LIMIT 50")


@query("detail_budget", BUDGET_SQL, ids=IDS_SQL, known=KNOWN_SQL)
def _(t):
    return S.detail_budget(listed_ids(t), known_ids(t), 50).select("job_id", "query", "query_order", "position")


@query("query_stats",
       "SELECT query, ids_total, ids_unseen, ids_admitted, CASE WHEN ids_unseen = 0 THEN 'no_new_ids' "
       "WHEN ids_admitted = 0 THEN 'detail_limit_reached' ELSE 'persisted' END AS status FROM ("
       "SELECT i.query, count(*) AS ids_total, count(*) FILTER (k.job_id IS NULL) AS ids_unseen, "
       "count(*) FILTER (a.job_id IS NOT NULL) AS ids_admitted FROM (SELECT DISTINCT query, job_id FROM ids) i "
       "LEFT JOIN known k ON k.job_id = i.job_id LEFT JOIN admitted a ON a.job_id = i.job_id AND a.query = i.query "
       "GROUP BY i.query) s", ids=IDS_SQL, known=KNOWN_SQL, admitted=BUDGET_SQL)
def _(t):
    ids, known = listed_ids(t), known_ids(t)
    return A.query_stats(ids, known, S.detail_budget(ids, known, 50))


@query("explicit_refresh_union",
       "SELECT job_id, query, query_order FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY "
       "query_order, position) AS rn FROM (SELECT job_id, 'explicit refresh' AS query, -1 AS query_order, "
       "0 AS position FROM known UNION ALL SELECT job_id, query, query_order, position FROM ids) u) t WHERE rn = 1",
       ids=IDS_SQL, known=KNOWN_SQL)
def _(t):
    explicit = known_ids(t).withColumn("position", F.lit(0).cast("bigint"))
    return S.union_first_seen(explicit, listed_ids(t)).select("job_id", "query", "query_order")


@query("refresh_bypass", "SELECT CAST(l_partkey AS STRING) AS job_id FROM lineitem EXCEPT SELECT job_id FROM known",
       known=KNOWN_SQL)
def _(t):
    have = t.table("lineitem").selectExpr("CAST(l_partkey AS STRING) AS job_id").distinct()
    return have.join(known_ids(t), "job_id", "left_anti")


@query("keywords_by_id",
       "SELECT job_id, string_agg(query, '; ' ORDER BY query_order, query) AS keywords FROM "
       "(SELECT DISTINCT job_id, query, query_order FROM ids) d GROUP BY job_id", ids=IDS_SQL)
def _(t):
    return A.keywords_by_id(listed_ids(t))


@query("first_seen_urls", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def _(t):
    return S.first_seen(t.table("pages").select("url", "page_id"), ["url"], "page_id")


# -- joins -----------------------------------------------------------------
@query("scored_postings",
       "SELECT m.search_id, m.source, m.job_id, fit_score, cta, title, company FROM matches m JOIN postings p "
       "ON p.source = m.source AND p.job_id = m.job_id", ("matches", "postings"))
def _(t):
    from vacantry.operators.joins import scored_postings
    return scored_postings(t.matches, t.postings).select(
        "search_id", "source", "job_id", "fit_score", "cta", "title", "company")


@query("staged_postings",
       "SELECT e.id, e.job_source AS source, e.job_id, stage, title FROM stage_events e JOIN postings p "
       "ON p.source = e.job_source AND p.job_id = e.job_id", ("stage_events", "postings"))
def _(t):
    from vacantry.operators.joins import staged_postings
    return staged_postings(t.stage_events, t.postings).select("id", "source", "job_id", "stage", "title")


@query("unscored_postings",
       "SELECT source, job_id FROM postings p WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE "
       "m.source = p.source AND m.job_id = p.job_id)", ("postings", "matches"))
def _(t):
    from vacantry.operators.joins import without_match
    return without_match(t.postings, t.matches).select("source", "job_id")


@query("queue_file_semi_join",
       "SELECT p.source, p.job_id FROM postings p WHERE EXISTS (SELECT 1 FROM q WHERE q.job_id = p.job_id "
       "AND coalesce(q.source, p.source) = p.source)", ("postings",),
       q=f"SELECT CAST(c_custkey AS STRING) AS job_id, {words('c_custkey', 'linkedin', None)} AS source FROM customer")
def _(t):
    from vacantry.operators.joins import queued_postings
    queue = t.table("customer").selectExpr("CAST(c_custkey AS STRING) AS job_id",
                                           f"{words('c_custkey', 'linkedin', None)} AS source")
    return queued_postings(t.postings, queue).select("source", "job_id")


@query("apply_rows_with_evidence",
       "SELECT m.search_id, m.source, m.job_id, lo.observation_id, lo.is_posted FROM matches m LEFT JOIN ("
       + top("observations", "job_source, job_id", "observed_at DESC, observation_id", "*")
       + ") lo ON lo.job_source = m.source AND lo.job_id = m.job_id WHERE cta = 'Apply'",
       ("matches", "observations"))
def _(t):
    from vacantry.operators.joins import apply_with_latest
    return apply_with_latest(t.matches, t.observations).select(
        "search_id", "source", "job_id", "observation_id", "is_posted")


@query("score_display",
       "SELECT m.source, m.job_id, fit_score, title, company, country_code, url FROM matches m LEFT JOIN postings p "
       "ON p.source = m.source AND p.job_id = m.job_id", ("matches", "postings"))
def _(t):
    from vacantry.operators.joins import display_facts
    return display_facts(t.matches, t.postings).select(
        "source", "job_id", "fit_score", "title", "company", "country_code", "url")


# -- counts ----------------------------------------------------------------
BLANK = "(description_text IS NULL OR trim(description_text) = '')"


@query("jobs_by_source", f"SELECT source, count(*) AS n, count(*) FILTER ({BLANK}) AS missing_description "
       "FROM postings GROUP BY source", ("postings",))
def _(t):
    return A.jobs_by_source(t.postings)


@query("description_coverage",
       f"SELECT role_label, count(*) AS n, count(*) FILTER (NOT {BLANK}) AS full_jd, "
       f"count(*) FILTER ({BLANK}) AS provisional FROM postings GROUP BY role_label", ("postings",))
def _(t):
    return A.description_coverage(t.postings)


@query("role_counts",
       f"SELECT {CANON} AS label, count(*) AS n, count(*) FILTER (NOT {BLANK}) AS full_jd, "
       f"count(*) FILTER ({BLANK}) AS provisional, count(DISTINCT nullif(role_label, '')) AS raw_labels "
       "FROM postings GROUP BY 1", ("postings",))
def _(t):
    return A.role_counts(t.postings)


@query("role_label_breakdown",
       f"SELECT {CANON} AS label, trim(coalesce(role_label, '')) AS raw_label, count(*) AS n FROM postings "
       "GROUP BY 1, 2", ("postings",))
def _(t):
    return A.role_label_breakdown(t.postings)


@query("salary_coverage",
       "SELECT covered, total, CAST(floor(100.0 * covered / total + 0.5) AS BIGINT) AS pct FROM (SELECT "
       "(SELECT count(*) FROM (SELECT DISTINCT job_source, job_id FROM observations)) AS covered, "
       "(SELECT count(*) FROM postings) AS total)", ("postings", "observations"))
def _(t):
    return A.salary_coverage(t.postings, t.observations)


@query("application_status_counts", "SELECT status, count(*) AS n FROM runs GROUP BY status", ("runs",))
def _(t):
    return A.status_counts(t.runs)


HEALTH_AT = "1998-07-15 09:30:00"
RATES = ("SELECT {g} AS source, count(*) FILTER (observed_at >= TIMESTAMP '1998-06-15') AS total_current, "
         "count(*) FILTER (observed_at >= TIMESTAMP '1998-06-15' AND is_posted) AS hits_current, "
         "count(*) FILTER (observed_at < TIMESTAMP '1998-06-15') AS total_prior, "
         "count(*) FILTER (observed_at < TIMESTAMP '1998-06-15' AND is_posted) AS hits_prior FROM observations "
         "WHERE observed_at >= TIMESTAMP '1998-05-16' AND observed_at < TIMESTAMP '1998-07-15' GROUP BY 1")


@query("hit_rates", RATES.format(g="job_source"), ("observations",))
def _(t):
    return A.hit_rates(t.observations, HEALTH_AT)


@query("source_health",
       "SELECT source, tc AS total_current, CASE WHEN tc > 0 THEN hc / tc END AS rate_current, "
       "CASE WHEN tc > 0 AND tp > 0 THEN hp / tp END AS rate_prior, CASE WHEN tc > 0 AND tp > 0 AND hp > 0 THEN "
       "(hc / tc - hp / tp) / (hp / tp) * 100 END AS delta_pct, tc > 0 AND tp > 0 AND hc * tp * 10 < hp * tc * 8 "
       "AS warning, CASE WHEN tc = 0 THEN 'no_data' WHEN tp = 0 THEN 'insufficient_baseline' "
       "WHEN hc * tp * 10 < hp * tc * 8 THEN 'warning' ELSE 'ok' END AS state FROM (SELECT coalesce(k.source, "
       "r.source) AS source, coalesce(total_current, 0) AS tc, coalesce(hits_current, 0) AS hc, "
       "coalesce(total_prior, 0) AS tp, coalesce(hits_prior, 0) AS hp FROM (VALUES ('linkedin'), ('itjobswatch'), "
       "('glassdoor')) k(source) FULL JOIN rates r ON r.source = k.source) j", ("observations",),
       rates=RATES.format(g="data_source"))
def _(t):
    rates = A.hit_rates(t.observations, HEALTH_AT, source="data_source")
    return A.source_health(rates, ["linkedin", "itjobswatch", "glassdoor"])


KNOWN_LABELS = ("('Primary role', 'Adjacent role', 'Leadership progression', 'Conditional', 'Out of scope', "
                "'Unclassified', 'Exact architecture', 'Adjacent technical', 'Leadership lateral', "
                "'Data-domain stretch')")


@query("classification_audit",
       "SELECT count(*) AS total, count(*) FILTER (l <> '') AS classified, count(*) FILTER (l <> '' AND v = '3') "
       "AS current_version, count(*) FILTER (l <> '' AND v = '') AS unversioned, count(*) FILTER (l <> '' AND "
       "v NOT IN ('', '3')) AS stale_version, count(*) FILTER (l <> '' AND l NOT IN " + KNOWN_LABELS + ") AS unknown_label "
       "FROM (SELECT trim(coalesce(role_label, '')) AS l, coalesce(taxonomy_version, '') AS v FROM postings) s",
       ("postings",))
def _(t):
    return A.classification_audit(t.postings)


@query("audit_breakdown",
       "SELECT 'unknown_label' AS finding, role_label AS value, count(*) AS n FROM postings WHERE role_label <> '' "
       f"AND role_label NOT IN {KNOWN_LABELS} GROUP BY 2 UNION ALL SELECT 'stale_version', taxonomy_version, count(*) "
       "FROM postings WHERE role_label <> '' AND taxonomy_version NOT IN ('', '3') GROUP BY 2", ("postings",))
def _(t):
    return A.audit_breakdown(t.postings)


@query("run_snapshot",
       f"SELECT p.source, count(*) AS new_jobs, count(*) FILTER (NOT {BLANK}) AS with_description, "
       f"count(*) FILTER (NOT {BLANK} AND application_status = 'saved' AND m.job_id IS NULL) AS unscored "
       "FROM postings p LEFT JOIN (SELECT DISTINCT source, job_id FROM matches) m ON m.source = p.source AND "
       "m.job_id = p.job_id WHERE p.created_at >= TIMESTAMP '2000-01-01' GROUP BY 1", ("postings", "matches"))
def _(t):
    return A.run_snapshot(t.postings, t.matches, "2000-01-01")


@query("fresh_apply_queue",
       "SELECT p.source, count(*) AS n FROM postings p JOIN matches m ON m.source = p.source AND m.job_id = p.job_id "
       "WHERE application_status = 'saved' AND fit_score >= 50 AND cta IN ('Apply', 'Maybe') AND p.created_at > "
       "TIMESTAMP '2001-07-15' - INTERVAL 14 DAY GROUP BY 1", ("postings", "matches"))
def _(t):
    return A.fresh_apply_queue(t.postings, t.matches, "2001-07-15", 50)


@query("cohort_medians",
       "SELECT country_code, city, currency, count(*) AS n, min(annualized_median) AS min_median, "
       "max(annualized_median) AS max_median FROM observations WHERE confidence_label = 'estimated_market' "
       "GROUP BY ALL", ("observations",))
def _(t):
    return A.cohort_medians(t.observations)


@query("cohort_benchmarks",
       "SELECT normalized_title, country_code, currency, count(*) AS n, min(amount_median) AS min_median, max(amount_median) AS max_median FROM ("
       + top(f"(SELECT *, {SERIES_SQL} AS series_id FROM benchmarks)", "series_id", "fetched_at DESC, benchmark_id", "*") + ") l GROUP BY ALL", ("benchmarks",))
def _(t):
    return A.latest_cohort_benchmarks(S.latest_benchmark(snapshots(t), AS_OF))


# half of all postings are in one cohort
COHORT = "CASE WHEN o_orderkey % 2 = 0 THEN 'everyone' ELSE 'cohort ' || CAST(o_custkey % 61 AS {}) END"
COHORT_MEDIANS = "CASE WHEN p_partkey % 50 = 0 THEN 'everyone' ELSE 'cohort ' || CAST(p_partkey % 50 AS {}) END"


@query("cohort_hot_key",
       f"SELECT job_id, max(median) AS median FROM (SELECT o_orderkey AS job_id, {COHORT.format('VARCHAR')} AS cohort FROM orders) o "
       f"JOIN (SELECT {COHORT_MEDIANS.format('VARCHAR')} AS cohort, max(p_retailprice) AS median FROM part GROUP BY 1) b USING (cohort) GROUP BY job_id")
def _(t):
    postings = t.table("orders").selectExpr("o_orderkey AS job_id", COHORT.format("STRING") + " AS cohort")
    medians = t.table("part").selectExpr(COHORT_MEDIANS.format("STRING") + " AS cohort", "p_retailprice").groupBy("cohort").agg(
        F.max("p_retailprice").alias("median"))
    return J.spread_join(postings, medians, "cohort").groupBy("job_id").agg(F.max("median").alias("median"))


@query("posted_pay_by_company",
       "SELECT company, p.country_code, currency, period, compensation_type, count(mid) AS samples, "
       "median(mid) AS median_mid FROM postings p LEFT JOIN (SELECT *, (amount_min + amount_max) / 2 AS mid FROM "
       "observations WHERE is_posted) o ON o.job_source = p.source AND o.job_id = p.job_id GROUP BY ALL",
       ("postings", "observations"))
def _(t):
    return A.posted_pay_summary(t.observations, t.postings)


@query("posted_pay_by_title",
       "SELECT title, p.country_code, currency, period, compensation_type, count(mid) AS samples, "
       "median(mid) AS median_mid FROM postings p LEFT JOIN (SELECT *, (amount_min + amount_max) / 2 AS mid FROM "
       "observations WHERE is_posted) o ON o.job_source = p.source AND o.job_id = p.job_id GROUP BY ALL",
       ("postings", "observations"))
def _(t):
    return A.posted_pay_summary(t.observations, t.postings, "title")


@query("sponsor_status",
       "SELECT o_orderkey, employer, coalesce(n, 0) AS entries, CASE WHEN coalesce(n, 0) = 1 THEN "
       "'confirmed_skilled_worker' WHEN n > 1 THEN 'ambiguous' ELSE 'no_confirmed_match' END AS employer_status FROM "
       "(SELECT o_orderkey, 'Company ' || CAST(o_custkey % 97 AS STRING) AS employer, o_custkey % 97 AS nr FROM orders) e "
       "LEFT JOIN (SELECT p_partkey % 211 AS nr, count(DISTINCT p_size % 2) AS n FROM part WHERE p_type <> 'ECONOMY' "
       "GROUP BY 1) r ON r.nr = e.nr")
def _(t):
    employers = t.table("orders").selectExpr(
        "o_orderkey", "'Company ' || CAST(o_custkey % 97 AS STRING) AS employer")
    register = t.table("part").selectExpr(
        "'  COMPANY,  ' || CAST(p_partkey % 211 AS STRING) AS name", "CAST(p_size % 2 AS STRING) AS town",
        "CASE WHEN p_type <> 'ECONOMY' THEN 'Skilled Worker' ELSE 'Other' END AS route")
    return A.sponsor_status(employers, register)


@query("search_summary",
       "SELECT count(*) AS scraped, count(*) FILTER (r) AS role_matches, count(*) FILTER (r AND l) AS included, "
       "count(*) FILTER (r AND NOT l) AS language_skipped, count(*) FILTER (NOT r) AS role_skipped, "
       "count(*) FILTER (d) AS described, count(*) FILTER (NOT d) AS failed, count(*) FILTER (d) AS persisted, "
       "count(*) FILTER (f) AS refresh_found, count(*) FILTER (f AND d) AS refreshed FROM (SELECT "
       "o_orderkey % 5 > 1 AS d, o_custkey % 12 <> 5 AS r, o_custkey % 4 <> 1 AS l, o_totalprice < 20000 AS f FROM orders) s")
def _(t):
    records = t.table("orders").selectExpr(
        "o_orderkey % 5 > 1 AS has_description", "o_custkey % 12 <> 5 AS role_passed",
        "o_custkey % 4 <> 1 AS language_passed", "o_orderkey % 5 > 1 AS persisted",
        "o_totalprice < 20000 AS is_refresh")
    return A.search_summary(records)


@query("discovery_summary",
       "SELECT discovered, inserted, discovered - inserted AS existing, backfilled, failed FROM (SELECT "
       "(SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem)) AS discovered, "
       "(SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) l WHERE l_orderkey NOT IN "
       "(SELECT o_orderkey FROM orders WHERE o_totalprice >= 30000)) AS inserted, "
       "(SELECT count(*) FROM pages WHERE length(html) > 2000) AS backfilled, "
       "(SELECT count(*) FROM pages WHERE length(html) <= 2000) AS failed)")
def _(t):
    found = t.table("lineitem").selectExpr(f"{words('l_orderkey', 'linkedin', 'indeed', 'external')} AS source",
                                           "CAST(l_orderkey AS STRING) AS job_id")
    return A.discovery_summary(found, t.matches, t.table("pages").select((F.length("html") > 2000).alias("ok")))


OUTCOME_STATUS = words("c_custkey", "found", "not_found", "error", "pending", "not_found")
OUTCOME_CODE = ("CASE WHEN c_custkey % 5 = 2 THEN "
                + choose("floor(c_acctbal) + 1000", "5", "6", "7", "0") + " ELSE 0 END")
OUTCOME = f"SELECT {OUTCOME_STATUS} AS exact_status, {OUTCOME_CODE} AS exit_code FROM customer"


def outcomes(t):
    return t.table("customer").selectExpr(f"{OUTCOME_STATUS} AS exact_status", f"{OUTCOME_CODE} AS exit_code")


@query("enrichment_summary",
       "SELECT count(*) AS total, count(*) FILTER (exact_status = 'found') AS found, count(*) FILTER "
       "(exact_status = 'not_found') AS not_found, count(*) FILTER (exact_status = 'error' AND exit_code = 0) AS error, "
       "count(*) FILTER (exit_code = 5) AS unrecoverable, count(*) FILTER (exit_code = 6) AS transient_exhausted, "
       "count(*) FILTER (exit_code = 7) AS pipeline_exception, greatest(5000 - count(*), 0) AS more_eligible "
       "FROM outcomes", outcomes=OUTCOME)
def _(t):
    return A.enrichment_summary(outcomes(t), 5000)


@query("worst_exit_code",
       "SELECT CAST(CASE WHEN bool_or(exit_code = 5) THEN 5 WHEN bool_or(exit_code = 7) THEN 7 "
       "WHEN bool_or(exit_code = 6) THEN 6 ELSE 0 END AS BIGINT) AS exit_code FROM outcomes", outcomes=OUTCOME)
def _(t):
    return A.worst_exit_code(outcomes(t))


# -- merges ----------------------------------------------------------------
INCOMING_KEYS = ("customer", choose("c_custkey", "c_custkey * 7", "c_custkey * 3 + 100000000"))


def incoming(t):
    """Upserts: half hit stored postings, half are new; a third carry no description."""
    k = "c_custkey"
    nr = INCOMING_KEYS[1]
    return t.table("customer").selectExpr(
        f"{words('(' + nr + ')', 'linkedin', 'indeed', 'external')} AS source", f"CAST({nr} AS STRING) AS job_id",
        f"'Updated ' || CAST({k} AS STRING) AS title", f"CASE WHEN {k} % 3 = 0 THEN ' ' ELSE 'New text' END AS description_text",
        f"CASE WHEN {k} % 4 = 0 THEN NULL ELSE 'Conditional' END AS role_label",
        "CAST(0.5 AS DOUBLE) AS role_confidence", "'4' AS taxonomy_version",
        "TIMESTAMP '2001-08-10 00:00:00' AS created_at", "'saved' AS application_status")


INCOMING_SQL = (
    f"SELECT {words('(' + INCOMING_KEYS[1] + ')', 'linkedin', 'indeed', 'external')} AS source, "
    f"CAST({INCOMING_KEYS[1]} AS STRING) AS job_id, 'Updated ' || CAST(c_custkey AS STRING) AS title, "
    "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'New text' END AS description_text, "
    "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Conditional' END AS role_label, "
    "'4' AS taxonomy_version FROM customer")


MERGE_COLUMNS = ["source", "job_id", "title", "description_text", "role_label", "role_confidence",
                 "taxonomy_version", "created_at", "application_status"]


@query("merge_postings",
       "SELECT coalesce(i.source, e.source) AS source, coalesce(i.job_id, e.job_id) AS job_id, "
       "CASE WHEN i.job_id IS NOT NULL THEN i.title ELSE e.title END AS title, "
       "CASE WHEN i.job_id IS NOT NULL THEN i.description_text ELSE e.description_text END AS description_text, "
       f"CASE WHEN coalesce(trim(i.description_text), '') = '' AND e.role_label IN {KNOWN_LABELS} THEN "
       "coalesce(e.role_label, i.role_label) ELSE coalesce(i.role_label, e.role_label) END AS role_label, "
       f"CASE WHEN coalesce(trim(i.description_text), '') = '' AND e.role_label IN {KNOWN_LABELS} THEN "
       "coalesce(e.taxonomy_version, i.taxonomy_version) ELSE coalesce(i.taxonomy_version, e.taxonomy_version) END "
       "AS taxonomy_version, "
       "CASE WHEN e.job_id IS NOT NULL THEN e.application_status ELSE 'saved' END AS application_status, "
       "CASE WHEN e.job_id IS NOT NULL THEN e.created_at ELSE TIMESTAMP '2001-08-10 00:00:00' END AS created_at "
       "FROM postings e FULL JOIN incoming i ON i.source = e.source AND i.job_id = e.job_id",
       ("postings",), incoming=INCOMING_SQL)
def _(t):
    return store.merge_postings(t.postings.select(*MERGE_COLUMNS), incoming(t)).drop("role_confidence")


@query("replace_children",
       "SELECT job_source, job_id, stage FROM stage_events WHERE job_id NOT IN (SELECT CAST(c_custkey AS STRING) FROM "
       "customer WHERE c_acctbal < 1000) OR job_source <> 'linkedin' UNION ALL SELECT 'linkedin', CAST(c_custkey AS STRING), "
       "'applied' FROM customer WHERE c_acctbal < 1000", ("stage_events",))
def _(t):
    touched = t.table("customer").filter("c_acctbal < 1000").selectExpr(
        "'linkedin' AS job_source", "CAST(c_custkey AS STRING) AS job_id", "'applied' AS stage")
    return store.replace_children(t.stage_events.select("job_source", "job_id", "stage"), touched, touched,
                                  ["job_source", "job_id"])


@query("insert_ignore",
       "SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders "
       "WHERE o_totalprice >= 200000)")
def _(t):
    log = t.table("orders").filter("o_totalprice >= 200000").select(F.col("o_orderkey").alias("k"))
    rows = t.table("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey")
    return store.insert_ignore(log, rows, ["k"]).select("k")


@query("insert_summary",
       "SELECT arrived, inserted, arrived - inserted AS existing FROM (SELECT (SELECT count(*) FROM lineitem) AS arrived, "
       "(SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE "
       "o_totalprice >= 200000)) AS inserted)")
def _(t):
    log = t.table("orders").filter("o_totalprice >= 200000").select(F.col("o_orderkey").alias("k"))
    rows = t.table("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey")
    return store.insert_summary(rows, store.insert_ignore(log, rows, ["k"]))


@query("store_snapshot",
       "SELECT benchmark_id, series_id, payload_hash, src = 1 AS inserted FROM (SELECT *, row_number() OVER (PARTITION BY "
       "series_id, payload_hash ORDER BY src, fetched_at, benchmark_id) AS rn FROM (SELECT *, 1 AS src FROM snap UNION ALL "
       "SELECT *, 0 FROM snap WHERE amount_median < 950) u) t WHERE rn = 1",
       ("benchmarks",), snap=f"SELECT *, {SERIES_SQL} AS series_id, {PAYLOAD_SQL} AS payload_hash FROM benchmarks")
def _(t):
    new = snapshots(t)
    old = new.filter("amount_median < 950")
    return store.store_snapshot(old, new).select("benchmark_id", "series_id", "payload_hash", "inserted")


@query("existing_ids",
       f"SELECT source, job_id FROM postings WHERE NOT {BLANK} AND coalesce(language_reason, '') NOT LIKE 'scrape_failed:%'",
       ("postings",))
def _(t):
    return store.existing_ids(t.postings, retry_failed=True)


@query("export_to_score",
       "SELECT source, job_id, title, company, city, country_code, description_text AS description, url, created_at "
       "FROM postings p WHERE created_at >= TIMESTAMP '1999-01-01' AND application_status = 'saved' AND "
       f"NOT {BLANK} AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.source = p.source AND m.job_id = p.job_id)",
       ("postings", "matches"))
def _(t):
    return store.export_to_score(t.postings, t.matches, "1999-01-01")


@query("upsert_scores",
       "SELECT search_id, source, job_id, fit_score FROM matches WHERE fit_score < 90 UNION ALL SELECT search_id, source, "
       "job_id, 99.5 FROM matches WHERE fit_score >= 90", ("matches",))
def _(t):
    old = t.matches.select("search_id", "source", "job_id", "fit_score")
    new = old.filter("fit_score >= 90").withColumn("fit_score", F.lit(99.5))
    return store.upsert(old, new, ["search_id", "source", "job_id"])


@query("backfill_stage_events",
       "SELECT source AS job_source, job_id, 'applied' AS stage, 'backfilled from jobs.applied_at' AS note, "
       f"coalesce(applied_at, {TS}) AS occurred_at FROM postings p WHERE application_status = 'applied' AND NOT EXISTS "
       "(SELECT 1 FROM stage_events e WHERE e.job_source = p.source AND e.job_id = p.job_id)",
       ("postings", "stage_events"))
def _(t):
    return store.backfill_stage_events(t.postings, t.stage_events, AS_OF)


LAST_MIRROR = ("SELECT job_source, job_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY job_source, job_id "
               "ORDER BY occurred_at DESC, id DESC) AS rn FROM stage_events WHERE stage IN ('applied', 'withdrawn')) x WHERE rn = 1")


@query("set_stage",
       "SELECT p.source, p.job_id, coalesce(m.stage, p.application_status) AS application_status, "
       "coalesce(p.applied_at, a.at) AS applied_at FROM postings p LEFT JOIN last_mirror m ON m.job_source = p.source AND "
       "m.job_id = p.job_id LEFT JOIN (SELECT job_source, job_id, min(occurred_at) AS at FROM stage_events WHERE "
       "stage = 'applied' GROUP BY 1, 2) a ON a.job_source = p.source AND a.job_id = p.job_id",
       ("postings", "stage_events"), last_mirror=LAST_MIRROR)
def _(t):
    _, updated = store.set_stage(t.postings, t.stage_events, t.stage_events)
    return updated.select("source", "job_id", "application_status", "applied_at")


# -- data contracts --------------------------------------------------------
@query("invalid_observations",
       "SELECT job_source, job_id, observation_id, violations FROM (SELECT *, concat_ws(',', CASE WHEN matched_by = 'guess' "
       "THEN 'matched_by' END, CASE WHEN is_posted AND confidence_label NOT IN ('posted_exact', 'external_exact', "
       "'api_exact_match', 'unknown_exact') THEN 'exact' END, CASE WHEN NOT is_posted AND confidence_label IN ('posted_exact', "
       "'external_exact', 'api_exact_match', 'unknown_exact') THEN 'estimate' END, CASE WHEN is_predicted AND is_posted THEN "
       "'predicted' END) AS violations FROM observations) s WHERE violations <> ''",
       ("observations",))
def _(t):
    return D.invalid_observations(t.observations).select(
        "job_source", "job_id", "observation_id", F.array_join("violations", ",").alias("violations"))


@query("duplicate_observation_keys",
       "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return D.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("invalid_scores",
       "SELECT source, job_id, CASE WHEN must_matched > must_total THEN 'must_counts' ELSE '' END || "
       "CASE WHEN must_matched > must_total AND nice_matched > nice_total THEN ',' ELSE '' END || "
       "CASE WHEN nice_matched > nice_total THEN 'nice_counts' ELSE '' END AS violations FROM matches "
       "WHERE must_matched > must_total OR nice_matched > nice_total", ("matches",))
def _(t):
    return D.invalid_scores(t.matches).select("source", "job_id", F.array_join("violations", ",").alias("violations"))


@query("orphan_observations",
       "SELECT job_source, job_id, observation_id FROM observations o WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE "
       "m.source = o.job_source AND m.job_id = o.job_id)", ("observations", "matches"))
def _(t):
    return D.orphans(t.observations, t.matches, {"job_source": "source", "job_id": "job_id"}).select(
        "job_source", "job_id", "observation_id")


@query("orphan_benchmark_links",
       "SELECT job_source, job_id, benchmark_id FROM observations o WHERE benchmark_id IS NOT NULL AND benchmark_id NOT IN "
       "(SELECT benchmark_id FROM benchmarks WHERE fetched_at >= TIMESTAMP '2001-07-01')", ("observations", "benchmarks"))
def _(t):
    kept = t.benchmarks.filter("fetched_at >= TIMESTAMP '2001-07-01'")
    return D.orphans(t.observations, kept, {"benchmark_id": "benchmark_id"}).select(
        "job_source", "job_id", "benchmark_id")


@query("primary_mode_conflicts",
       "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 HAVING count(*) > 1")
def _(t):
    modes = t.table("lineitem").select("l_orderkey", (F.col("l_returnflag") == "A").alias("is_primary"))
    return D.primary_conflicts(modes, ["l_orderkey"], "is_primary")


@query("invalid_benchmarks",
       "SELECT benchmark_id, 'compensation_type' AS violations FROM benchmarks WHERE compensation_type = 'total_compensation'",
       ("benchmarks",))
def _(t):
    odd = t.benchmarks.withColumn("compensation_type", F.when(
        F.col("compensation_type") == "total_compensation", "total").otherwise(F.col("compensation_type")))
    return D.invalid_benchmarks(odd).select("benchmark_id", F.array_join("violations", ",").alias("violations"))


@query("fixture_findings",
       "SELECT 'unknown_category' AS finding, CAST(label AS STRING) AS value, count(*) AS n FROM embeddings WHERE label > 7 "
       "GROUP BY 2 UNION ALL SELECT 'no_prototype', c, 0 FROM (VALUES ('10')) x(c)")
def _(t):
    cases = t.table("embeddings").selectExpr(
        "vec_id AS id", "CAST(label AS STRING) AS category",
        "CASE WHEN vec_id % 2 = 0 THEN 'prototype' ELSE 'evaluation' END AS split")
    return D.fixture_findings(cases, [str(i) for i in range(8)] + ["10"])


# -- merges that touch some buckets only -----------------------------------
def bucketed(t, rows, key):
    table = BucketedTable(t.spark, work_dir(t.spark, "table"), rows.schema, key, 16)
    table.create(rows)
    return table


@query("bucketed_merge", ORACLES["merge_postings"])
def _(t):
    table = bucketed(t, t.postings.select(*MERGE_COLUMNS), ["source", "job_id"])
    table.merge(incoming(t), store.merge_postings)
    return table.read().drop("role_confidence")


@query("bucketed_upsert", ORACLES["upsert_scores"])
def _(t):
    old = t.matches.select("search_id", "source", "job_id", "fit_score")
    key = ["search_id", "source", "job_id"]
    table = bucketed(t, old, key)
    table.merge(old.filter("fit_score >= 90").withColumn("fit_score", F.lit(99.5)), lambda stored, new: store.upsert(stored, new, key))
    return table.read()
