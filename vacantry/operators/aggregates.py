"""Counts, coverage, source health, audits and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.clock import as_timestamp
from vacantry.functions.fields import role_label
from vacantry.functions.text import is_blank
from vacantry.operators.selection import JOB, OBS_JOB, SUBMITTED, rank_in

def n_rows() -> Column:
    return F.count(F.lit(1))


def jobs_by_source(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source").agg(
        n_rows().alias("n"), F.count_if(is_blank(F.col("description_text"))).alias("missing_description"))


def description_coverage(postings: DataFrame) -> DataFrame:
    """Per stored role label: postings with a full description and without."""
    blank = is_blank(F.col("description_text"))
    return postings.groupBy("role_label").agg(
        n_rows().alias("n"), F.count_if(~blank).alias("full_jd"), F.count_if(blank).alias("provisional"))


def role_counts(postings: DataFrame) -> DataFrame:
    """Counts per canonical role label, re-aggregated from raw labels.

    The distinct raw spellings are counted here and listed by ``role_label_breakdown``,
    because stray labels are unbounded.
    """
    raw = description_coverage(postings)
    return (
        raw.groupBy(role_label(F.col("role_label")).alias("label"))
        .agg(F.sum("n").alias("n"), F.sum("full_jd").alias("full_jd"),
             F.sum("provisional").alias("provisional"),
             F.count_if(~is_blank(F.col("role_label"))).alias("raw_labels"))
        .orderBy(F.desc("n"), "label")
    )


def role_label_breakdown(postings: DataFrame) -> DataFrame:
    return postings.groupBy(
        role_label(F.col("role_label")).alias("label"),
        F.trim(F.coalesce("role_label", F.lit(""))).alias("raw_label")).agg(n_rows().alias("n"))


def salary_coverage(postings: DataFrame, obs: DataFrame) -> DataFrame:
    """Share of postings with any pay evidence, counted on the full key."""
    covered = obs.select(*OBS_JOB).distinct().agg(n_rows().alias("covered"))
    total = postings.agg(n_rows().alias("total"))
    both = covered.select("covered", F.lit(0).alias("total")).unionByName(
        total.select(F.lit(0).alias("covered"), "total"))
    return both.agg(F.sum("covered").alias("covered"), F.sum("total").alias("total")).select(
        "covered", "total",
        F.when(F.col("total") > 0, F.floor(100 * F.col("covered") / F.col("total") + 0.5).cast("bigint"))
        .alias("pct"))


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(n_rows().alias("n")).orderBy(F.desc("n"), "status")


def hit_rates(obs: DataFrame, as_of: str, days: int = 30, source: str = "job_source") -> DataFrame:
    """Observations and posted hits per source for the last full days and those before.

    One scan; the as-of day itself is left out of both windows and the outer bound is a
    plain predicate on the stored column.
    """
    today = F.date_trunc("day", as_timestamp(as_of))
    start, prior = today - F.make_dt_interval(F.lit(days)), today - F.make_dt_interval(F.lit(2 * days))
    seen = F.col("observed_at")
    recent = seen >= start
    posted = F.col("is_posted")
    return obs.filter((seen >= prior) & (seen < today)).groupBy(F.col(source).alias("source")).agg(
        F.count_if(recent).alias("total_current"), F.count_if(recent & posted).alias("hits_current"),
        F.count_if(~recent).alias("total_prior"), F.count_if(~recent & posted).alias("hits_prior"))


def source_health(rates: DataFrame, known_sources: list[str]) -> DataFrame:
    """Health of every source seen or known; warning means hits fell by over a fifth."""
    spark = rates.sparkSession
    known = spark.createDataFrame([(s,) for s in known_sources], "source string")
    full = known.join(rates, "source", "full_outer").fillna(
        0, ["total_current", "hits_current", "total_prior", "hits_prior"])
    tc, hc, tp, hp = [F.col(c).cast("bigint") for c in
                      ("total_current", "hits_current", "total_prior", "hits_prior")]
    dropped = hc * tp * 10 < hp * tc * 8
    measured = (tc > 0) & (tp > 0)
    now, before = F.try_divide(hc, tc), F.when(tc > 0, F.try_divide(hp, tp))
    return full.select(
        "source", tc.alias("total_current"), now.alias("rate_current"), before.alias("rate_prior"),
        F.when(measured & (hp > 0), (now - before) / before * 100).alias("delta_pct"),
        (measured & dropped).alias("warning"),
        F.when(tc == 0, "no_data").when(tp == 0, "insufficient_baseline")
        .when(dropped, "warning").otherwise("ok").alias("state"))


def classification_audit(postings: DataFrame) -> DataFrame:
    """One row of counts by taxonomy version and label validity."""
    label = F.trim(F.coalesce("role_label", F.lit("")))
    version = F.trim(F.coalesce("taxonomy_version", F.lit("")))
    groups = postings.groupBy(label.alias("label"), version.alias("version")).agg(n_rows().alias("n"))
    named = F.col("label") != ""

    def total(test):
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    v = F.col("version")
    return groups.agg(
        total(F.lit(True)).alias("total"), total(named).alias("classified"),
        total(named & (v == lx.TAXONOMY_VERSION)).alias("current_version"),
        total(named & (v == "")).alias("unversioned"),
        total(named & (v != "") & (v != lx.TAXONOMY_VERSION)).alias("stale_version"),
        total(named & ~F.col("label").isin(lx.ROLE_LABELS)).alias("unknown_label"))


def audit_breakdown(postings: DataFrame) -> DataFrame:
    """Long form of the audit: unknown labels and stale versions with their counts."""
    label = F.trim(F.coalesce("role_label", F.lit("")))
    version = F.trim(F.coalesce("taxonomy_version", F.lit("")))
    groups = postings.groupBy(label.alias("label"), version.alias("version")).agg(
        n_rows().alias("n")).filter(F.col("label") != "")
    findings = F.array_compact(F.array(
        F.when(~F.col("label").isin(lx.ROLE_LABELS),
               F.struct(F.lit("unknown_label").alias("finding"), F.col("label").alias("value"))),
        F.when((F.col("version") != "") & (F.col("version") != lx.TAXONOMY_VERSION),
               F.struct(F.lit("stale_version").alias("finding"), F.col("version").alias("value")))))
    return (groups.select(F.explode(findings).alias("f"), "n")
            .groupBy("f.finding", "f.value").agg(F.sum("n").alias("n")))


def enrichment_summary(results: DataFrame, eligible: int) -> DataFrame:
    """One row for a batch with exact_status and exit_code columns."""
    status, code = F.col("exact_status"), F.col("exit_code")
    return results.agg(
        n_rows().alias("total"), F.count_if(status == "found").alias("found"),
        F.count_if(status == "not_found").alias("not_found"),
        F.count_if((status == "error") & ~code.isin(5, 6, 7)).alias("error"),
        F.count_if(code == 5).alias("unrecoverable"), F.count_if(code == 6).alias("transient_exhausted"),
        F.count_if(code == 7).alias("pipeline_exception"),
    ).withColumn("more_eligible", F.greatest(F.lit(eligible) - F.col("total"), F.lit(0)))


def worst_exit_code(results: DataFrame) -> DataFrame:
    """Worst outcome of a batch: 5, then 7, then 6, else 0."""
    code = F.col("exit_code")
    weight = F.when(code == 5, 3).when(code == 7, 2).when(code == 6, 1).otherwise(0)
    worst = F.max(weight)
    return results.agg(F.when(worst == 3, 5).when(worst == 2, 7).when(worst == 1, 6).otherwise(0)
                       .cast("bigint").alias("exit_code"))


def search_summary(records: DataFrame) -> DataFrame:
    """One row for scraped records with role_passed, language_passed, has_description,
    persisted and refresh flags."""
    role, lang = F.col("role_passed"), F.col("language_passed")
    described, refresh = F.col("has_description"), F.col("is_refresh")
    return records.agg(
        n_rows().alias("scraped"), F.count_if(role).alias("role_matches"),
        F.count_if(role & lang).alias("included"), F.count_if(role & ~lang).alias("language_skipped"),
        F.count_if(~role).alias("role_skipped"), F.count_if(described).alias("described"),
        F.count_if(~described).alias("failed"), F.count_if(F.col("persisted")).alias("persisted"),
        F.count_if(refresh).alias("refresh_found"), F.count_if(refresh & described).alias("refreshed"))


def query_stats(ids: DataFrame, existing: DataFrame, admitted: DataFrame) -> DataFrame:
    """Per query: listed, new and admitted ids, and why it stopped.

    ``ids`` has query, job_id; each id counts once per query and as new for the query
    that admitted it.
    """
    listed = ids.select("query", "job_id").distinct()
    known = existing.select("job_id").distinct().withColumn("_known", F.lit(True))
    taken = admitted.select("query", "job_id").distinct().withColumn("_taken", F.lit(True))
    return (
        listed.join(known, "job_id", "left").join(taken, ["query", "job_id"], "left")
        .groupBy("query")
        .agg(n_rows().alias("ids_total"), F.count_if(F.col("_known").isNull()).alias("ids_unseen"),
             F.count_if(F.col("_taken").isNotNull()).alias("ids_admitted"))
        .withColumn("status", F.when(F.col("ids_unseen") == 0, "no_new_ids")
                    .when(F.col("ids_admitted") == 0, "detail_limit_reached").otherwise("persisted"))
    )


def run_snapshot(postings: DataFrame, matches: DataFrame, run_start: str) -> DataFrame:
    """Per source, since a run started: new, described and unscored postings."""
    fresh = postings.filter(F.col("created_at") >= F.lit(run_start).cast("timestamp"))
    scored = matches.select(*JOB).distinct().withColumn("_scored", F.lit(True))
    described = ~is_blank(F.col("description_text"))
    return fresh.join(scored, JOB, "left").groupBy("source").agg(
        n_rows().alias("new_jobs"), F.count_if(described).alias("with_description"),
        F.count_if(described & (F.col("application_status") == "saved") & F.col("_scored").isNull())
        .alias("unscored"))


def fresh_apply_queue(postings: DataFrame, matches: DataFrame, as_of: str, threshold: float,
                      days: int = 14) -> DataFrame:
    """Saved postings of the last days with an Apply / Maybe score, per source."""
    since = as_timestamp(as_of) - F.make_dt_interval(F.lit(days))
    saved = postings.filter((F.col("application_status") == "saved") & (F.col("created_at") > since))
    good = matches.filter((F.col("fit_score") >= threshold) & F.col("cta").isin("Apply", "Maybe"))
    return saved.select(*JOB).join(good.select(*JOB), JOB).groupBy("source").agg(n_rows().alias("n"))


def cohort_medians(obs: DataFrame) -> DataFrame:
    """Estimated-market medians by place and currency."""
    return obs.filter(F.col("confidence_label") == "estimated_market").groupBy(
        "country_code", "city", "currency").agg(
        n_rows().alias("n"), F.min("annualized_median").alias("min_median"),
        F.max("annualized_median").alias("max_median"))


def latest_cohort_benchmarks(latest: DataFrame) -> DataFrame:
    """Market medians by normalized title and country from latest snapshots."""
    return latest.groupBy("normalized_title", "country_code", "currency").agg(
        n_rows().alias("n"), F.min("amount_median").alias("min_median"),
        F.max("amount_median").alias("max_median"))


def discovery_summary(discovered: DataFrame, existing: DataFrame, backfilled: DataFrame) -> DataFrame:
    """One row: discovered, inserted, existing, backfilled, failed.

    ``discovered`` and ``existing`` have source, job_id; ``backfilled`` has ok.
    """
    keys = discovered.select(*JOB).distinct()
    new = keys.join(existing.select(*JOB), JOB, "left_anti")

    def tally(df, name, test=None):
        return df.agg((n_rows() if test is None else F.count_if(test)).alias("n")).select(
            F.lit(name).alias("measure"), "n")

    parts = (tally(keys, "discovered").unionByName(tally(new, "inserted"))
             .unionByName(tally(backfilled, "backfilled", F.col("ok")))
             .unionByName(tally(backfilled, "failed", ~F.col("ok"))))

    def of(name):
        return F.sum(F.when(F.col("measure") == name, F.col("n")).otherwise(0))

    return parts.agg(of("discovered").alias("discovered"), of("inserted").alias("inserted"),
                     (of("discovered") - of("inserted")).alias("existing"),
                     of("backfilled").alias("backfilled"), of("failed").alias("failed"))


def keywords_by_id(ids: DataFrame) -> DataFrame:
    """Queries that found each id, in query order, joined with "; ".

    The distinct pass first bounds each list by the number of queries in a plan.
    """
    pairs = ids.groupBy("job_id", "query").agg(F.min("query_order").alias("query_order"))
    listed = F.array_sort(F.collect_list(F.struct("query_order", "query")))
    return pairs.groupBy("job_id").agg(
        F.array_join(F.transform(listed, lambda x: x["query"]), "; ").alias("keywords"))


def exact_median(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Exact median per key, safe for a key that holds most rows.

    Values are counted once; counts per value band (``width`` wide) locate the band that
    holds the middle rank, and only that band's distinct values are then ranked.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n_rows().alias("_n"))
    return _counted_median(counted, keys, value, width)


def _counted_median(counted: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Samples and median from counted values; a group without any value has 0 samples and no median."""
    values = counted.withColumn("_band", F.floor(F.col(value) / width)).withColumn(
        "_n", F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0))
    bands = values.groupBy(*keys, "_band").agg(F.sum("_n").alias("_n"))
    over = W.partitionBy(*keys)
    ranked = (
        bands.withColumn("_upto", F.sum("_n").over(over.orderBy("_band")))
        .withColumn("_total", F.sum("_n").over(over))
        .withColumn("_r1", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_r2", F.ceil((F.col("_total") + 1) / 2))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .filter((F.col("_before") < F.col("_r2")) & (F.col("_upto") >= F.col("_r1")) & F.col("_band").isNotNull()
                | (F.col("_total") == 0))
    )
    mid = ranked.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_band").alias("_k__band"),
                        "_before", "_total", "_r1", "_r2")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_band"]]
    inside = values.join(mid, same)
    upto = F.sum("_n").over(W.partitionBy(*keys, "_band").orderBy(value)) + F.col("_before")
    placed = inside.withColumn("_upto", upto)

    def holds(r):
        return (F.col("_upto") - F.col("_n") < F.col(r)) & (F.col("_upto") >= F.col(r))

    return placed.groupBy(*keys).agg(
        F.max("_total").alias("samples"),
        ((F.max(F.when(holds("_r1"), F.col(value))) + F.max(F.when(holds("_r2"), F.col(value)))) / 2)
        .alias("median"))


def posted_pay_summary(obs: DataFrame, postings: DataFrame, by: str = "company") -> DataFrame:
    """Median of posted-range midpoints of comparable pay, with the sample size.

    Comparable means same currency, period, compensation type and country; groups
    without posted pay stay, with no samples.  Rows come in no order; ``ranks.with_position``
    gives one.
    """
    posted = obs.filter(F.col("is_posted")).select(
        F.col("job_source").alias("source"), "job_id", "currency", "period", "compensation_type",
        ((F.col("amount_min") + F.col("amount_max")) / 2).alias("mid"))
    keys = [by, "country_code", "currency", "period", "compensation_type"]
    joined = postings.select(*JOB, by, "country_code").join(posted, JOB, "left")
    counted = joined.groupBy(*keys, "mid").agg(n_rows().alias("_n"))
    return _counted_median(counted, keys, "mid", 1000.0).withColumnRenamed("median", "median_mid")


def sponsor_status(employers: DataFrame, register: DataFrame, route: str = "Skilled Worker") -> DataFrame:
    """Sponsor-register match by normalized legal name.

    confirmed needs exactly one register entry on the route; several are ambiguous.
    """
    def legal(c):
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))

    entries = register.filter(F.col("route") == route).groupBy(legal(F.col("name")).alias("_key")).agg(
        F.countDistinct("name", "town").alias("entries"))
    return (
        employers.withColumn("_key", legal(F.col("employer"))).join(entries, "_key", "left").drop("_key")
        .withColumn("entries", F.coalesce("entries", F.lit(0)))
        .withColumn("employer_status", F.when(is_blank(F.col("employer")), "unknown")
                    .when(F.col("entries") == 1, "confirmed_skilled_worker")
                    .when(F.col("entries") > 1, "ambiguous").otherwise("no_confirmed_match")))


def run_status(log: DataFrame) -> DataFrame:
    """Overall status per run from its page states.

    The first failure state in page order wins, else empty / healthy, login, transient,
    failed.  ``log`` has run, position, state.
    """
    state = F.col("state")
    failure = state.isin(lx.RUN_FAILURE_STATES)
    return log.groupBy("run").agg(
        F.min_by(F.when(failure, state), F.when(failure, F.col("position"))).alias("_fail"),
        F.every(state.isin("healthy", "empty")).alias("_clean"),
        F.some(state == "empty").alias("_empty"), F.some(state == "login_required").alias("_login"),
        F.some(state == "transient_error").alias("_transient"), n_rows().alias("pages"),
    ).select("run", "pages", F.coalesce(
        F.col("_fail"),
        F.when(F.col("_clean"), F.when(F.col("_empty"), F.lit("empty")).otherwise(F.lit("healthy")))
        .when(F.col("_login"), F.lit("login_required"))
        .when(F.col("_transient"), F.lit("transient_error")).otherwise(F.lit("failed"))).alias("status"))


def confusion(evaluated: DataFrame) -> DataFrame:
    """One row from expected, predicted, rule_predicted and unknown_title flags."""
    e, p = F.col("expected"), F.col("predicted")
    unknown = F.col("unknown_title")
    return evaluated.agg(
        F.count_if(e & p).alias("true_positive"), F.count_if(~e & ~p).alias("true_negative"),
        F.count_if(~e & p).alias("false_positive"), F.count_if(e & ~p).alias("false_negative"),
        F.count_if(unknown & e).alias("unknown_total"),
        F.count_if(unknown & e & p).alias("unknown_recovered"),
        F.count_if(p != F.col("rule_predicted")).alias("disagreements"))
