"""Pay enrichment as set operations over all due postings at once.

Posted pay is read from the JSON-LD and the stored text of every due posting; where none
is found, the latest benchmark of the posting's cohort gives an estimate.  The best
evidence is then selected, and each axis of the retry state moves on its own schedule.
Posted pay and estimates never mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantry.functions.keys import observation_id, series_id
from vacantry.functions.titles import titled_rows
from vacantry.operators import retry
from vacantry.operators.extractors import pick_by_country
from vacantry.operators.joins import spread_join
from vacantry.operators.salary import observation_shape, parse_salary
from vacantry.operators.selection import (JOB, OBS_JOB, best_observation, first_per_key,
                                          latest_benchmark)
from vacantry.operators.store import insert_ignore, store_snapshot

OBS_KEY = ["job_source", "job_id", "observation_id"]


@dataclass
class EnrichmentResult:
    new_observations: DataFrame  # rows to append
    snapshots: DataFrame  # benchmark snapshots to append
    selected: DataFrame  # best evidence per due posting
    state: DataFrame  # new enrichment state


def cohort_keys(postings: DataFrame) -> DataFrame:
    """Series ids of each posting from the finest place to the country: (…, level, series_id).

    A benchmark published for a whole region or country serves every posting below it.
    """
    base = titled_rows(postings.select(*JOB, "country_code", F.coalesce("region", F.lit("")).alias("_region"),
                                       F.coalesce("city", F.lit("")).alias("_city"), "title"), "title")
    nothing = F.lit("")
    places = F.array(
        F.struct(F.lit(0).alias("level"), F.col("_region").alias("region"), F.col("_city").alias("city")),
        F.struct(F.lit(1).alias("level"), F.col("_region").alias("region"), nothing.alias("city")),
        F.struct(F.lit(2).alias("level"), nothing.alias("region"), nothing.alias("city")))
    rows = base.withColumn("p", F.explode(F.array_distinct(places)))
    return rows.select(*JOB, "country_code", "normalized_title", "seniority", "p.level", series_id(
        F.col("normalized_title"), F.col("seniority"), F.lit("_any"), F.col("country_code"),
        F.col("p.region"), F.col("p.city"), F.lit("base_salary"), F.lit("year")).alias("series_id"))


def cohort_benchmark(postings: DataFrame, benchmarks: DataFrame, as_of: str) -> DataFrame:
    """Latest fresh benchmark of each posting's cohort, the finest place first; a hot cohort is spread over tasks."""
    latest = latest_benchmark(benchmarks, as_of).filter(~F.col("is_stale")).select(
        "series_id", "benchmark_id", "data_source", "data_source_url", "currency", "period",
        "compensation_type", "amount_min", "amount_max", "amount_median")
    return first_per_key(spread_join(cohort_keys(postings), latest, "series_id"), JOB, F.col("level"),
                         F.col("benchmark_id"))


def estimate_shape(estimates: DataFrame, as_of: str) -> DataFrame:
    """Observation rows from cohort benchmarks; always labelled as estimates."""
    now = F.lit(as_of).cast("timestamp")
    none = F.lit(None).cast("double")
    return estimates.select(
        F.col("source").alias("job_source"), "job_id",
        observation_id(F.col("currency"), F.col("amount_min"), F.col("amount_max"),
                       F.col("amount_median"), F.col("period"), F.col("data_source"),
                       F.col("data_source_url"), F.col("country_code"), F.col("region"),
                       F.col("city")).alias("observation_id"),
        "data_source", "data_source_url", "benchmark_id",
        F.lit("estimated_market").alias("confidence_label"), F.lit("role_location").alias("matched_by"),
        F.lit(False).alias("is_posted"), F.lit(True).alias("is_predicted"), "currency", "amount_min",
        "amount_max", "amount_median", "period", "compensation_type",
        F.col("amount_min").alias("annualized_min"), F.col("amount_max").alias("annualized_max"),
        F.coalesce(F.col("amount_median"), none).alias("annualized_median"), "country_code", "region",
        "city", F.concat(F.lit("benchmark "), F.col("normalized_title")).alias("evidence"),
        now.alias("observed_at"), now.alias("created_at"))


def enrich(postings: DataFrame, observations: DataFrame, benchmarks: DataFrame, state: DataFrame,
           as_of: str, use_benchmarks: bool = True, work: str | None = None,
           fetched: DataFrame | None = None) -> EnrichmentResult:
    """One pass over every due posting.

    ``fetched`` has benchmark rows read in this pass (the columns of ``benchmarks``, with
    series_id, country_code, data_source and payload_hash).  Of several sources for a
    cohort the country's first choice is stored, unless that very payload is there already.
    A posting without posted pay moves its benchmark axis: success with a fresh benchmark
    of its cohort, else not found.  Postings with posted pay leave that axis alone.

    Pay read from text feeds several outputs.  With ``work``, a folder shared by all
    executors, it is written there once and read back, so texts are parsed a single time
    and a lost executor costs no re-parse; without it, each output parses again.

    ``postings`` needs source, job_id, url, title, description_text, country_code, region,
    city, and may have jsonld.  Returns rows to append and the new state.
    """
    due = retry.due_jobs(postings, state, as_of)
    stated = ["jsonld"] if "jsonld" in postings.columns else []
    texts = due.select(*JOB, "url", "title", "description_text", "country_code", "region", "city", *stated)
    facts = texts.drop(*stated)
    pay = parse_salary(texts, "description_text", *stated).drop("description_text", *stated)
    if work is not None:
        schema = pay.schema
        pay.write.mode("errorifexists").parquet(f"{work}/pay")
        pay = pay.sparkSession.read.schema(schema).parquet(f"{work}/pay")
    posted = observation_shape(pay, as_of)
    fresh_posted = insert_ignore(observations.select(*OBS_KEY), posted, OBS_KEY, F.col("amount_min"),
                                 F.col("evidence"))
    known = observations.unionByName(fresh_posted)
    due_keys = facts.select(F.col("source").alias("job_source"), "job_id", "country_code")
    with_posted = known.filter("is_posted").select(*OBS_JOB).distinct()

    new, state_now = fresh_posted, state
    snapshots = benchmarks.limit(0)
    if use_benchmarks:
        if fetched is not None:
            best = pick_by_country(fetched.withColumn("key", F.col("series_id"))).select(*benchmarks.columns)
            snapshots = store_snapshot(benchmarks, best).filter("inserted").select(*benchmarks.columns)
            benchmarks = benchmarks.unionByName(snapshots)
        open_jobs = facts.join(with_posted.select(
            F.col("job_source").alias("source"), "job_id"), JOB, "left_anti")
        cohort = cohort_benchmark(open_jobs, benchmarks, as_of).drop("country_code")
        estimates = estimate_shape(
            cohort.join(open_jobs.select(*JOB, "country_code", "region", "city"), JOB), as_of)
        new = new.unionByName(insert_ignore(observations.select(*OBS_KEY), estimates, OBS_KEY,
                                            F.col("benchmark_id")))
        served = cohort.select(*JOB, F.lit("success").alias("_served"))
        benchmark_outcomes = open_jobs.select(*JOB).distinct().join(served, JOB, "left").select(
            F.col("source").alias("job_source"), "job_id", F.coalesce("_served", F.lit("not_found")).alias("kind"),
            F.when(F.col("_served").isNull(), F.lit("no benchmark for this cohort")).alias("message"))
        state_now = retry.apply_outcomes(state_now, benchmark_outcomes, "benchmark", as_of)
    everything = observations.unionByName(new).join(
        due_keys.withColumnRenamed("country_code", "_country"), OBS_JOB)
    selected = best_observation(everything, country=F.col("_country")).drop("_country")

    found = pay.groupBy(*JOB).agg(F.count_if(F.col("is_posted")).alias("_usable"),
                                  F.count(F.lit(1)).alias("_rows"))
    text = F.lit(None).cast("string")
    outcomes = found.select(
        F.col("source").alias("job_source"), "job_id",
        retry.fetch_event(F.col("_rows"), F.col("_usable"), F.lit(None).cast("int"), text, text).alias("kind"),
        text.alias("message"))
    return EnrichmentResult(new, snapshots, selected, retry.apply_outcomes(state_now, outcomes, "exact", as_of))
