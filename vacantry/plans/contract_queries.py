"""Queries: readers and sinks, envelopes, fingerprints, contract checks and backfill merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.keys import fingerprint
from vacantry.operators import backfill, postings, quality
from vacantry.operators import selection as S
from vacantry.plans.registry import query
from vacantry.session import work_dir
from vacantry.sources import tables


@query("raw_postings",
       "SELECT job_id, title, company, required, nice FROM (SELECT job_id, title, company, CASE WHEN posting_key % 2 = 0 THEN 'English' END AS required, "
       "CASE WHEN posting_key % 3 = 0 THEN 'Danish' END AS nice FROM postings) p", ("postings",))
def _(t):
    raw = t.postings.select(
        F.col("job_id").alias("url"), "title", "company",
        F.struct(F.when(F.col("posting_key") % 2 == 0, "English").alias("required"),
                 F.when(F.col("posting_key") % 3 == 0, "Danish").alias("niceToHave")).alias("languageRequirements"))
    path = work_dir(t.spark, "raw")
    tables.write_ndjson(raw, path)
    return tables.read_postings(t.spark, path, lines=True).select(
        F.col("url").alias("job_id"), "title", "company", F.col("requiredLanguages").alias("required"),
        F.col("niceToHaveLanguages").alias("nice"))


@query("run_files", "SELECT count(*) AS discovered, sum(posting_key) AS keys, count(*) AS stated FROM postings", ("postings",))
def _(t):
    path = work_dir(t.spark, "run")
    found = t.postings.select("source", "job_id", "posting_key")
    tables.write_run(found, found.agg(F.count(F.lit(1)).alias("stated")), path)
    rows = t.spark.read.schema(found.schema).json(f"{path}/discovered").agg(
        F.count(F.lit(1)).alias("discovered"), F.sum("posting_key").alias("keys"))
    stated = t.spark.read.schema("stated bigint").json(f"{path}/summary")
    return rows.unionByName(stated, allowMissingColumns=True).agg(
        F.max("discovered").alias("discovered"), F.max("keys").alias("keys"), F.max("stated").alias("stated"))


@query("report_envelopes",
       "SELECT source, job_id, title, company, url, country_code AS country, city, role_label AS label, role_confidence AS confidence, language_reason AS reason FROM postings",
       ("postings",))
def _(t):
    rows = postings.compact(t.postings)
    return rows.select("source", "job_id", "title", "company", "url", F.col("details.country_code").alias("country"),
                       F.col("details.city").alias("city"), F.col("details.role_label").alias("label"),
                       F.col("details.role_confidence").alias("confidence"), F.col("details.language_reason").alias("reason"))


@query("profile_fingerprints",
       "SELECT c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}') AS fingerprint FROM customer")
def _(t):
    return t.table("customer").select("c_custkey", fingerprint(F.col("c_custkey"), F.col("c_mktsegment")).alias("fingerprint"))


_known = ", ".join(f"'{x}'" for x in lx.ROLE_LABELS)


@query("invalid_classifications",
       "SELECT job_id, source, concat_ws(',', CASE WHEN label_ok THEN NULL ELSE 'label' END, CASE WHEN reason_ok THEN NULL ELSE 'summary' END, CASE WHEN reason_ok THEN NULL ELSE 'lists' END) AS violations "
       f"FROM (SELECT job_id, source, coalesce(role_label IN ({_known}), false) AS label_ok, coalesce(role_reason LIKE '{{%', false) AS reason_ok FROM postings) p WHERE NOT (label_ok AND reason_ok)",
       ("postings",))
def _(t):
    parsed = F.from_json("role_reason", "summary string, evidence array<string>, gaps array<string>")
    rows = t.postings.withColumn("role_reason", parsed)
    return quality.invalid_classifications(rows).select("job_id", "source", F.array_join("violations", ",").alias("violations"))


@query("table_contract", "SELECT 'posted_at' AS missing, count(*) AS n FROM postings UNION ALL SELECT 'role_confidence', count(*) FROM postings", ("postings",))
def _(t):
    required = t.spark.createDataFrame([], "job_id string, role_confidence string, posted_at timestamp").schema
    names = quality.missing_columns(t.postings, required)
    return t.postings.select(F.explode(F.array(*map(F.lit, names))).alias("missing")).groupBy("missing").agg(
        F.count(F.lit(1)).alias("n"))


@query("observation_by_key",
       "SELECT job_source, job_id, observation_id, data_source FROM observations WHERE (job_source, job_id, observation_id) = (SELECT (min(k).s, min(k).j, min(k).o) FROM "
       "(SELECT {'s': job_source, 'j': job_id, 'o': observation_id} AS k FROM observations) x)",
       ("observations",))
def _(t):
    key = t.observations.agg(F.min(F.struct("job_source", "job_id", "observation_id")).alias("k")).first()["k"]
    return S.find_observation(t.observations, *key).select("job_source", "job_id", "observation_id", "data_source")


@query("applied_backfill",
       "SELECT job_id, CASE posting_key % 3 WHEN 0 THEN 'Found ' || posting_key ELSE title END AS title, CASE WHEN posting_key % 3 = 2 THEN description_text WHEN posting_key % 3 = 0 THEN 'Last text' ELSE description_text END AS description_text, "
       "CASE posting_key % 3 WHEN 0 THEN NULL WHEN 1 THEN 'too short' ELSE language_reason END AS reason FROM postings", ("postings",))
def _(t):
    known = t.postings.filter("posting_key % 3 < 2")
    kept = F.col("posting_key") % 3 == 0

    def found(ordinal, words):  # two findings per posting, the second counts
        return known.select(
            "source", "job_id", F.when(kept, F.concat(F.lit(f"{words} "), "posting_key")).alias("new_title"),
            F.lit(None).cast("string").alias("new_company"),
            F.when(kept, F.lit("Last text" if ordinal else "First text")).alias("description_text"),
            kept.alias("ok"), F.when(~kept, F.lit("too short" if ordinal else "gone")).alias("failure"), F.lit(ordinal).alias("ordinal"))

    both = found(1, "Found").unionByName(found(0, "Lost"))
    return backfill.apply_backfill(t.postings, both, F.col("ordinal")).select(
        "job_id", "title", "description_text", F.col("language_reason").alias("reason"))


@query("upserted_twice",
       "SELECT job_id, source, CASE WHEN posting_key % 2 = 0 THEN 2 ELSE 0 END AS version FROM postings", ("postings",))
def _(t):
    from vacantry.operators.store import upsert

    old = t.postings.select("source", "job_id", F.lit(0).alias("version"))
    even = t.postings.filter("posting_key % 2 = 0")
    new = even.select("source", "job_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("version"))
    return upsert(old, new, ["source", "job_id"], F.col("version"))
