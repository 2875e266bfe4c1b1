"""Data-contract checks: jobs that return the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vacantry import lexicon as lx
from vacantry.functions.text import is_blank


def _failed(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks; an unknown test counts as broken."""
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", _failed(rules)).filter(F.size("violations") > 0)


def missing_columns(df: DataFrame, required: StructType) -> list[str]:
    """Required columns a table lacks or holds with another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f.name for f in required.fields if have.get(f.name) != f.dataType]


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def observation_rules() -> dict[str, Column]:
    """Posted and estimated pay never mix: see each rule."""
    posted, predicted = F.col("is_posted"), F.col("is_predicted")
    label, benchmark = F.col("confidence_label"), F.col("benchmark_id")
    amounts = F.coalesce("amount_min", "amount_max", "amount_median")
    return {
        "job": ~is_blank(F.col("job_source")) & ~is_blank(F.col("job_id")),
        "data_source": ~is_blank(F.col("data_source")),
        "currency": F.length("currency") == 3,
        "period": F.col("period").isin(list(lx.PERIOD_FACTORS)),
        "compensation_type": F.col("compensation_type").isin(lx.COMPENSATION_TYPES),
        "confidence_label": label.isin(lx.EXACT_LABELS + lx.ESTIMATE_LABELS),
        "matched_by": F.col("matched_by").isin(lx.MATCHED_BY),
        "amount": amounts.isNotNull() & ~F.isnan(amounts),
        "exact": ~posted | (benchmark.isNull() & label.isin(lx.EXACT_LABELS)),
        "estimate": posted | (~is_blank(benchmark) & label.isin(lx.ESTIMATE_LABELS)),
        "predicted": ~predicted | (~posted & ~is_blank(benchmark)),
    }


def invalid_observations(obs: DataFrame) -> DataFrame:
    return violations(obs, observation_rules())


def invalid_classifications(postings: DataFrame) -> DataFrame:
    return violations(postings, {
        "label": F.col("role_label").isin(lx.ROLE_LABELS),
        "confidence": F.col("role_confidence").between(0, 1),
        "summary": ~is_blank(F.col("role_reason.summary")),
        "lists": F.col("role_reason.evidence").isNotNull() & F.col("role_reason.gaps").isNotNull(),
    })


def invalid_scores(matches: DataFrame) -> DataFrame:
    return violations(matches, {
        "fit_score": F.col("fit_score").between(0, 100),
        "must_counts": (F.col("must_matched") >= 0) & (F.col("must_matched") <= F.col("must_total")),
        "nice_counts": (F.col("nice_matched") >= 0) & (F.col("nice_matched") <= F.col("nice_total")),
        "cta": F.col("cta").isin("Apply", "Maybe", "Skip"),
    })


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows whose (non-NULL) key has no parent; ``keys`` maps child to parent columns."""
    target = parent.select(*[F.col(p).alias(f"_p_{c}") for c, p in keys.items()]).distinct()
    present = child
    for c in keys:
        present = present.filter(F.col(c).isNotNull())
    return present.join(target, [F.col(c) == F.col(f"_p_{c}") for c in keys], "left_anti")


def primary_conflicts(child: DataFrame, key: list[str], flag: str) -> DataFrame:
    """Keys with more than one row flagged primary / default."""
    return child.filter(F.col(flag)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def invalid_benchmarks(benchmarks: DataFrame) -> DataFrame:
    return violations(benchmarks, {
        "normalized_title": ~is_blank(F.col("normalized_title")),
        "country_code": F.length("country_code") == 2,
        "currency": F.col("currency").isNull() | (F.length("currency") == 3),
        "period": F.col("period").isin(list(lx.PERIOD_FACTORS)),
        "compensation_type": F.col("compensation_type").isin(lx.COMPENSATION_TYPES),
        "payload": F.col("payload").isNotNull(),
        "fetched_at": F.col("fetched_at").isNotNull(),
    })


def fixture_findings(cases: DataFrame, categories: list[str]) -> DataFrame:
    """Problems of a labelled set: (finding, value, n) rows; none means it is usable."""
    known = F.col("category").isin(categories)
    per_id = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("id").isNull())
    bad = cases.select(F.explode(F.array_compact(F.array(
        F.when(~F.coalesce(known, F.lit(False)), F.struct(
            F.lit("unknown_category").alias("finding"), F.col("category").cast("string").alias("value"))),
        F.when(~F.coalesce(F.col("split").isin("prototype", "evaluation"), F.lit(False)), F.struct(
            F.lit("invalid_split").alias("finding"), F.col("split").alias("value")))))).alias("f"))
    listed = cases.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    bare = listed.join(cases.filter(F.col("split") == "prototype").select("category").distinct(),
                       "category", "left_anti")
    return (
        per_id.select(F.lit("duplicate_id").alias("finding"), F.col("id").cast("string").alias("value"), "n")
        .unionByName(bad.groupBy("f.finding", "f.value").agg(F.count(F.lit(1)).alias("n")))
        .unionByName(bare.select(F.lit("no_prototype").alias("finding"),
                                 F.col("category").alias("value"), F.lit(0).cast("bigint").alias("n")))
    )


def rules_conflicts(rules: DataFrame) -> DataFrame:
    """(section, word): words that a rule table drops although they tell the seniority; must be empty.

    ``rules`` has section, word: every word of the tables ``stopwords``, ``filler_adjectives`` and ``seniority_table``.
    A word that both dropping tables hold is listed for each.
    """
    words = rules.select("section", F.lower("word").alias("word")).distinct()
    told = words.filter("section = 'seniority_table'").select("word")
    return words.filter(F.col("section").isin("stopwords", "filler_adjectives")).join(told, "word", "left_semi").select("section", "word")


def rule_words(spark: SparkSession) -> DataFrame:
    """(section, word) of the rule tables in use."""
    rows = [("stopwords", w) for w in lx.TITLE_STOPWORDS] + [("filler_adjectives", w) for w in lx.TITLE_FILLERS]
    rows += [("seniority_table", w) for _, words in lx.SENIORITY_TABLE for w in words]
    return spark.createDataFrame(rows, "section string, word string")
