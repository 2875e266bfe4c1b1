"""Category prototypes and similarity classification of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.functions.vectors import cosine, fault, usable

CHUNK_BYTES = 8 << 20


def mean_vectors(vectors: DataFrame, dims: int, category: str = "category",
                 embedding: str = "embedding") -> DataFrame:
    """(category, n, mean): mean of each category's usable vectors of ``dims`` numbers.

    One aggregate with a map-side part; vectors of other lengths, with non-finite numbers
    or of zero norm do not count.
    """
    good = vectors.filter(usable(F.col(embedding), dims))
    sums = [F.avg(F.get(F.col(embedding), F.lit(i)).cast("double")) for i in range(dims)]
    return good.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("mean"))


def _chunk(means: DataFrame, dims: int, chunks: int, k: int) -> Column:
    """The k-th part of the prototypes as one value, its size checked before tasks get it."""
    most = CHUNK_BYTES // (8 * dims + 64)
    part = means.filter(usable(F.col("mean"), dims) & (
        F.pmod(F.xxhash64("category"), F.lit(chunks)) == k))
    listed = F.collect_list(F.struct("category", "eligible", "ordinal", "mean"))
    return part.agg(F.when(F.count(F.lit(1)) <= most, listed).otherwise(F.raise_error(F.lit(
        f"more than {most} prototypes in one of {chunks} chunks; ask for more chunks")))).scalar()


def _best(sims: Column, eligible: bool) -> Column:
    """Largest similarity; of equal ones the prototype declared first."""
    return F.array_max(F.transform(
        F.filter(sims, lambda s: s["sim"].isNotNull() & (s["eligible"] == eligible)),
        lambda s: F.struct(s["sim"].alias("sim"), (-s["ordinal"]).alias("first"), s["category"].alias("category"))))


def classify(vectors: DataFrame, means: DataFrame, threshold: float, margin: float, dims: int,
             chunks: int = 1, embedding: str = "embedding") -> DataFrame:
    """Adds predicted_category, is_eligible, best_eligible, best_other and reason to each vector.

    ``means`` has category, eligible, ordinal (the declared order), mean.  An eligible
    category must reach the threshold and beat the best other one by the margin.
    Prototypes travel as ``chunks`` scalar subqueries of checked size, each read by a narrow
    map that keeps the best so far, so every vector stays one row and nothing is joined.  A vector that cannot
    be compared keeps its row, without a category, and ``reason`` says why (null, empty,
    dimension, not_finite, zero); without prototypes no vector gets a category.
    """
    taken = F.col(embedding)
    best = "struct<sim:double,first:bigint,category:string>"
    rows = vectors.withColumn("_fault", fault(taken, dims)).withColumn(
        "_pos", F.lit(None).cast(best)).withColumn("_neg", F.lit(None).cast(best))
    means = means.select("category", "eligible", F.col("ordinal").cast("bigint").alias("ordinal"), "mean")
    for k in range(chunks):
        sims = F.when(F.col("_fault").isNull(), F.transform("_means", lambda m: F.struct(
            cosine(taken, m["mean"]).alias("sim"), m["category"].alias("category"),
            m["eligible"].alias("eligible"), m["ordinal"].alias("ordinal"))))
        met = rows.withColumn("_means", _chunk(means, dims, chunks, k)).withColumn("_sims", sims)
        rows = met.select(*vectors.columns, "_fault", F.greatest("_pos", _best(F.col("_sims"), True)).alias("_pos"),
                          F.greatest("_neg", _best(F.col("_sims"), False)).alias("_neg"))
    p, n = F.col("_pos.sim"), F.col("_neg.sim")
    ok = F.coalesce((p >= threshold) & (p - F.coalesce(n, F.lit(-1.0)) >= margin), F.lit(False))
    return rows.select(
        *vectors.columns,
        F.when(ok, F.col("_pos.category")).otherwise(
            F.coalesce("_neg.category", "_pos.category")).alias("predicted_category"),
        ok.alias("is_eligible"), p.alias("best_eligible"), n.alias("best_other"), F.col("_fault").alias("reason"))
