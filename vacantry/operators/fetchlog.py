"""Behaviour over ordered fetch logs: breaker, rate budget, paging stop, halts.

A source may hold a third of a log, so nothing here puts a whole source in one window.
Order-dependent results come from time slots: a window inside each (source, slot), one
summary row per slot, a short window over the summaries, and a join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantry import lexicon as lx


def join_back(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys of which any may be NULL; NULL meets NULL."""
    named = side.withColumnsRenamed({k: f"_side_{k}" for k in keys})
    same = [rows[k].eqNullSafe(named[f"_side_{k}"]) for k in keys]
    return rows.join(named, same, how).drop(*[f"_side_{k}" for k in keys])


SLOT_SECONDS = 600


def slot_of(at: str, slot_seconds: int = SLOT_SECONDS) -> Column:
    return F.floor(F.unix_micros(F.col(at)) / F.lit(slot_seconds * 1_000_000)).cast("bigint")


def runs_in_slots(log: DataFrame, group: list[str], at: str, seq: str, hit: Column,
                  slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Adds _slot, _hit, _misses (so far in the slot) and _run (length of the run of hits, in the slot only)."""
    rows = log.select("*", slot_of(at, slot_seconds).alias("_slot"), F.coalesce(hit, F.lit(False)).cast("int").alias("_hit"))
    inside = W.partitionBy(*group, "_slot").orderBy(at, seq).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_misses", F.sum(1 - F.col("_hit")).over(inside))
    streak = W.partitionBy(*group, "_slot", "_misses").orderBy(at, seq).rowsBetween(
        W.unboundedPreceding, 0)
    return rows.withColumn("_run", F.sum("_hit").over(streak))


def runs_across_slots(rows: DataFrame, columns: list[str], group: list[str], at: str, seq: str,
                      threshold: int | None = None, **marks: Column) -> DataFrame:
    """Runs over all slots from rows of ``runs_in_slots``; only one summary row per slot meets others."""
    stamp = F.struct(at, seq)
    heads = range(1, (threshold or 0) + 1)
    slots = rows.groupBy(*group, "_slot").agg(
        F.max("_misses").alias("_m"), F.max_by("_run", stamp).alias("_tail"),
        F.min(F.when(F.col("_run") >= (threshold or 1 << 60), stamp)).alias("_reached"),
        *[F.min(F.when((F.col("_misses") == 0) & (F.col("_run") == i), stamp)).alias(f"_head{i}") for i in heads],
        *[F.min(F.when(test, stamp)).alias(f"_mark_{name}") for name, test in marks.items()])
    order = W.partitionBy(*group).orderBy("_slot")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    slots = slots.withColumn("_broken", F.sum((F.col("_m") > 0).cast("int")).over(so_far))
    open_run = F.sum("_tail").over(W.partitionBy(*group, "_broken").orderBy("_slot").rowsBetween(
        W.unboundedPreceding, 0))
    slots = slots.withColumn("_out", open_run).withColumn(
        "_in", F.coalesce(F.lag("_out").over(order), F.lit(0)))
    kept = [*group, "_slot", "_in"]
    if threshold:
        # a run that came in reaches the threshold at the row it still lacks
        lacking = F.get(F.array(*[F.col(f"_head{i}") for i in heads]), F.greatest(threshold - F.col("_in"), F.lit(1)) - 1)
        slots = slots.withColumn("first_at", F.min(F.least("_reached", lacking)).over(so_far))
        kept.append("first_at")
    for name in marks:
        slots = slots.withColumn(name, F.min(f"_mark_{name}").over(so_far))
    joined = join_back(rows, slots.select(*kept, *marks), [*group, "_slot"])
    run = F.col("_run") + F.when((F.col("_misses") == 0), F.col("_in")).otherwise(F.lit(0))
    return joined.select(*columns, run.cast("bigint").alias("run"), *kept[len(group) + 2:], *marks)


def run_lengths(log: DataFrame, group: list[str], at: str, seq: str, hit: Column,
                slot_seconds: int = SLOT_SECONDS, threshold: int | None = None, **marks: Column) -> DataFrame:
    """Adds ``run``: length of the unbroken run of hits that ends at each row (0 on a miss).

    Rows are ordered by (at, seq) inside ``group``; a NULL in either is a value like any
    other and NULL times come first.  With a ``threshold``, ``first_at`` is the place (at, seq)
    of the first row of the group, up to the row's own slot, whose run reached it; each of
    ``marks`` becomes a column with the first place where it holds.  All of it comes from one
    pass over the slots, so no join is on the group alone.
    """
    rows = runs_in_slots(log, group, at, seq, hit, slot_seconds)
    return runs_across_slots(rows, log.columns, group, at, seq, threshold, **marks)


def breaker(log: DataFrame, strict: bool = False, threshold: int = lx.BREAKER_THRESHOLD,
            max_attempts: int = lx.MAX_KEY_ATTEMPTS, slot_seconds: int = 600) -> DataFrame:
    """Verdict each request would have met: allowed, key_exhausted, circuit_broken or
    source_terminated (strict: after the first restriction anywhere in the source).

    ``log`` has id, source, key, state, at; rows without a source, key or time keep a row.
    """
    blocking = F.col("state").isin(lx.BREAKER_STATES)
    stamp = F.struct("at", "id")
    ended = F.coalesce(F.col("state").isin(lx.RESTRICTION_STATES), F.lit(False))
    rows = run_lengths(log, ["source"], "at", "id", blocking, slot_seconds, threshold=threshold,
                       **({"_ended": ended} if strict else {}))
    # the cap is pushed below the shuffle, so a hot key sends at most max_attempts rows per task
    nth = (
        log.select("source", "key", "at", "id")
        .withColumn("_n", F.row_number().over(W.partitionBy("source", "key").orderBy("at", "id")))
        .filter(F.col("_n") <= max_attempts)
        .groupBy("source", "key")
        .agg(F.max(F.when(F.col("_n") == max_attempts, stamp)).alias("_spent"))
    )
    out = join_back(rows, nth, ["source", "key"], "left")
    terminated = (stamp > F.col("_ended")) if strict else F.lit(False)
    verdict = (
        F.when(terminated, "source_terminated").when(stamp > F.col("first_at"), "circuit_broken")
        .when(stamp > F.col("_spent"), "key_exhausted").otherwise("allowed"))
    return out.select(*log.columns, "run", verdict.alias("verdict"))


def breaker_stats(log: DataFrame, threshold: int = lx.BREAKER_THRESHOLD,
                  slot_seconds: int = 600) -> DataFrame:
    """Per source: requests, run of blocking states still open, whether it ever broke."""
    rows = run_lengths(log, ["source"], "at", "id", F.col("state").isin(lx.BREAKER_STATES), slot_seconds)
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("requests"),
        F.max_by("run", F.struct("at", "id")).alias("open_run"), F.max("run").alias("longest_run"),
        (F.max("run") >= threshold).alias("broken"))


def rate_usage(log: DataFrame, window_seconds: int = lx.RATE_WINDOW_SECONDS,
               budget: int = lx.RATE_MAX_REQUESTS) -> DataFrame:
    """Adds the requests of the source in the window that ends at each request.

    Each row is also read as context by the next window-sized slot, so a window never
    spans more than two slots and no task holds a whole source.  A row without a time is
    in no window: NULL, and never over budget.
    """
    micros = F.unix_micros(F.col("at"))
    span = window_seconds * 1_000_000
    slot = F.floor(micros / F.lit(span))
    rows = log.withColumn("_us", micros).withColumn("_slot", slot).withColumn("_own", F.lit(True))
    context = rows.filter(F.col("_us").isNotNull()).select("source", "_us", (F.col("_slot") + 1).alias("_slot"), F.lit(False).alias("_own"))
    both = rows.unionByName(context, allowMissingColumns=True)
    back = W.partitionBy("source", "_slot").orderBy("_us").rangeBetween(-span, 0)
    return (
        both.withColumn("in_window", F.when(F.col("_us").isNotNull(), F.count(F.lit(1)).over(back))).filter("_own")
        .select(*log.columns, "in_window", F.coalesce(F.col("in_window") > budget, F.lit(False)).alias("over_budget"))
    )


def paging_stop(pages: DataFrame, limit: int = lx.EMPTY_PAGE_STOP, slot_seconds: int = 600) -> DataFrame:
    """Pages a query would have read: it stops after ``limit`` pages in a row without new ids.

    ``pages`` has id, query, new_ids, at.
    """
    rows = run_lengths(pages, ["query"], "at", "id", F.col("new_ids") == 0, slot_seconds, threshold=limit)
    stop = F.col("first_at")
    return rows.filter(stop.isNull() | (F.struct("at", "id") <= stop)).select(*pages.columns, "run")


HALT_SLOT = 4096  # queue places that share one summary row


def halt_on_restriction(queue: DataFrame) -> DataFrame:
    """Adds ``outcome``: rows after a source's first restriction are deferred.

    ``queue`` has source, position, state.
    """
    slot = F.floor(F.col("position") / F.lit(HALT_SLOT))
    rows = queue.withColumn("_slot", slot)
    halts = rows.groupBy("source", "_slot").agg(
        F.min(F.when(F.col("state").isin(lx.RESTRICTION_STATES), F.col("position"))).alias("_halt"))
    so_far = W.partitionBy("source").orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    halts = halts.withColumn("_halt", F.min("_halt").over(so_far))
    at, halt = F.col("position"), F.col("_halt")
    outcome = F.when(at > halt, "deferred").when(at == halt, "restricted").otherwise("done")
    return join_back(rows, halts, ["source", "_slot"]).select(*queue.columns, outcome.alias("outcome"))
