"""Streaming twins of the stateful batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vacantry import lexicon as lx
from vacantry.operators.fetchlog import SLOT_SECONDS, join_back, runs_across_slots, runs_in_slots, slot_of
from vacantry.operators.retry import next_state
from vacantry.operators.selection import OBS_JOB
from vacantry.operators.selection import newest as newest_first
from vacantry.streaming.deltas import EVERY, DeltaTable, newest, newest_group, totals
from vacantry.streaming.runner import batch_writer, read_batches, run_available


def latest_stage(events: DataFrame) -> DataFrame:
    """Update-mode stream of the latest stage per job; one state row per job."""
    rest = [c for c in events.columns if c not in OBS_JOB]
    order = F.struct(newest_first(F.col("occurred_at")), -F.col("id"))
    return events.groupBy(*OBS_JOB).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*OBS_JOB, "_r.*")


def retry_state(outcomes: DataFrame, axis: str) -> DataFrame:
    """Update-mode stream of the retry state per job on one axis.

    The schedule needs only how many outcomes a job has had and the latest one, so the
    state is two aggregates.  ``outcomes`` has id, job_source, job_id, kind, message, at.
    """
    last = F.max_by(F.struct("kind", "message", "at"), F.struct("at", "id"))
    folded = outcomes.groupBy(*OBS_JOB).agg(F.count(F.lit(1)).alias("_n"), last.alias("_last"))
    state = next_state(axis, F.col("_n") - 1, F.col("_last.kind"), F.col("_last.message"), F.col("_last.at"))
    return folded.select(*OBS_JOB, state.alias("_s")).select(*OBS_JOB, "_s.*")


def keep_current(stream: DataFrame, keys: list[str], work: str, every: int = EVERY) -> DataFrame:
    """Runs an update-mode stream to the end of its input and returns the current table.

    The table is a base and at most ``every`` changes, however many batches have run.
    """
    def table(session: SparkSession) -> DeltaTable:
        return DeltaTable(session, f"{work}/rows", stream.schema, newest(keys), every)

    run_available(stream, f"{work}/checkpoint", lambda df, batch: table(df.sparkSession).put(df, batch))
    return table(stream.sparkSession).current()


def rate_windows(log: DataFrame, work: str, late_seconds: int | None = None, window_seconds: int = lx.RATE_WINDOW_SECONDS,
                 slide_seconds: int = 5, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """Requests per source in sliding windows, and the rows that are in no window.

    Kept are one count per source and slot of ``slide_seconds``, and each source's newest time.  A row more than
    ``late_seconds`` behind its source's newest row of earlier batches (``too_late``), or without a time (``no_time``),
    is not counted but listed with its ``reason``, so every row is in one of the two results.  Without
    ``late_seconds`` no row is too late and the counts do not depend on the order in which files arrive.  A replayed
    batch reads what the batches before it wrote and leaves the same rows.
    """
    if window_seconds % slide_seconds:
        raise ValueError("the window is a whole number of slides")
    counted = StructType.fromDDL("source string, slot bigint, requests bigint")
    seen = StructType.fromDDL("source string, newest timestamp")
    missed = log.select("*", F.lit("").alias("reason")).schema

    def tables(session: SparkSession) -> tuple[DeltaTable, DeltaTable, DeltaTable]:
        return (DeltaTable(session, f"{work}/slots", counted, totals(["source", "slot"], requests=F.sum("requests")), every),
                DeltaTable(session, f"{work}/newest", seen, totals(["source"], newest=F.max("newest")), every),
                DeltaTable(session, f"{work}/late", missed, lambda rows: rows, every))

    def on_batch(df: DataFrame, batch: int) -> None:
        slots, newest_at, late = tables(df.sparkSession)
        reason = F.when(F.col("at").isNull(), "no_time")
        if late_seconds is None:
            rows = df.withColumn("reason", reason)
        else:
            behind = F.col("at") < F.col("newest") - F.make_dt_interval(secs=F.lit(late_seconds))
            rows = join_back(df, newest_at.current(before=batch), ["source"], "left").select(
                *df.columns, reason.when(behind, "too_late").alias("reason"))
        slot = F.floor(F.unix_micros("at") / F.lit(slide_seconds * 1_000_000)).cast("bigint").alias("slot")
        good = rows.filter("reason IS NULL")
        slots.put(good.groupBy("source", slot).agg(F.count(F.lit(1)).alias("requests")), batch)
        late.put(rows.filter("reason IS NOT NULL"), batch)
        newest_at.put(df.groupBy("source").agg(F.max("at").alias("newest")), batch)

    run_available(log, f"{work}/checkpoint", on_batch, mode="append")
    slots, _, late = tables(log.sparkSession)
    back = window_seconds // slide_seconds
    first = F.explode(F.sequence(F.col("slot") - (back - 1), F.col("slot"))).alias("first")
    windows = slots.current().select("source", first, "requests").groupBy("source", "first").agg(
        F.sum("requests").alias("requests"))
    start = F.col("first") * slide_seconds
    return windows.select("source", F.timestamp_seconds(start).alias("start"),
                          F.timestamp_seconds(start + window_seconds).alias("end"), "requests"), late.current()


def runs(log: DataFrame, work: str, group: list[str], hit: Column, threshold: int, slot_seconds: int = SLOT_SECONDS,
         every: int = EVERY, buckets: int = 32) -> DataFrame:
    """Rows with ``run`` and ``first_at`` as ``run_lengths`` gives them, kept up to date by micro-batches.

    Stored are the rows of each time slot with their runs inside the slot, in buckets of (group, slot).  A batch reads
    the buckets of the slots it brings rows for, works those slots out again with the new rows and stores them; other
    slots are not touched, late rows or not.  Runs across slots come from one summary row per slot when the result is
    read.  So the result does not depend on where batches end or in which order files arrive, and a replay is harmless.
    ``log`` has id (unique) and at.
    """
    schema = runs_in_slots(log, group, "at", "id", hit, slot_seconds).schema
    slot = [*group, "_slot"]

    def table(session: SparkSession) -> DeltaTable:
        return DeltaTable(session, f"{work}/slots", schema, newest_group(slot), every, slot, buckets)

    def on_batch(df: DataFrame, batch: int) -> None:
        stored = table(df.sparkSession)
        touched = df.select(*group, slot_of("at", slot_seconds).alias("_slot")).distinct()
        wanted = [r[0] for r in touched.select(stored.bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        before = join_back(stored.current(batch, wanted), touched, slot, "left_semi").select(*df.columns)
        rows = before.join(df.select("id"), "id", "left_anti").unionByName(df)
        stored.put(runs_in_slots(rows, group, "at", "id", hit, slot_seconds), batch)

    run_available(log, f"{work}/checkpoint", on_batch, mode="append")
    rows = table(log.sparkSession).current()
    return runs_across_slots(rows, log.columns, group, "at", "id", threshold)


def breaker_runs(log: DataFrame, work: str, threshold: int = lx.BREAKER_THRESHOLD, **options) -> DataFrame:
    """Run lengths of blocking states per source; see ``runs``."""
    rows = runs(log, work, ["source"], F.col("state").isin(lx.BREAKER_STATES), threshold, **options)
    return rows.select(*log.columns, "run", (F.col("run") >= threshold).alias("at_threshold"))


def paging(pages: DataFrame, work: str, limit: int = lx.EMPTY_PAGE_STOP, **options) -> DataFrame:
    """Stream form of ``fetchlog.paging_stop``: pages a query would have read until ``limit`` in a row brought nothing new.

    A page that arrives late can move a query's stop either way; the result is always that of all pages so far.
    """
    rows = runs(pages, work, ["query"], F.col("new_ids") == 0, limit, **options)
    return rows.filter("first_at IS NULL OR struct(at, id) <= first_at").select(*pages.columns, "run")


def halted(queue: DataFrame, work: str, every: int = EVERY) -> DataFrame:
    """Stream form of ``fetchlog.halt_on_restriction``: adds ``outcome`` to the rows of a queue (source, position, state).

    Kept per source is the first restricted position; a restriction that arrives late defers what lies behind it.
    """
    places = StructType.fromDDL("source string, halt bigint")

    def tables(session: SparkSession) -> tuple[DeltaTable, DeltaTable]:
        return (DeltaTable(session, f"{work}/rows", queue.schema, lambda rows: rows, every),
                DeltaTable(session, f"{work}/halts", places, totals(["source"], halt=F.min("halt")), every))

    def on_batch(df: DataFrame, batch: int) -> None:
        rows, halts = tables(df.sparkSession)
        rows.put(df, batch)
        halts.put(df.filter(F.col("state").isin(lx.RESTRICTION_STATES)).groupBy("source").agg(
            F.min("position").cast("bigint").alias("halt")), batch)

    run_available(queue, f"{work}/checkpoint", on_batch, mode="append")
    rows, halts = tables(queue.sparkSession)
    at, halt = F.col("position"), F.col("halt")
    outcome = F.when(at > halt, "deferred").when(at == halt, "restricted").otherwise("done")
    return join_back(rows.current(), halts.current(), ["source"], "left").select(*queue.columns, outcome.alias("outcome"))


def new_since_last_run(stream: DataFrame, work: str) -> DataFrame:
    """Digest input: rows of files that arrived since the last run of the same folder.

    The stream checkpoint is the watermark.  A second call with the same ``work`` returns
    only what is new; nothing is lost if a run is interrupted.
    """
    spark = stream.sparkSession
    seen: list[int] = []
    out = f"{work}/rows"

    def on_batch(df: DataFrame, batch: int) -> None:
        batch_writer(out)(df, batch)
        seen.append(batch)

    run_available(stream, f"{work}/checkpoint", on_batch, mode="append")
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return read_batches(spark, out, stream.schema).filter(F.col("batch").between(min(seen), max(seen))).drop("batch")
