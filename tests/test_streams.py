"""Streams against their batch operators, whatever the files and their order; bounded tables of changes."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_sets import LOG, T0, brute_runs, make_log

from vacantry import lexicon as lx
from vacantry.operators import fetchlog as L
from vacantry.streaming import jobs
from vacantry.streaming.deltas import DeltaTable, newest, newest_group, totals
from vacantry.streaming.runner import read_files


def arriving(spark, folder, rows, schema, files, seed):
    """Stream over the rows in that many files, one micro-batch each, in a shuffled order."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    size = -(-len(rows) // files)
    for n in range(files):
        spark.createDataFrame(rows[n * size:(n + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/part{n:03d}")
    return read_files(spark, f"{folder}/*", schema, files_per_batch=1)


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("files", [1, 2, 7])
def test_rate_windows_count_every_row(spark, tmp_path, files):
    rows = make_log(150, seed=2) + [(900 + i, None, "k", "blocked", None) for i in range(3)]
    stream = arriving(spark, str(tmp_path / "in"), rows, LOG, files, files)
    windows, late = jobs.rate_windows(stream, str(tmp_path / "w"), None, 60, 20)
    want = collections.Counter()
    for _, source, _, _, at in rows:
        if at is not None:
            slot = int(at.timestamp()) // 20
            for k in range(3):
                want[source, (slot - k) * 20] += 1
    got = {(r.source, int(r.start.replace(tzinfo=dt.timezone.utc).timestamp())): r.requests for r in windows.collect()}
    assert got == want
    assert sorted(r.id for r in late.collect()) == [900, 901, 902] and {r.reason for r in late.collect()} == {"no_time"}


@pytest.mark.parametrize("files", [1, 3])
def test_late_rows_are_listed(spark, tmp_path, files):
    rows = make_log(120, seed=4)
    stream = arriving(spark, str(tmp_path / "in"), rows, LOG, files, 1)
    windows, late = jobs.rate_windows(stream, str(tmp_path / "w"), 300, 20, 20)
    counted = windows.agg(F.sum("requests")).first()[0]
    assert counted + late.count() == len(rows)
    assert (late.count() > 0) == (files > 1) and {r.reason for r in late.collect()} <= {"too_late"}


@pytest.mark.parametrize("files", [1, 2, 7])
def test_paging_and_halts_equal_batch(spark, tmp_path, files):
    rnd = random.Random(7)
    pages = [(i, rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([0, 0, 0, 5]), T0 + dt.timedelta(seconds=i // 3 * 200))
             for i in range(90)]
    schema = "id bigint, query string, new_ids int, at timestamp"
    got = jobs.paging(arriving(spark, str(tmp_path / "p"), pages, schema, files, files), str(tmp_path / "pw"), every=3, buckets=4)
    want = L.paging_stop(spark.createDataFrame(pages, schema))
    assert bag(got) == bag(want) and got.columns == want.columns

    queue = [(i, rnd.choice(["hot", "hot", "b", None]), i, rnd.choice(["healthy"] * 9 + ["blocked"])) for i in range(90)]
    schema = "id bigint, source string, position bigint, state string"
    got = jobs.halted(arriving(spark, str(tmp_path / "q"), queue, schema, files, files), str(tmp_path / "qw"), every=2)
    assert bag(got) == bag(L.halt_on_restriction(spark.createDataFrame(queue, schema)))


def test_breaker_touches_only_its_slots(spark, tmp_path, monkeypatch):
    """A late row reads the buckets of its slot, and stores that slot only."""
    rows = make_log(240, seed=9)
    early, late = rows[:100] + rows[101:], rows[100:101]
    for n, part in enumerate([early, late]):
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    read, put = [], []
    current, store = DeltaTable.current, DeltaTable.put
    monkeypatch.setattr(DeltaTable, "current", lambda self, before=None, buckets=None: read.append(buckets) or current(self, before, buckets))
    monkeypatch.setattr(DeltaTable, "put", lambda self, rows, batch: put.append(rows.count()) or store(self, rows, batch))
    got = jobs.breaker_runs(read_files(spark, str(tmp_path / "in" / "*"), LOG, files_per_batch=1), str(tmp_path / "w"))
    assert {r.id: r.run for r in got.collect()} == brute_runs(rows)
    assert len(read[1]) == 1 and put[0] == 239
    slot = [r for r in rows if r[1] == late[0][1] and r[4].timestamp() // 600 == late[0][4].timestamp() // 600]
    assert put[1] == len(slot)


def test_tables_of_changes_stay_small(spark, tmp_path):
    schema = spark.range(0).selectExpr("id AS k", "id AS v").schema
    table = DeltaTable(spark, str(tmp_path / "t"), schema, newest(["k"]), every=10)
    want = {}
    for n in range(25):
        table.put(spark.range(n % 4, n % 4 + 3).selectExpr("id AS k", f"{n}L AS v"), n)
        want |= {k: n for k in range(n % 4, n % 4 + 3)}
        base, deltas = table.folders()
        assert len(deltas) + (base is not None) <= 11
    assert dict(map(tuple, table.current().collect())) == want
    before = dict(map(tuple, table.current(before=19).collect()))
    table.put(spark.range(100, 101).selectExpr("id AS k", "19L AS v"), 19)  # a replay after its compaction
    assert dict(map(tuple, table.current(before=19).collect())) == before
    assert dict(map(tuple, table.current(before=20).collect())) == {**before, 100: 19}
    sums = DeltaTable(spark, str(tmp_path / "s"), schema, totals(["k"], v=F.sum("v")), every=2, bucket_by=["k"], buckets=4)
    groups = DeltaTable(spark, str(tmp_path / "g"), schema, newest_group(["k"]), every=3)
    for n in range(5):
        sums.put(spark.range(3).selectExpr("id AS k", "1L AS v"), n)
        groups.put(spark.range(n + 1).selectExpr("CASE WHEN id > 1 THEN 7L END AS k", "id AS v"), n)
    assert dict(map(tuple, sums.current().collect())) == {0: 5, 1: 5, 2: 5}
    assert groups.current().count() == 5
    assert lx.BREAKER_THRESHOLD == 3


def test_current_table_of_many_batches(spark, tmp_path):
    schema = "id bigint, job_source string, job_id string, kind string, message string, at timestamp"
    rows = [(n, "s", str(n % 3), "transient_error", "m", T0 + dt.timedelta(days=n)) for n in range(14)]
    stream = arriving(spark, str(tmp_path / "in"), rows, schema, 14, 3)
    out = jobs.keep_current(jobs.retry_state(stream, "exact"), ["job_source", "job_id"], str(tmp_path / "w"), every=4)
    assert sorted((r.job_id, r.attempts) for r in out.collect()) == [("0", 5), ("1", 5), ("2", 4)]
