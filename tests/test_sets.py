"""Set operators against brute force, and the same result however rows are spread."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.operators import aggregates as A
from vacantry.operators import fetchlog as L
from vacantry.operators import prototypes as V
from vacantry.operators import selection as S
from vacantry.operators import store
from vacantry.streaming import jobs
from vacantry.streaming.runner import read_files

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
LOG = "id bigint, source string, key string, state string, at timestamp"


def make_log(n, seed=3):
    rnd = random.Random(seed)
    states = ["healthy", "blocked", "rate_limited", "empty", "login_required"]
    # one hot source holds most rows; several rows share an instant
    return [(i, "hot" if rnd.random() < 0.8 else rnd.choice("ab"), f"k{rnd.randrange(9)}",
             rnd.choices(states, [3, 3, 2, 1, 0.05])[0], T0 + dt.timedelta(seconds=(i // 2) * 41)) for i in range(n)]


def brute_runs(rows):
    run, out = {}, {}
    for i, source, _, state, at in sorted(rows, key=lambda r: (r[4], r[0])):
        run[source] = run.get(source, 0) + 1 if state in lx.BREAKER_STATES else 0
        out[i] = run[source]
    return out


@pytest.mark.parametrize("parts,slot", [(1, 60), (8, 600), (3, 10**7)])
def test_run_lengths(spark, parts, slot):
    rows = make_log(600)
    df = spark.createDataFrame(rows, LOG).repartition(parts)
    got = L.run_lengths(df, ["source"], "at", "id", F.col("state").isin(lx.BREAKER_STATES), slot)
    assert {r.id: r.run for r in got.collect()} == brute_runs(rows)


def test_breaker_verdicts(spark):
    rows = make_log(300, seed=5)
    want, broken, attempts, ended, run = {}, set(), {}, set(), {}
    for i, source, key, state, at in sorted(rows, key=lambda r: (r[4], r[0])):
        want[i] = ("source_terminated" if source in ended else "circuit_broken" if source in broken
                   else "key_exhausted" if attempts.get((source, key), 0) >= 3 else "allowed")
        attempts[source, key] = attempts.get((source, key), 0) + 1
        run[source] = run.get(source, 0) + 1 if state in lx.BREAKER_STATES else 0
        if run[source] >= 3:
            broken.add(source)
        if state in lx.RESTRICTION_STATES:
            ended.add(source)
    df = spark.createDataFrame(rows, LOG)
    assert {r.id: r.verdict for r in L.breaker(df, strict=True).collect()} == want


def test_rate_usage(spark):
    rows = make_log(400)
    df = spark.createDataFrame(rows, LOG)
    got = {r.id: r.in_window for r in L.rate_usage(df, 300, 5).collect()}
    for i, source, _, _, at in rows:
        assert got[i] == sum(1 for r in rows if r[1] == source and at - dt.timedelta(seconds=300) <= r[4] <= at)


@pytest.mark.parametrize("files,order", [(1, 1), (2, 1), (2, -1), (4, -1)])
def test_breaker_stream_equals_batch(spark, tmp_path, files, order):
    rows = make_log(240, seed=9) + [(900 + i, None, "k", "blocked", T0 + dt.timedelta(seconds=i)) for i in range(3)]
    size = -(-len(rows) // files)
    for n in list(range(files))[::order]:  # files arrive in this order
        spark.createDataFrame(rows[n * size:(n + 1) * size], LOG).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    stream = read_files(spark, str(tmp_path / "in" / "*"), LOG, files_per_batch=1)
    got = jobs.breaker_runs(stream, str(tmp_path / "work")).collect()
    assert len(got) == len(rows) and {r.id: r.run for r in got} == brute_runs(rows)
    assert all(r.at_threshold == (r.run >= lx.BREAKER_THRESHOLD) for r in got)


def test_logs_keep_rows_without_keys(spark):
    rows = [(1, None, "k", "blocked", T0), (2, None, "k", "blocked", None), (3, "a", None, "healthy", T0), (4, None, None, "blocked", T0)]
    df = spark.createDataFrame(rows, LOG)
    assert L.breaker(df).count() == L.breaker(df, strict=True).count() == L.rate_usage(df, 60, 1).count() == 4
    assert {r.id: r.in_window for r in L.rate_usage(df, 60, 1).collect()} == {1: 2, 2: None, 3: 1, 4: 2}
    pages = spark.createDataFrame([(i, None, 0, None) for i in range(3)], "id bigint, query string, new_ids int, at timestamp")
    assert L.paging_stop(pages, 2).count() == 2


def test_last_row_of_a_key_counts(spark):
    old = spark.createDataFrame([("s", "1", 1)], "source string, job_id string, v int")
    new = spark.createDataFrame([("s", "1", 5), ("s", "1", 7), ("s", "2", 3), (None, "2", 4), (None, "2", 9)], old.schema)
    got = sorted(map(str, store.upsert(old, new, ["source", "job_id"], F.col("v")).select("source", "job_id", "v").collect()))
    assert got == sorted(str(r) for r in spark.createDataFrame([("s", "1", 7), ("s", "2", 3), (None, "2", 4), (None, "2", 9)], old.schema).collect())


def test_predicates_pass_staged_columns(spark):
    from vacantry.functions.staging import computed_once

    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    out = computed_once(df.withColumn("x", F.upper("p_name")), df.columns).filter("p_partkey = 7 AND x <> ''")
    assert out.columns == [*df.columns, "x"]
    assert "EqualTo(p_partkey,7)" in out._jdf.queryExecution().executedPlan().toString()


def test_digest_stream_returns_only_news(spark, tmp_path):
    src, work = str(tmp_path / "in"), str(tmp_path / "work")
    spark.range(5).write.parquet(src)
    assert jobs.new_since_last_run(read_files(spark, src, "id bigint"), work).count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    assert sorted(r.id for r in jobs.new_since_last_run(read_files(spark, src, "id bigint"), work).collect()) == [5, 6, 7]
    assert jobs.new_since_last_run(read_files(spark, src, "id bigint"), work).count() == 0


def test_retry_stream_counts_attempts(spark, tmp_path):
    schema = "id bigint, job_source string, job_id string, kind string, message string, at timestamp"
    for n in range(7):
        spark.createDataFrame([(n, "s", "1", "transient_error", "m", T0 + dt.timedelta(days=n))], schema).write.parquet(
            str(tmp_path / "in" / f"p{n}"))
    stream = read_files(spark, str(tmp_path / "in" / "*"), schema, files_per_batch=1)
    row = jobs.keep_current(jobs.retry_state(stream, "exact"), ["job_source", "job_id"], str(tmp_path / "w")).collect()[0]
    assert (row.status, row.attempts, row.next_retry_at) == ("error", 7, None)


@pytest.mark.parametrize("width", [1.0, 50.0, 1e9])
def test_exact_median(spark, width):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 5}", float(rnd.randrange(400)) / 4 - 20) for i in range(500)] + [("one", 7.0), (None, 1.0), (None, 2.0)]
    got = A.exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", width)
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    assert {r.k: (r.samples, r.median) for r in got.collect()} == {k: (len(v), statistics.median(v)) for k, v in want.items()}


def test_categories_travel_in_chunks(spark, monkeypatch):
    rnd = random.Random(2)
    vectors = spark.createDataFrame([(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(60)], "id bigint, embedding array<float>")
    vectors = vectors.union(vectors.limit(3)).union(spark.createDataFrame(
        [(100, None), (101, []), (102, [1.0]), (103, [float("nan"), 1.0, 0.0, 0.0]), (104, [0.0] * 4), (105, [float("inf")] * 4)], vectors.schema))
    means = spark.createDataFrame([(f"c{i:02d}", i % 2 == 0, 20 - i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(20)]
                                  + [("same", True, 0, [1.0, 0.0, 0.0, 0.0]), ("zz", True, 99, [1.0, 0.0, 0.0, 0.0]), ("bad", True, 1, [0.0] * 4)],
                                  "category string, eligible boolean, ordinal int, mean array<double>")
    cols = ["id", "predicted_category", "is_eligible", "reason"]

    def got(m, chunks=1):
        return sorted(map(str, V.classify(vectors, m, 0.5, 0.1, 4, chunks).select(*cols).collect()))

    whole = got(means)
    assert len(whole) == 69 and got(means, 2) == whole == got(means, 5)
    reasons = {r.id: r.reason for r in V.classify(vectors, means, 0.5, 0.1, 4).where("id >= 100").collect()}
    assert reasons == {100: "null", 101: "empty", 102: "dimension", 103: "not_finite", 104: "zero", 105: "not_finite"}
    assert all("predicted_category=None" in r for r in got(means.where("false"))) and len(got(means.where("false"))) == 69
    one = spark.createDataFrame([(1, [2.0, 0.0, 0.0, 0.0])], vectors.schema)
    assert V.classify(one, means, 0.5, 0.0, 4).first().predicted_category == "same"
    monkeypatch.setattr(V, "CHUNK_BYTES", 400)
    with pytest.raises(Exception, match="ask for more chunks"):
        V.classify(vectors, means, 0.5, 0.1, 4).collect()
    mixed = vectors.withColumn("category", F.lit("a"))
    assert V.mean_vectors(mixed, 4).first().n == 63


OBS = ("job_source string, job_id string, observation_id string, confidence_label string, is_posted boolean, is_predicted boolean, "
       "observed_at timestamp, city string, region string, currency string, data_source string")


def test_best_observation_order(spark):
    t = T0

    def row(i, label="posted_exact", posted=True, predicted=False, at=t, city=None, region=None, cur="GBP", src="x"):
        return ("s", "1", i, label, posted, predicted, at, city, region, cur, src)

    ladder = [  # each next row loses to the one before it
        row("a"), row("b"), row("0", src="y"), row("0", cur="EUR"), row("0", at=t - dt.timedelta(1), city="L"),
        row("0", at=None, city="L"), row("0", label="external_exact", at=t + dt.timedelta(9)), row("0", label="guess")]
    for i in range(len(ladder) - 1):
        df = spark.createDataFrame(ladder[i:][::-1], OBS).withColumn("country", F.lit("GB"))
        best = S.best_observation(df, F.col("country"), ["x", "y"]).collect()[0]
        assert (best.observation_id, best.confidence_label, best.data_source, best.currency) == tuple(
            ladder[i][j] for j in (2, 3, 10, 9))


def test_merge_twice_is_merge_once(spark):
    cols = ("source string, job_id string, title string, description_text string, role_label string, role_confidence double, "
            "role_reason string, taxonomy_version string, created_at timestamp, application_status string")
    old = spark.createDataFrame([("s", "1", "Old", "full text", "Primary role", 0.9, "r", "3", T0, "applied"),
                                 ("s", "2", "Old", "full text", "strange label", 0.9, "r", "3", T0, "saved")], cols)
    new = spark.createDataFrame([("s", "1", "New", " ", "Unclassified", 0.1, None, "4", T0 + dt.timedelta(9), "saved"),
                                 ("s", "2", "New", None, None, None, None, "4", T0 + dt.timedelta(9), "saved"),
                                 ("s", "3", "New", None, None, None, None, None, T0 + dt.timedelta(9), "saved")], cols)
    once = store.merge_postings(old, new)
    rows = {r.job_id: r for r in once.collect()}
    assert (rows["1"].title, rows["1"].role_label, rows["1"].taxonomy_version, rows["1"].application_status) == ("New", "Primary role", "3", "applied")
    assert (rows["2"].role_label, rows["2"].taxonomy_version) == ("strange label", "4")
    assert rows["3"].title == "New" and len(rows) == 3
    assert sorted(map(str, store.merge_postings(once, new).collect())) == sorted(map(str, once.collect()))


def test_snapshot_append_is_idempotent(spark):
    cols = "benchmark_id string, series_id string, payload_hash string, fetched_at timestamp"
    new = spark.createDataFrame([("b1", "s", "p", T0), ("b2", "s", "p", T0 + dt.timedelta(1)), ("b3", "s", "q", T0)], cols)
    empty = spark.createDataFrame([], cols)
    first = store.store_snapshot(empty, new)
    assert sorted((r.benchmark_id, r.inserted) for r in first.collect()) == [("b1", True), ("b3", True)]
    stored = first.drop("inserted")
    assert sorted((r.benchmark_id, r.inserted) for r in store.store_snapshot(stored, new).collect()) == [("b1", False), ("b3", False)]
    assert store.insert_ignore(stored, new, ["series_id", "payload_hash"]).count() == 0


def test_sponsor_names(spark):
    employers = spark.createDataFrame([("Acme, Ltd.",), ("Twin",), ("Nobody",), (None,)], "employer string")
    register = spark.createDataFrame([("ACME  LTD", "Leeds", "Skilled Worker"), ("Twin", "A", "Skilled Worker"), ("twin", "B", "Skilled Worker"),
                                      ("Nobody", "C", "Other")], "name string, town string, route string")
    got = {r.employer: r.employer_status for r in A.sponsor_status(employers, register).collect()}
    assert got == {"Acme, Ltd.": "confirmed_skilled_worker", "Twin": "ambiguous", "Nobody": "no_confirmed_match", None: "unknown"}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_of_a_hot_key(spark, how):
    """One key holds half of all rows; no task holds more than a few times the median."""
    from vacantry.operators.joins import heavy_keys, spread_join

    rows = spark.range(20_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 1000 <> 1 THEN concat('k', id % 997) END AS key")
    side = spark.range(900).selectExpr("CASE WHEN id = 0 THEN 'hot' ELSE concat('k', id) END AS key", "id AS v")
    assert list(heavy_keys(rows, "key", 16)) == ["hot"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = spread_join(rows, side, "key", how, parts=16)
        want = rows.join(side, "key", how)
        assert sorted(map(str, got.select("id", "key", "v").collect())) == sorted(map(str, want.select("id", "key", "v").collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        sizes = sorted(r["count"] for r in spread_join(rows, side, "key", how, parts=16).groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 3 * statistics.median(sizes)
        plain = sorted(r["count"] for r in rows.join(side, "key", how).groupBy(F.spark_partition_id()).count().collect())
        assert plain[-1] > 6 * statistics.median(plain)
    finally:
        for k, v in (("autoBroadcastJoinThreshold", "10485760"), ("adaptive.enabled", "true"), ("shuffle.partitions", "4")):
            spark.conf.set(f"spark.sql.{k}", v)


def test_positions_over_ranges(spark):
    from vacantry.operators.ranks import with_position

    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot"] * 5 + ["a", None]), rnd.choice([None, 1.5, 2.5])) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, k string, v double").repartition(5)
    got = {r.id: r.position for r in with_position(df, "k", F.desc("v"), "id").collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2] is None, -(r[2] or 0), r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 501))
    assert with_position(df.where("false"), "id").count() == 0
    with pytest.raises(ValueError):
        with_position(df, "id", name="K")


def test_bucketed_merge_leaves_other_buckets_alone(spark, tmp_path):
    from vacantry.operators.buckets import BUCKET, BucketedTable

    rows = spark.range(1000).selectExpr("CASE WHEN id % 100 > 0 THEN id END AS k", "id AS v")
    path = tmp_path / "table"
    table = BucketedTable(spark, str(path), rows.schema, ["k"], 16)
    table.create(rows)
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    changes = spark.createDataFrame([(1, -1), (2, -2), (5000, 7)], rows.schema)
    touched = table.merge(changes, lambda old, new: store.upsert(old, new, ["k"]))
    assert 1 <= len(touched) <= 3
    after = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    inside = {f for f in before if int(f.parent.name.partition("=")[2]) in touched}
    assert {f: t for f, t in before.items() if f not in inside} == {f: t for f, t in after.items() if int(
        f.parent.name.partition("=")[2]) not in touched} and not inside & set(after)
    plan = table.read(touched)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({BUCKET}" in plan or f"PartitionFilters: [{BUCKET}" in plan
    want = {(r.k, r.v) for r in rows.where("k IS NULL OR k NOT IN (1, 2)").collect()} | {(1, -1), (2, -2), (5000, 7)}
    assert {(r.k, r.v) for r in table.read().collect()} == want and table.read().count() == 1001
    assert table.merge(changes.where("false"), lambda old, new: old) == []
    gone = table.merge(changes, lambda old, new: old.where("false"))
    assert gone == touched and table.read(touched).count() == 0 and table.read().count() > 800


def test_term_matches_take_the_longest_from_the_left(spark):
    from vacantry.operators.joins import term_matches

    terms = spark.createDataFrame([("a b",), ("b c d",), ("C++",), ("a",), ("é f",), ("",)], "term string")
    rows = spark.createDataFrame([(1, "A  b c d, c++ x a"), (2, "xb c d b c d"), (3, None), (4, ""), (5, "É F a-a, a b"), (6, "a " * 3000)], "id int, body string")
    got = {(r.id, r.term): r.n for r in term_matches(rows, ["id"], "body", terms).collect()}
    assert got == {(1, "a b"): 1, (1, "C++"): 1, (1, "a"): 1, (2, "b c d"): 1, (5, "é f"): 1, (5, "a"): 2, (5, "a b"): 1, (6, "a"): 3000}
    with pytest.raises(Exception, match="tokens"):
        term_matches(rows, ["id"], "body", terms, most_tokens=2).collect()


def test_titles_are_folded(spark):
    from vacantry.functions import titles as X

    rows = spark.createDataFrame([(1, "Ｓｒ． ﬁeld Engineer"), (2, "Senior Architect"), (3, None), (4, "Sénior Ingénieur"), (5, "Sénior Ingénieur"),
                                  (6, "Senior Architect")], "id int, t string")
    got = {r.id: (r.normalized_title, r.seniority) for r in X.titled_rows(rows, "t").collect()}
    assert got[1] == ("senior field engineer", "senior") and got[2] == got[6] and got[3] == ("", "_any")
    assert got[4] == got[5] == ("senior ingenieur", "_any")


def test_term_matches_shuffle_few_runs(spark, monkeypatch):
    from vacantry.operators import joins

    met, join = [], joins.spread_join
    monkeypatch.setattr(joins, "spread_join", lambda rows, *rest: (met.append(rows.count()), join(rows, *rest))[1])
    terms = spark.createDataFrame([(f"name{i} of term {i}",) for i in range(500)], "term string")
    rows = spark.createDataFrame([(i, f"Some words before name{i} of term {i} and more words after it, name{i} of no term.") for i in range(500)], "id int, body string")
    got = joins.term_matches(rows, ["id"], "body", terms).collect()
    assert len(got) == 500 and all(r.n == 1 and r.term == f"name{r.id} of term {r.id}" for r in got)
    assert 500 <= met[0] < 1000  # of some 70,000 runs
