"""HyperMinHash near duplicates against all pairs, and the parts of the sketch by themselves."""

import collections
import random

import numpy as np
import plain_forms as plain
import pytest
from test_operators import frame, texts

from vacantry.llm import candidates, hyper_minhash, queries
from vacantry.llm.components import components
from vacantry.llm.scratch import Scratch


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


def plain_rows(rows):
    return collections.Counter((i, n, low, i == low) for i, n, low in plain.components(rows, 4))


def test_equals_all_pairs(spark):
    rows = list(enumerate(texts(), start=10))
    rows += [(3, None), (None, rows[0][1]), (None, ""), rows[5], rows[5], (900, "a b c d e f g"), (901, "a b c d e f g h"),
             (902, "A b c d e"), (903, "word " * 900_000), (904, " ".join(f"w{i}" for i in range(5000))),
             (905, " ".join(f"w{i}" for i in range(4200)))]
    got = hyper_minhash.near_duplicates(frame(spark, rows), Scratch(spark, "test"))
    assert bag(got) == plain_rows(rows)


def test_edits_around_the_bound(spark):
    """Copies of texts of many sizes with ever more edits, at and around similarity 0.8 and class limits."""
    r = random.Random(8)
    rows = []
    for size in [8, 12, 15, 16, 17, 19, 20, 31, 33, 40, 64, 66, 80, 127, 130, 200, 257, 300, 320, 700]:
        base = [f"{size}w{r.randrange(10 ** 6)}" for _ in range(size)]
        for edits in range(0, max(2, size // 20) + 2):
            w = list(base)
            for k in r.sample(range(size), min(edits, size)):
                w[k] = f"e{r.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
            rows.append((len(rows), " ".join(w[:max(4, int(size * r.uniform(0.78, 1)))])))
    got = hyper_minhash.near_duplicates(frame(spark, rows), Scratch(spark, "test"))
    assert bag(got) == plain_rows(rows)


def test_large_group_and_common_passage(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
        rows.append((1000 + i, passage + " " + " ".join(f"x{r.randrange(10 ** 6)}" for _ in range(60))))
    got = hyper_minhash.near_duplicates(frame(spark, rows), Scratch(spark, "test"))
    assert bag(got) == plain_rows(rows)


def test_empty_table(spark):
    assert hyper_minhash.near_duplicates(frame(spark, []), Scratch(spark, "test")).count() == 0


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert bag(queries.op13_hyper_minhash(spark, sf)) == plain_rows(rows)


def test_registers_are_floors_of_the_least_hash():
    least = np.array([1 << 53, 0, 1, 2, 3, (1 << 53) - 1, 1 << 52, (1 << 52) + (1 << 42)], dtype=np.uint64)
    got = hyper_minhash.compressed(least).astype(int)
    assert got[0] == 0 and (got[1:] > 0).all()
    assert got[2] == (52 << 10) + 1 and got[3] == (51 << 10) + 1 and got[4] == (51 << 10) + 513
    assert got[5] == 1024 and got[6] == 1 and got[7] == 2


def test_registers_agree_as_often_as_sets_do():
    r = np.random.default_rng(2)
    for n, buckets in ((10, 1), (40, 4), (400, 32), (5000, 32)):
        assert hyper_minhash.buckets_of(np.array([n]))[0] == buckets
        share = []
        for _ in range(20):
            x = r.integers(0, 1 << 62, n + n // 4).astype(np.uint64)
            owner = np.repeat([0, 1], n)
            both = np.concatenate([x[:n], x[n // 4:]])
            a, b = hyper_minhash.registers(owner, both, 2, buckets)
            share.append((a == b).mean())
        assert abs(np.mean(share) - (n - n // 4) / (n + n // 4)) < 0.05


def test_estimate_condition_counts_equal_registers(spark):
    r = np.random.default_rng(4)
    rows = []
    for _ in range(50):
        a = r.integers(0, 1 << 16, hyper_minhash.COMPARED).astype(np.uint16)
        b = np.where(r.random(len(a)) < 0.45, a, a ^ r.integers(1, 1 << 16, len(a)).astype(np.uint16))
        want = bool((a == b).mean() - 2.0 ** -10 / 3 >= 0.42 * (1 - 2.0 ** -10 / 3))
        rows.append([*map(int, hyper_minhash.packed(a[None])[0]), *map(int, hyper_minhash.packed(b[None])[0]), want])
    names = hyper_minhash.SKETCH + [f"{c}_b" for c in hyper_minhash.SKETCH]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names) + ", want boolean")
    assert df.where(f"({hyper_minhash.estimate_condition()}) <> want").count() == 0


@pytest.mark.parametrize("near", ["true", "n + n_b < 12"])
def test_cross_pairs_are_whole_and_made_once(spark, near):
    r = random.Random(9)
    lists = {s: r.sample(range(12), r.choice([1, 2, 2, 3, 5, 8])) for s in range(40)}
    lists[50] = lists[51] = lists[52] = [1, 2, 3]
    part = {node: node // 3 for node in range(12)}
    index = spark.createDataFrame([(s, x, x, part[x]) for s, xs in lists.items() for x in xs], "sig long, node long, n long, component long")
    nodes = spark.createDataFrame([(x, 1) for x in range(12)], "node long, sketch int")
    got = candidates.cross_pairs(index, nodes, Scratch(spark, "test"), near).collect()
    want = {(max(a, b), min(a, b)) for xs in lists.values() for a in xs for b in xs
            if part[a] != part[b] and (near == "true" or a + b < 12)}
    assert sorted(map(tuple, got)) == sorted(want)
    whole = components(candidates.star_pairs(index, [index["node"]]), Scratch(spark, "test"))
    assert whole.count() > 0
