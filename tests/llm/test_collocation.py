"""Collocations against a plain form and the registered SQL."""

import collections
import random

import plain_forms as plain
import pytest
from compare import check, duck

from vacantry.llm import collocation, queries
from vacantry.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, a int, l string, r int, n int, score int, rank int"


def texts():
    r = random.Random(11)
    words = [w for w in "The tHe of AND new york city é È été high-school x\x00y 東京 to be or not".split(" ")]
    out = []
    for i in range(400):
        parts = []
        for _ in range(r.randint(0, 40)):
            parts.append(r.choice(words + ["New York City", "new york", "to be or not to be"]) + r.choice(["", "", "", ",", ".", "\n", "!\t", "\x0b"]))
        out.append((" ".join(parts), r.choice(["en", "en", "en", "fr", None, "und", ""])))
    return out + [(None, "en"), ("", None), (" \t\n", "fr"), ("a a a a a a a a a a a a a", "aa"), out[0], out[0],
                  ("long text of many words " * 60_000, "xx")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x", 1, 1, 1, 1) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("top, least", [(2000, 10), (3, 10), (None, 2)])
def test_equals_plain_form(spark, top, least):
    got = bag(collocation.collocations(frame(spark, texts()), Scratch(spark, "test"), least=least, top=top))
    want = collections.Counter(plain.collocations(texts(), least, top if top is not None else 10 ** 9))
    assert got == want and got


def test_runs_merged_in_steps_and_parts(spark, monkeypatch):
    monkeypatch.setattr(collocation, "PART_BYTES", 1 << 14)
    streams = collocation.count_streams(frame(spark, texts()), Scratch(spark, "test"), 1)
    rows = [r for r in streams.where("k = 3").collect()]
    assert len({(r.a, r.b, r.c) for r in rows}) == len(rows)
    merge = collocation._Merge(1)
    monkeypatch.setattr(collocation, "MERGE_ROWS", 3)
    import numpy as np
    for i in range(20):
        merge.add(np.array([[i % 3, 5]], np.uint64), np.array([1, 2]))
    grams, counts = merge.done()
    assert grams.tolist() == [[0, 1, 2, 5]] and counts.tolist() == [7, 7, 6, 40]


def test_empty_table(spark):
    assert collocation.collocations(frame(spark, texts()).where("false"), Scratch(spark, "test")).count() == 0


def test_counts_past_64_bit_products(spark):
    score = spark.range(1).selectExpr("4000000000L AS n", "5000000000L AS l", "6000000000L AS r")
    assert score.select(collocation._score("n", "l", "r")).first()[0] == 10 ** 6 * 4000000000 ** 2 // (5000000000 * 6000000000)


def test_joins_are_merges(spark):
    out = collocation.collocations(frame(spark, texts()), Scratch(spark, "test"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "ShuffledHashJoin" not in plan and "NestedLoop" not in plan


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    ok, message = check(spark, duck(sf), sf, "op11_collocations", queries.QUERIES, queries.ORACLES)
    assert ok, message
