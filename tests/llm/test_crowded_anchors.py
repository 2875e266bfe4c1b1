"""Repeated strings whose n-gram has very many different stretches."""

import collections
import random

import numpy as np
import plain_forms as plain
import pyarrow as pa

from vacantry.llm import repeats
from vacantry.llm.scratch import Scratch


def edges(n, seed=3):
    """Texts that share one passage, each with its own words around it; some share a few bytes before or after it as well."""
    r = random.Random(seed)

    def some(k):
        return "".join(r.choice("abcdefgé ") for _ in range(k))

    passage, near = some(420), [some(40) for _ in range(3)]
    return [some(r.randint(0, 300)) + r.choice([*near, "", ""]) + passage + r.choice([*near, "", ""]) + some(r.randint(0, 300))
            for _ in range(n)]


def test_crowded_anchors_are_split_and_sorted(spark, monkeypatch):
    def counted(length):
        raise AssertionError("windows are counted one by one")

    monkeypatch.setattr(repeats, "_single_windows", counted)
    rows = [*enumerate(edges(60), start=1), (None, "no repeats"), (100, None), *[(200 + i, "x" * (396 + i)) for i in range(8)]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.without_repeats(frame, Scratch(spark, "test"), most=7).drop("text")
    want = plain.without_repeats(rows)
    assert sum(w[2] > 0 for w in want) > 60
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def test_cells_hold_every_window_once_and_thin_out():
    """One key with all stretches: cells part its windows, equal windows keep equal keys, the last round leaves one content a key."""
    r = np.random.default_rng(8)
    passage = r.integers(0, 256, 400).astype(np.uint8).tobytes()
    rows, n = [], 300
    for i in range(n):
        left, right = int(r.integers(0, 200)), int(r.integers(32, 200))
        data = r.integers(0, 3, 200).astype(np.uint8).tobytes() + passage + r.integers(0, 3, 400).astype(np.uint8).tobytes()
        first = 200 - left  # at most ``left`` bytes before the n-gram at the passage's first byte
        rows.append((5, i, 1, left, data[first:first + 400 + int(r.integers(0, left + 1))]))
    names = ("key", "content", "weight", "anchor", "data")
    table = pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], t) for i, t in enumerate(
        (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=list(names))
    for width in repeats.CELLS:
        cells = [c for b in repeats._in_cells(400, 32, width)([table]) for c in b.to_pylist()]
        before = {row["content"]: row["data"] for row in table.to_pylist()}
        places, keys = collections.Counter(), collections.defaultdict(set)
        for c in cells:
            assert before[c["of"]][c["shift"]:c["shift"] + len(c["data"])] == c["data"]
            for i in range(len(c["data"]) - 399):
                places[c["of"], c["shift"] + i] += 1
                keys[c["data"][i:i + 400]].add(c["key"])
        assert places == {(of, i): 1 for of, data in before.items() for i in range(len(data) - 399)}
        assert all(len(k) == 1 for k in keys.values())
        distinct = {c["content"]: c for c in cells}
        table = pa.RecordBatch.from_pylist([{k: c[k] for k in names} for c in distinct.values()], schema=table.schema)
    assert max(collections.Counter(c["key"] for c in distinct.values()).values()) == 1


def test_crowded_stretches_come_back_once(spark):
    """A stretch with runs in many cells has one row, so that the join with its occurrences makes one row of each."""
    r = np.random.default_rng(4)
    passage = r.integers(0, 256, 700).astype(np.uint8).tobytes()
    rows = []
    for i in range(40):
        left, right = int(r.integers(0, 9)), int(r.integers(0, 200))
        data = r.bytes(left) + passage[:500 + right] + r.bytes(269 - right)
        rows.append((5, i, 1 + i % 2, left + 369, data[:769 + left]))
    rows = [(*row[:3], 368, row[4][row[3] - 368:]) for row in rows]  # at most 368 bytes before the n-gram
    frame = spark.createDataFrame(rows, "key long, content long, weight long, anchor int, data binary").repartition(3)
    got = repeats._runs_of_cells(frame, Scratch(spark, "test"), 400, 32, 7, repeats.CELLS).collect()
    windows = collections.Counter()
    for row in rows:
        for i in range(len(row[4]) - 399):
            windows[row[4][i:i + 400]] += row[2]
    flags = {row[1]: np.array([windows[row[4][i:i + 400]] > 1 for i in range(len(row[4]) - 399)]) for row in rows}
    want = {content: repeats._runs(f).tolist() for content, f in flags.items() if f.any()}
    assert max(n for runs in want.values() for a, b in runs for n in [b - a]) > 32
    assert len(got) == len({g["content"] for g in got})
    assert {g["content"]: np.frombuffer(g["runs"], dtype=np.int32).reshape(-1, 2).tolist() for g in got} == want


def test_copies_of_one_text_are_dealt_out(spark):
    """Very many copies of a text do not meet in one task when their repeats are taken out."""
    from pyspark.sql import functions as F

    r = random.Random(6)
    rows = [*((i, "".join(r.choice("abcdef ") for _ in range(500))) for i in range(300)), *((300 + i, "one text " * 60) for i in range(1500))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in keep}
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        got = repeats.without_repeats(frame, Scratch(spark, "test")).drop("text").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(collections.Counter(g["task"] for g in got).values()) < 600
    assert collections.Counter(tuple(g)[:-1] for g in got) == collections.Counter(plain.without_repeats(rows))
