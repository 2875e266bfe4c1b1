"""Every pipeline stage against a plain form of its decision, on the smallest tables."""

import collections

import corpus_pipeline
import plain_forms as plain
import pytest
from pyspark.sql import functions as F

from vacantry.llm import shingle_join
from vacantry.llm.queries import QUERIES
from vacantry.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    scratch = Scratch(spark, "test")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(scratch.keep(stage(spark, docs[-1], SF), name))
    return docs


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    for df in steps[1:5]:
        assert df.columns == steps[0].columns


def test_quality_keeps_only_what_passes(steps):
    kept = {i for i, _ in pairs(steps[1])}
    for i, t in pairs(steps[0]):
        n, _, _, _, repeats = plain.stats(t)
        if n < 20 or 100 * repeats > 30 * n:
            assert i not in kept
    assert len(kept) > 0.5 * steps[0].count()


def test_one_of_each_group(steps):
    rows = pairs(steps[1])
    assert {i for i, _ in pairs(steps[2])} == {i for i, _, low in plain.components(rows) if i == low}


def test_contaminated_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in plain.contamination(pairs(steps[2]), items) if not r[5]}
    assert {i for i, _ in pairs(steps[3])} == clean


def test_private_data_is_replaced(steps):
    before = dict(pairs(steps[3]))
    after = dict(pairs(steps[4]))
    assert before.keys() == after.keys()
    for i, t in before.items():
        for _, a, b in plain.base_spans(t):
            assert t[a:b] not in after[i]
        if not any(c.isdigit() or c == "@" for c in t):
            assert after[i] == t


def test_packing_holds_every_document(steps):
    got = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("of")).collect()
    assert {r.doc_id for r in got} == {i for i, _ in pairs(steps[4])} and all(r.n == r.of for r in got)


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[5].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_one_of_each_with_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, 1), (2, long + " x", 2), (2, "other text of the same id that is long enough to be its own", 3), (None, long, 4),
            (None, None, 5), (7, None, 6), (8, "", 7), (5, long, 8), (9, "single", 9), (9, "single", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    got = shingle_join.one_of_each(docs, Scratch(spark, "test"))
    assert got.columns == docs.columns
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter([2, 2, None, 7, 8, 9])


def test_operator_queries_return_their_columns(spark):
    first = {"op1_gam": ["doc_id", "held_out", "score", "predicted"], "op2_language": ["doc_id", "held_out", "lang_pred", "score"],
             "op6_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]}
    for name, columns in first.items():
        out = QUERIES[name](spark, SF)
        assert out.columns[:len(columns)] == columns
        assert out.count() == 200
