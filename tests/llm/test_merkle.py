"""The Merkle manifest against a plain form, and its sweeps against each other."""

import collections
import random

import plain_forms as plain
import pytest
from pyspark.sql import functions as F

from vacantry.llm import merkle, queries
from vacantry.llm.scratch import Scratch

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, root string, at int"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def rows():
    r = random.Random(3)
    out = [(i, r.choice(["hot", "hot", "hot", "a", "é", "", None]), r.choice(["en", None]), r.choice([None, i]),
            r.choice(["Some Text", "", None, "lower", f"É {i} X"])) for i in range(700)]
    return out + [(5, "lone", "en", 1, "A"), (None, "a", None, None, None), (None, "a", "en", 2, "B"), out[3], out[3],
                  (9000, "hot", "en", 3, "Long text " * 300_000), (9001, "z", "en", 1, "x" * 10)]


def bag(df):
    return collections.Counter(map(tuple, df.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("merkle"))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows()], SCHEMA).repartition(5)
    df.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_query_equals_plain_form(spark, stored):
    assert bag(queries.op12_merkle(spark, stored)) == collections.Counter(plain.merkle(rows()))


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert bag(queries.op12_merkle(spark, sf)) == collections.Counter(plain.merkle(list(map(tuple, docs.collect()))))


def test_blocks_of_several_rounds(spark, monkeypatch):
    """Trees that need more than one round, one source holding nearly all rows."""
    many = [(i, "hot" if i % 50 else f"s{i % 7}", "en", 1, f"Text {i}") for i in range(9000)]
    docs = spark.createDataFrame(many, "doc_id long, source string, lang string, n_chars int, text string")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                      merkle.leaf_digest(text=merkle.folded_case()))
    out = merkle.manifest(docs, Scratch(spark, "test"), tampered).withColumn("folded_root", merkle.fold("altered", "proof"))
    out = out.withColumn("proof_sha256", merkle.proof_digest("proof")).withColumn("verified", F.expr("folded_root = root"))
    assert bag(out) == collections.Counter(plain.merkle(many))


def test_empty_and_single(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars int, text string")
    assert merkle.manifest(docs, Scratch(spark, "test")).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], docs.schema)
    row = merkle.manifest(one, Scratch(spark, "test")).first()
    assert row.leaf == row.subroot == row.root == row.altered and row.proof == []


def test_sweeps_take_few_messages():
    for n in (1, 2, 15, 16, 17, 255, 257, 4096):
        height = merkle._height(n)
        digests = [str(i) for i in range(n)]
        nodes = merkle.sweep_up(digests, height)
        back = dict(merkle.sweep_down(nodes, n, height, []))
        assert sorted(back) == list(range(n))
        for i in (0, n // 2, n - 1):
            at = digests[i]
            for left, right in back[i]:
                at = merkle._hash([left, at, right])
            assert at == nodes[height, 0]


def test_sql_equals_plain_form():
    import duckdb

    con = duckdb.connect()
    for sf in ("sf0.001", "sf0.01"):
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
        table = con.execute("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
        got = con.execute(queries.ORACLES["op12_merkle"])
        names = [c[0] for c in got.description]
        assert collections.Counter(tuple(r[names.index(c)] for c in COLUMNS) for r in got.fetchall()) == collections.Counter(plain.merkle(table))
