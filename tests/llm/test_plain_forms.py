"""Learned operators row by row against plain loops over what was learned; very long texts; the unigram library."""

import collections
import dataclasses
import random

import numpy as np
import plain_forms as plain
import pytest
from test_operators import bag, empty, frame, texts

from vacantry.llm import (archive, collocation, decontaminate, gam, hyper_minhash, langid, merkle, pii, queries, repeats, rules,
                          shingle_join, token_counts)
from vacantry.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
LONG = ["Lorem ipsum dolor sit amet. " * 150_000, " ".join(f"w{i % 977} X{i}" for i in range(300_000)), "é!\n" * 900_000]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def odd_rows():
    out = list(enumerate(texts(), start=5000)) + [(None, "Some text."), (7000, None), (7001, ""), (7002, "?!"), (7003, "x\n\nx\nX")]
    return out + out[:2]


def test_quality_scores_equal_a_walk_over_the_tables(spark, corpus):
    docs, _ = corpus
    many, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = gam.train(many, labels, where=~gam.held_out(5, 0))
    r = np.random.default_rng(1)  # these labels need no pair, so two are put in
    shape = [len(t) for t in model.tables]
    model = dataclasses.replace(model, pairs=tuple((f, g, r.normal(size=(shape[f], shape[g]))) for f, g in ((3, 0), (11, 5))))
    rows = odd_rows() + [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = gam.scored(frame(spark, rows).select("doc_id", "text"), model)
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i, t].append(plain.gam_score(model, gam.RATIOS, t))
    for r in got.collect():
        assert r.score == pytest.approx(want[r.doc_id, r.text][0], abs=1e-9)
    assert got.count() == len(rows) and len({r.score for r in got.collect()}) > 50


def test_verdicts_equal_a_walk_over_the_rules(spark, corpus):
    docs, labels = corpus
    learned = rules.train_rules(docs, labels)
    rows = odd_rows() + [tuple(r) for r in docs.select("doc_id", "text").collect()]
    judged = rules.judge(frame(spark, rows).select("doc_id", "text"), learned).collect()
    assert learned and len(judged) == len(rows)
    for r in judged:
        c = plain.text_counts(r.text)
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        rule = plain.rule_of(learned, rules.RATIOS, r.text)
        assert (r.base_failed, r.rule, r.kept) == (failed, rule, not failed and rule is None)


def test_languages_equal_a_count_of_grams(spark, corpus):
    docs, _ = corpus
    filters = langid.train(docs, where=~gam.held_out(3, 1))
    rows = odd_rows()[::3] + [tuple(r) for r in docs.select("doc_id", "text").limit(60).collect()]
    got = bag(langid.predicted(frame(spark, rows), filters).selectExpr("doc_id", "lang_pred", "round(score, 9)"))
    assert got == collections.Counter((i, *(round(x, 9) if isinstance(x, float) else x for x in plain.language(filters, t))) for i, t in rows)


def test_filters_hold_what_counting_finds(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdé -") for _ in range(200)), r.choice(["x", "y", None])) for i in range(60)] + [(None, "zzzz", "x"), (99, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.train(docs, min_share=0.001)
    counts = collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if i is not None and lang is not None:
            counts[lang].update(int.from_bytes(g, "big") for g in plain.byte_grams(t))
    sets = {k: [g for g, n in c.items() if n >= 0.001 * sum(c.values())] for k, c in counts.items()}
    want = langid.build(sets, {k: sum(i is not None and g == k for i, _, g in rows) for k in sets})
    assert got.languages == want.languages and (got.table == want.table).all() and (got.false == want.false).all()
    assert (got.share == want.share).all()


def test_ties_repeats_and_clashing_columns_in_languages(spark):
    filters = langid.build({"b": [1], "a": [1]}, {"b": 5, "a": 5})
    rows = [(1, "same text"), (1, "same text"), (2, "other")]
    out = langid.predicted(frame(spark, rows).withColumnRenamed("score", "lang_pred"), filters)
    assert out.columns == ["doc_id", "lang_pred", "score"] and out.count() == 3
    assert {r.lang_pred for r in out.collect()} == {"a"}
    assert langid.predicted(frame(spark, rows).where("false"), filters).count() == 0


def test_token_counts_equal_the_unigram_library(spark, corpus):
    """Whole texts, byte fallback included, against the library's own double-precision model."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    vocabulary = [(model.id_to_piece(i), model.get_score(i) if not (model.is_control(i) or model.is_unknown(i)) else -1e9) for i in range(size)]
    # the bytes' own pieces never win over spelled ones
    vocabulary = [(p, -1e9 if model.is_byte(i) else s) for i, (p, s) in enumerate(vocabulary)]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=model.unk_id(), byte_fallback=True))
    mine = token_counts.load_vocabulary(path)
    rows = [r.text for r in corpus[0].select("text").limit(120).collect() if r.text] + ["漢字 \U0001f600 test", "a  b", " x ", "ünïcode\tand\ttabs"]
    for text in rows:
        marked = ("▁" + text.replace(" ", "▁"))
        assert mine.count(text)[0] == len(library.encode(marked, add_special_tokens=False).ids), text[:80]


def test_very_long_texts(spark):
    rows = list(enumerate(LONG + ["short text of a few words"]))
    docs = frame(spark, rows)
    for r in rules.judge(docs.select("doc_id", "text"), [], drop=("text",)).collect():
        want = plain.text_counts(rows[r.doc_id][1])
        assert {k: r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")} == {
            k: want[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")}
    flat = gam.fit(np.zeros((0, gam.N_FEATURES)), np.zeros(0))
    assert {r.score for r in gam.scored(docs.select("doc_id", "text"), flat).collect()} == {0.5}
    filters = langid.build({"la": [int.from_bytes(b"lore", "big")]}, {"la": 1})
    assert {r.lang_pred for r in langid.predicted(docs, filters).collect()} == {"la"}
    items = [(1, LONG[1][-70:]), (2, "sit amet lorem ipsum dolor sit amet lorem ipsum dolor")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs.select("doc_id", "text"), bench, drop=("text",))
    assert bag(out) == collections.Counter(plain.contamination(rows, items))
    got = shingle_join.near_duplicates(docs, Scratch(spark, "test"))
    assert {r.doc_id: r.n_shingles for r in got.collect()} == {i: len(plain.shingles(t)) for i, t in rows}
    small = token_counts.Vocabulary({"a": -1.0})
    assert small.count("a" * 3_000_000)[0] == 3_000_000 + 1


def test_empty_tables_everywhere(spark, docs_frame):
    none = empty(docs_frame)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    scratch = Scratch(spark, "test")
    assert archive.read(archive.write(pages, scratch)).count() == 0
    assert langid.train(none.selectExpr("doc_id", "text", "'x' AS lang")).languages == ()
    assert pii.digest(none, pii.train_spans(none)).count() == 0
    for out in (hyper_minhash.near_duplicates(none, scratch), repeats.without_repeats(none, scratch),
                collocation.collocations(none.selectExpr("text", "'x' AS lang"), scratch)):
        assert out.count() == 0
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string"), scratch).count() == 0


@pytest.fixture(scope="module")
def docs_frame(spark):
    return frame(spark, odd_rows())


@pytest.mark.parametrize("name", ["op1_gam", "op2_language", "op3_archive", "op5_decontaminate", "op6_quality_rules", "op8_pii",
                                  "op9_suffix_dedup", "op10_token_counts"])
def test_queries_give_a_row_per_document(spark, name):
    out = queries.QUERIES[name](spark, SF)
    table = "pages" if name == "op3_archive" else "documents"
    assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
