"""Readers, sinks and dictionary files."""

import json

import pytest
from pyspark.sql import functions as F

from vacantry.operators import postings as P
from vacantry.sources import tables as IO


def test_postings_from_json_array(spark, tmp_path):
    rows = [{"jobId": "7", "title": "Lead", "languageRequirements": {"required": ["Deutsch"], "niceToHave": ["German", "Italiano"]},
             "workMode": "Hybrid or remote", "descriptionHtml": "<p>Hi&nbsp;all</p>"},
            {"url": "https://www.linkedin.com/jobs/view/99?x", "title": "Dev"}, {"title": "No id"}]
    path = tmp_path / "in.json"
    path.write_text(json.dumps(rows))
    out = P.normalize(IO.read_postings(spark, str(path)))
    got = {r.job_id: r for r in P.accepted(out).collect()}
    assert got["7"].description_text == "Hi all" and got["99"].source == "linkedin"
    assert [(x.language, x.importance) for x in got["7"].languages] == [("German", "required"), ("Italian", "nice_to_have")]
    assert [(m.work_mode, m.is_primary) for m in got["7"].work_modes] == [("hybrid", True), ("remote", False)]
    assert [r.title for r in P.quarantine(out).collect()] == ["No id"]


def test_dictionaries(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"terms": [{"term": "Kubernetes", "aliases": ["K8s"], "kind": "tool"}, {"term": "c++", "aliases": [], "kind": "lang"}]}))
    assert IO.load_vocabulary(str(path), ("rust",)).canonical == {"kubernetes": "kubernetes", "k8s": "kubernetes", "c++": "c++", "rust": "rust"}
    assert sorted((r.term, r.alias, r.kind) for r in IO.dictionary_rows(spark, str(path)).collect()) == [
        ("c++", "c++", "lang"), ("kubernetes", "k8s", "tool"), ("kubernetes", "kubernetes", "tool")]
    fam = tmp_path / "f.json"
    fam.write_text(json.dumps({"families": {"early-career": {"titleTerms": ["intern"], "exemptTerms": ["director"], "summary": "s"}}}))
    families, literals = IO.load_title_families(str(fam), ["Early Career", "Barista"])
    assert families[0].title_terms == ("intern",) and literals == ("barista",)


def test_run_artefact(spark, tmp_path):
    rows = spark.range(3)
    IO.write_run(rows, rows.agg(F.count("*").alias("discovered")), str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run" / "summary")).collect()[0].discovered == 3


def test_rule_tables_in_use_do_not_conflict(spark):
    from vacantry.operators.quality import rule_words, rules_conflicts

    assert rules_conflicts(rule_words(spark)).count() == 0
    edited = rule_words(spark).union(spark.createDataFrame([("stopwords", "Senior"), ("filler_adjectives", "senior"), ("locations", "lead")],
                                                           "section string, word string"))
    assert sorted(map(tuple, rules_conflicts(edited).collect())) == [("filler_adjectives", "senior"), ("stopwords", "senior")]


def test_csv_keeps_bad_records_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,s\n1,x\ntwo,y\n3,"a ""b"", c"\n4\n5,"",extra\n,\n')
    rows, bad = IO.read_csv(spark, str(tmp_path / "a.csv"), "n int, s string")
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, [(1, "x"), (3, 'a "b", c'), (None, None)]))
    assert sorted(r[0] for r in bad.collect()) == ["4", '5,"",extra', "two,y"]


def test_sqlite_ranges_and_filters(spark, tmp_path):
    from vacantry.sources import sqlite

    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN concat('n', id) END AS name", "id / 7.0D AS v").repartition(3)
    path = str(tmp_path / "db")
    assert sqlite.write_sqlite(df, path, "a table") == 3
    got = sqlite.read_sqlite(spark, path, "a table", df.schema, range_rows=100)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    some = got.filter("id >= 990 AND name IS NOT NULL AND v < 142").select("name")
    assert sorted(r.name for r in some.collect()) == [f"n{i}" for i in range(990, 994) if i % 3]
    reader = sqlite.SqliteReader(df.schema, {"path": path, "table": "a table", "rangerows": "100"})
    from pyspark.sql import datasource as ds
    left = list(reader.pushFilters([ds.GreaterThan(("id",), 900), ds.StringContains(("name",), "9"), ds.In(("name",), ("n901", "n902"))]))
    assert len(left) == 1 and len(reader.partitions()) >= 10
    assert sorted(row[0] for p in reader.partitions() for row in reader.read(p)) == [901, 902]
    with pytest.raises(ValueError):
        sqlite.local_path("hdfs://x/y")
    assert sqlite.read_sqlite(spark, path, "a table", "id bigint").filter("id < 0").count() == 0


def test_working_folders_are_cleaned(spark, monkeypatch):
    import os

    from vacantry import session

    monkeypatch.setattr(session, "MADE", [])
    path = session.work_dir(spark, "some")
    spark.range(3).write.parquet(path)
    session.work_dir(spark, "never written")
    local = path.removeprefix("file:")
    assert os.path.isdir(local) and session.clean_work(spark) == 1 and not os.path.exists(local) and session.MADE == []
