"""Queries: rows of the test tables written to a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantry.plans.registry import query
from vacantry.session import work_dir
from vacantry.sources import sqlite
from vacantry.sources import tables as IO

COLUMNS = ("source", "job_id", "title", "company", "created_at")
SQL = "SELECT source, job_id, title, company, created_at FROM postings"


@query("orc_postings", SQL, ("postings",))
def _(t):
    return IO.orc_roundtrip(t.postings.select(*COLUMNS), work_dir(t.spark, "orc"))


def postings_csv(t):
    """Postings as CSV, of which every seventh order has a date that is none."""
    path = work_dir(t.spark, "csv")
    when = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    rows = t.postings.withColumn("created_at", F.when(F.col("posting_key") % 7 == 0, F.lit("soon")).otherwise(when))
    title = F.concat(F.lit('"'), "title", F.lit('", '), "job_id")  # quotes and commas inside a value
    IO.write_csv(rows.select("source", "job_id", title.alias("title"), "company", "created_at"), path)
    return IO.read_csv(t.spark, path, "source string, job_id string, title string, company string, created_at timestamp")


@query("csv_postings",
       "SELECT source, job_id, '\"' || title || '\", ' || job_id AS title, company, created_at FROM postings WHERE posting_key % 7 <> 0", ("postings",))
def _(t):
    return postings_csv(t)[0]


@query("csv_bad_records",
       "SELECT source || ',' || job_id || ',\"\"\"' || title || '\"\", ' || job_id || '\",' || company || ',soon' AS record FROM postings WHERE posting_key % 7 = 0",
       ("postings",))
def _(t):
    return postings_csv(t)[1].select(F.col(IO.CORRUPT).alias("record"))


@query("sqlite_postings",
       "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')")
def _(t):
    path = work_dir(t.spark, "sqlite")
    rows = t.table("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    sqlite.write_sqlite(rows.repartition(4, "c_custkey"), path, "customer")
    stored = sqlite.read_sqlite(t.spark, path, "customer", rows.schema, range_rows=500)
    return stored.filter("c_acctbal >= 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')")


@query("dictionary_terms",
       "SELECT lower(name) AS term, lower(alias) AS alias, p_type AS kind FROM (SELECT p_name || '|' || CAST(p_partkey AS VARCHAR) AS name, "
       "unnest([p_name || '|' || CAST(p_partkey AS VARCHAR), p_brand || '|' || CAST(p_partkey AS VARCHAR)]) AS alias, p_type FROM part) p")
def _(t):
    """Vocabulary documents of a hundred terms each, one per line, read back as rows."""
    term = F.struct(F.concat_ws("|", "p_name", F.col("p_partkey").cast("string")).alias("term"),
                    F.array(F.concat_ws("|", "p_brand", F.col("p_partkey").cast("string"))).alias("aliases"), F.col("p_type").alias("kind"))
    path = work_dir(t.spark, "dictionary")
    t.table("part").groupBy(F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.collect_list(term).alias("terms")).select(
        "terms").write.json(path)
    return IO.dictionary_rows(t.spark, path, lines=True)
