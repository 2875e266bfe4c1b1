"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the docs of the
next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantry.llm import decontaminate, packing, pii, rules, shingle_join
from vacantry.llm.labelled import quoted
from vacantry.llm.queries import byte_vocabulary, table
from vacantry.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the learned decision list."""
    return rules.keep_good(docs, rules.train_rules(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest id."""
    return shingle_join.one_of_each(docs, Scratch(spark, "pipeline-near"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~quoted(out.columns[-1])[0]).select(*quoted(*docs.columns))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their text replaced by its kind."""
    return pii.redact(docs, pii.train_spans(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.packed(docs, Scratch(spark, "pipeline-pack"), **byte_vocabulary())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontaminated),
          ("pii", private_data), ("packing", packed)]

ORACLE_SQL = None  # learned rules and spans have no SQL form; tests/llm compares each stage with plain code


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
