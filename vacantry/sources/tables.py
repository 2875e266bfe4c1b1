"""Readers and sinks: parquet, JSON, NDJSON and dictionary files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vacantry import schemas
from vacantry.operators.postings import ALL_SPELLINGS


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages; fetching is someone else's job."""
    return read_table(spark, path, schemas.PAGES)


def raw_posting_schema() -> StructType:
    """Every accepted spelling as text, so nothing is inferred from a batch."""
    fields = [StructField(n, StringType()) for n in ALL_SPELLINGS]
    nested = StructType([StructField("required", StringType()), StructField("niceToHave", StringType())])
    return StructType(fields + [StructField("languageRequirements", nested)])


def read_postings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Raw postings from JSON: one object, an array of objects, or one object per line.

    ``lines`` splits big files over tasks; whole-document files are read one per task.
    """
    conf = spark.read.schema(raw_posting_schema())
    rows = conf.json(path, multiLine=not lines)
    return (
        rows.withColumn("requiredLanguages", F.coalesce(
            "languageRequirements.required", "requiredLanguages"))
        .withColumn("niceToHaveLanguages", F.coalesce(
            "languageRequirements.niceToHave", "niceToHaveLanguages"))
        .drop("languageRequirements")
    )


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object per row; NULL fields are left out."""
    df.write.mode("errorifexists").json(path)


def write_run(discovered: DataFrame, summary: DataFrame, path: str) -> None:
    """Run artefact: the discovered rows and their one-row summary."""
    write_ndjson(discovered, f"{path}/discovered")
    write_ndjson(summary, f"{path}/summary")


def json_roundtrip(df: DataFrame, path: str) -> DataFrame:
    """Rows written as NDJSON and read back with their own schema."""
    write_ndjson(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, one line per row; quotes inside values are doubled."""
    df.write.csv(path, header=True, quote='"', escape='"', timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", emptyValue='""')


CORRUPT = "_corrupt"


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad records) of CSV files with a header, read with an explicit schema.

    A record is a line.  One with a value that its column cannot hold, or with too many or too few fields, is no row
    but appears as it was written, in ``_corrupt``, among the bad ones.
    """
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*kinds.fields, StructField(CORRUPT, StringType())])
    parsed = F.from_csv("value", full, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"', "emptyValue": "",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    lines = spark.read.text(path).filter(~F.col("value").isin("", ",".join(kinds.names)))
    records = lines.select(parsed.alias("r")).select("r.*")
    return records.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), records.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def orc_roundtrip(df: DataFrame, path: str) -> DataFrame:
    """Rows written as ORC and read back with their own schema."""
    df.write.orc(path)
    return df.sparkSession.read.schema(df.schema).orc(path)


# -- dictionaries ----------------------------------------------------------
def load_vocabulary(path: str, extra_terms=()):
    """Requirement vocabulary from a JSON file with ``terms``: a job parameter."""
    from vacantry.operators.requirements import Vocabulary

    with open(path, encoding="utf-8") as f:
        return Vocabulary.of(json.load(f)["terms"], extra_terms)


def load_title_families(path: str, selected: list[str]):
    """(families, literal phrases) chosen by name from a JSON file with ``families``."""
    from vacantry.operators.roles import TitleFamily

    with open(path, encoding="utf-8") as f:
        known = json.load(f)["families"]
    families, literals = [], []
    for entry in selected:
        name = "-".join(entry.lower().split())
        if name in known:
            spec = known[name]
            families.append(TitleFamily(name, tuple(spec["titleTerms"]), tuple(spec.get("exemptTerms", [])),
                                        spec.get("summary") or "excluded title family"))
        else:
            literals.append(entry.lower())
    return tuple(families), tuple(literals)


def dictionary_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(term, alias, kind) rows of vocabulary files, for joins and audits.

    A file is one document with ``terms``, or with ``lines`` one such document per line, which splits over tasks.
    """
    schema = "terms array<struct<term:string,aliases:array<string>,kind:string>>"
    terms = spark.read.schema(schema).json(path, multiLine=not lines).select(F.explode("terms").alias("t"))
    spellings = F.array_distinct(F.concat(F.array("t.term"), F.coalesce("t.aliases", F.array().cast("array<string>"))))
    return terms.select(F.lower("t.term").alias("term"), F.explode(spellings).alias("alias"), "t.kind").withColumn(
        "alias", F.lower("alias"))
