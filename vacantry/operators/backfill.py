"""Backfill of postings from stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.functions import pages as H
from vacantry.functions.fields import company_of_title, company_of_url
from vacantry.functions.text import blank_to_null, cut
from vacantry.operators.selection import JOB
from vacantry.operators.store import last_rows

MIN_CHARS = 200


def extract(rows: DataFrame, max_raw: int | None = None, max_text: int | None = None,
            max_title: int | None = None, max_company: int | None = None) -> DataFrame:
    """Adds title, company, description and failure found in each row's page.

    ``rows`` has url, html, old_title, old_company, searched_keywords.  Whole pages and
    whole texts are used unless a size is given.  A text under 200 characters is a
    failure and leaves the posting as it was.
    """
    html, url = F.col("html"), F.col("url")
    staged = rows.withColumn("_posting", H.find_job_posting(H.json_ld(html)))
    posting = F.col("_posting")
    staged = staged.withColumn("_page_title", F.coalesce(
        blank_to_null(H.page_title(html)), H.meta(html, "og:title")))
    staged = staged.withColumn("_text", H.page_description(posting, html))
    text = cut(F.col("_text"), max_text)
    org = F.coalesce(F.try_variant_get(posting, "$.hiringOrganization.name", "string"),
                     F.when(F.schema_of_variant(F.try_variant_get(posting, "$.hiringOrganization", "variant"))
                            == "STRING", F.try_variant_get(posting, "$.hiringOrganization", "string")))
    page = F.col("_page_title")
    company = F.coalesce(
        blank_to_null(F.trim(org)), blank_to_null(company_of_url(url)),
        blank_to_null(company_of_title(page, F.col("old_title"))),
        blank_to_null(H.meta(html, "og:site_name")))
    wanted = F.lower(F.trim(F.split(F.coalesce("searched_keywords", F.lit("")), ";", 2)[0]))

    def not_query(c):
        return F.when(F.lower(F.trim(c)) != wanted, blank_to_null(F.trim(c)))

    title = F.coalesce(not_query(F.try_variant_get(posting, "$.title", "string")),
                       not_query(F.col("old_title")), not_query(page))
    chars = F.length(text)
    ok = chars >= MIN_CHARS
    return staged.select(
        *rows.columns,
        F.when(ok, cut(title, max_title)).alias("new_title"),
        F.when(ok, cut(company, max_company)).alias("new_company"),
        F.when(ok, cut(html, max_raw)).alias("description_raw"),
        F.when(ok, text).alias("description_text"), ok.alias("ok"),
        F.when(~ok, F.concat(F.lit("backfill-failed: description too short ("), chars.cast("string"),
                             F.lit(" chars)"))).alias("failure"))


def apply_backfill(postings: DataFrame, extracted: DataFrame, *order: Column) -> DataFrame:
    """Postings after a backfill; blank findings keep the old title and company.

    Of several findings for a posting the last by ``order`` counts.
    """
    extracted = last_rows(extracted, JOB, *order)
    new = extracted.select(*JOB, "new_title", "new_company", F.col("description_text").alias("_text"),
                           "ok", "failure")
    return postings.join(new, JOB, "left").withColumn(
        "title", F.coalesce("new_title", "title")).withColumn(
        "company", F.coalesce("new_company", "company")).withColumn(
        "description_text", F.coalesce("_text", "description_text")).withColumn(
        "language_reason", F.when(F.col("ok"), F.lit(None).cast("string")).otherwise(
            F.coalesce("failure", "language_reason"))).drop(
        "new_title", "new_company", "_text", "ok", "failure")
