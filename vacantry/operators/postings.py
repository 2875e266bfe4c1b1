"""Raw postings in any spelling to normalized rows and child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantry.functions import fields as N
from vacantry.functions.text import blank_to_null, first_non_blank, strip_html
from vacantry.operators.roles import Taxonomy, classify
from vacantry.operators.selection import JOB

# accepted spellings of each raw field, in order of preference
SPELLINGS = {
    "job_id": ["job_id", "jobId", "linkedinJobId", "id"],
    "description_raw": ["descriptionRaw", "description_raw", "descriptionHtml", "description_html",
                        "description"],
    "description_text": ["descriptionText", "description_text"],
    "applicants_raw": ["applicantsRaw", "applicants_raw", "applicants"],
    "applicants_count": ["applicantsCount", "applicants_count"],
    "location_raw": ["locationRaw", "location_raw", "location"],
    "country": ["countryCode", "country_code", "country"],
    "job_posting_date": ["jobPostingDate", "job_posting_date"],
    "application_links": ["applicationLinks", "application_links"],
    "required_languages": ["requiredLanguages", "required_languages"],
    "nice_languages": ["niceToHaveLanguages", "nice_to_have_languages"],
    "work_modes": ["workModes", "work_modes", "jobWorkModes", "job_work_modes"],
    "work_mode": ["workMode", "work_mode"],
    "recruiter_email": ["recruiterEmail", "recruiter_email"],
    "recruiter_profile_link": ["recruiterProfileLink", "recruiter_profile_link"],
    "searched_keywords": ["searchedKeywords", "searched_keywords"],
    "searched_location": ["searchedLocation", "searched_location"],
    "language_reason": ["languageFilterReason", "language_filter_reason"],
    "work_mode_reason": ["workModeReason", "work_mode_reason"],
    "taxonomy_version": ["roleTaxonomyVersion", "role_taxonomy_version"],
}
PLAIN = ["source", "url", "title", "company", "region", "city", "recruiter"]
ALL_SPELLINGS = sorted({s for names in SPELLINGS.values() for s in names} | set(PLAIN))


def unify_spellings(raw: DataFrame) -> DataFrame:
    """One column per field from whichever spellings the input has."""
    have = {c.lower(): c for c in raw.columns}

    def pick(names):
        found = [F.col(f"`{have[n.lower()]}`").cast("string")
                 for n in dict.fromkeys(names) if n.lower() in have]
        # camelCase and snake_case columns stay distinct only when both exist
        found = list({str(c): c for c in found}.values())
        return first_non_blank(*found) if found else F.lit(None).cast("string")

    return raw.select(*[pick(names).alias(out) for out, names in SPELLINGS.items()],
                      *[pick([name]).alias(name) for name in PLAIN])


def normalize(raw: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
    """Normalized postings; rows without any id have a NULL job_id (see ``quarantine``)."""
    rows = unify_spellings(raw)
    source = N.source_name(F.col("source"))
    rows = rows.withColumn("source", source).withColumn(
        "job_id", N.posting_id(F.col("job_id"), url=F.col("url")))
    rows = rows.withColumn("url", N.default_url(F.col("source"), F.col("job_id"), F.col("url")))
    text = strip_html(F.coalesce(F.col("description_text"), strip_html(F.col("description_raw"))))
    out = rows.select(
        *JOB, "url", "title", "company", "description_raw", text.alias("description_text"),
        "location_raw", N.country_code(F.col("country")).alias("country_code"), "region", "city",
        "job_posting_date", "applicants_raw",
        N.applicant_count(F.coalesce("applicants_count", "applicants_raw")).alias("applicants_count"),
        N.application_links(F.col("application_links"), F.col("url")).alias("application_links"),
        "recruiter", "recruiter_email", "recruiter_profile_link", "language_reason", "work_mode_reason",
        "searched_keywords", "searched_location",
        N.language_rows(F.col("required_languages"), F.col("nice_languages")).alias("languages"),
        N.work_mode_rows(F.col("work_modes"), F.col("work_mode")).alias("work_modes"),
        F.coalesce("taxonomy_version", F.lit("3")).alias("taxonomy_version"),
    )
    return classify(out, taxonomy) if taxonomy is not None else out


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("job_id").isNotNull())


def quarantine(rows: DataFrame) -> DataFrame:
    """Rows that carry no id and cannot be stored."""
    return rows.filter(F.col("job_id").isNull())


def language_table(rows: DataFrame) -> DataFrame:
    return rows.select(*JOB, F.explode("languages").alias("x")).select(*JOB, "x.language", "x.importance")


def work_mode_table(rows: DataFrame) -> DataFrame:
    return rows.select(*JOB, F.explode("work_modes").alias("x")).select(*JOB, "x.work_mode", "x.is_primary")


def listings(results: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Search results to posting stubs: relevant portals only, one per link.

    ``results`` has ordinal, url, title, content, query, location.
    """
    from vacantry.functions.keys import url_job_id
    from vacantry.operators.roles import portal_relevant, retain_provisional
    from vacantry.operators.selection import first_seen

    host = N.host_of(F.col("url"))
    kept = results.filter(portal_relevant(F.col("url"), F.concat_ws(" ", "title", "content", "url")))
    rows = retain_provisional(classify(kept, taxonomy, "title", "content", F.lit(True)))
    stubs = first_seen(rows, ["url"], "ordinal")
    named = N.company_of_url(F.col("url"))
    return stubs.select(
        F.lit("external").alias("source"), url_job_id(F.col("url")).alias("job_id"), "url",
        F.coalesce(blank_to_null(F.trim("title")), F.col("query")).alias("title"),
        F.when(named != "", named).otherwise(host).alias("company"),
        F.col("content").alias("description_raw"), F.lit("").alias("description_text"),
        F.col("location").alias("location_raw"),
        N.country_of_location(F.col("location")).alias("country_code"), "role_label", "role_confidence",
        F.col("query").alias("searched_keywords"), F.col("location").alias("searched_location"),
        F.lit("saved").alias("application_status"))


def compact(rows: DataFrame) -> DataFrame:
    """Report envelope: the identifying facts plus the rest as one struct."""
    facts = [c for c in ("source", "job_id", "title", "company", "url") if c in rows.columns]
    extra = [c for c in ("country_code", "city", "role_label", "role_confidence", "language_reason")
             if c in rows.columns]
    return rows.select(*facts, F.struct(*extra).alias("details"))
