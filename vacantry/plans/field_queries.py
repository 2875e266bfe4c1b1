"""Queries: field normalizers and the posting record.

Text columns are built from key arithmetic on the Spark side; each oracle gives the
expected value from the same arithmetic without reading the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantry.functions import fields as N
from vacantry.functions import text as T
from vacantry.operators import postings as P
from vacantry.operators.roles import TitleFamily
from vacantry.plans.registry import query
from vacantry.plans.testbed import text, words

K = "c_custkey"


def cust(t, **columns):
    return t.table("customer").selectExpr(K, *[f"{e} AS {n}" for n, e in columns.items()])


RAW = dict(
    source=words(K, " LinkedIn ", "INDEED", None, "external"),
    jobId=f"CASE {K} % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN ' ' || CAST({K} AS STRING) || ' ' ELSE CAST({K} AS STRING) END",
    url=f"CASE {K} % 5 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || CAST({K} + 7 AS STRING) || '?x=1' END",
    title="c_name", company=words(K, "Acme", "  ", None),
    descriptionHtml=f"'<style>p</style><p>Role&nbsp;' || CAST({K} AS STRING) || ' &amp; more</p><script>x()</script>'",
    location=words(K, "London, England", "Remote", "Dublin (hybrid)", "Berlin - Mitte"),
    country=words(K, "gb", "Germany", "Schweiz", "Atlantis", "", "UK"),
    applicants=f"CASE {K} % 4 WHEN 0 THEN 'Over ' || CAST({K} % 9 + 1 AS STRING) || ',200 applicants' WHEN 1 THEN CAST({K} AS STRING) WHEN 2 THEN 'many' END",
    application_links=words(K, '["https://a.example/1","https://a.example/1"]', "https://b.example/2; https://c.example/3", None),
    requiredLanguages=words(K, "englisch, German", '["Deutsch"]', None, "dutch;FRANÇAIS"),
    niceToHaveLanguages=words(K, "german; italiano", None, "spanish"),
    workMode=words(K, "Remote or Hybrid", "on-site/remote", "office", "somewhere", None),
)


def raw(t):
    return t.table("customer").selectExpr(*[f"{e} AS {n}" for n, e in RAW.items()])


NORM_KEYS = (f"SELECT *, CASE {K} % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'linkedin' ELSE 'external' END AS source, "
             f"CASE WHEN {K} % 5 = 0 THEN CAST({K} + 7 AS STRING) WHEN {K} % 5 = 1 THEN NULL ELSE CAST({K} AS STRING) END AS job_id "
             "FROM customer")


@query("normalized_postings",
       "SELECT source, job_id, CASE WHEN c_custkey % 5 = 0 THEN 'https://www.linkedin.com/jobs/view/' || job_id || '?x=1' "
       "WHEN source = 'linkedin' THEN 'https://www.linkedin.com/jobs/view/' || job_id END AS url, c_name AS title, "
       "CASE WHEN c_custkey % 3 = 0 THEN 'Acme' END AS company, 'Role ' || CAST(c_custkey AS VARCHAR) || ' & more' AS description_text, "
       "CASE c_custkey % 6 WHEN 0 THEN 'GB' WHEN 1 THEN 'DE' WHEN 2 THEN 'CH' WHEN 5 THEN 'UK' END AS country_code, "
       "CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 9 + 1) * 1000 + 200 WHEN 1 THEN c_custkey END AS applicants_count, "
       "CASE c_custkey % 3 WHEN 0 THEN 'https://a.example/1' WHEN 1 THEN 'https://b.example/2 https://c.example/3' ELSE "
       "CASE WHEN c_custkey % 5 = 0 THEN 'https://www.linkedin.com/jobs/view/' || job_id || '?x=1' "
       "WHEN source = 'linkedin' THEN 'https://www.linkedin.com/jobs/view/' || job_id ELSE '' END END AS links, '3' AS taxonomy_version "
       "FROM n WHERE job_id IS NOT NULL", n=NORM_KEYS)
def _(t):
    rows = P.accepted(P.normalize(raw(t)))
    return rows.select("source", "job_id", "url", "title", "company", "description_text", "country_code",
                       "applicants_count", F.array_join("application_links", " ").alias("links"), "taxonomy_version")


@query("quarantined_postings", "SELECT source, c_name AS title FROM n WHERE job_id IS NULL", n=NORM_KEYS)
def _(t):
    return P.quarantine(P.normalize(raw(t))).select("source", "title")


LANGS = ("SELECT *, CASE c_custkey % 4 WHEN 0 THEN ['English', 'German'] WHEN 1 THEN ['German'] WHEN 2 THEN CAST([] AS VARCHAR[]) "
         "ELSE ['Dutch', 'French'] END AS must, CASE c_custkey % 3 WHEN 0 THEN ['German', 'Italian'] WHEN 1 THEN CAST([] AS VARCHAR[]) "
         "ELSE ['Spanish'] END AS nice FROM n")


@query("posting_languages",
       "SELECT source, job_id, language, 'required' AS importance FROM (SELECT source, job_id, unnest(must) AS language FROM l) a "
       "WHERE job_id IS NOT NULL UNION ALL SELECT source, job_id, language, 'nice_to_have' FROM (SELECT source, job_id, must, "
       "unnest(nice) AS language FROM l) b WHERE job_id IS NOT NULL AND NOT list_contains(must, language)", n=NORM_KEYS, l=LANGS)
def _(t):
    return P.language_table(P.accepted(P.normalize(raw(t))))


@query("posting_work_modes",
       "SELECT source, job_id, m AS work_mode, m = modes[1] AS is_primary FROM (SELECT source, job_id, modes, unnest(modes) AS m FROM ("
       "SELECT *, CASE c_custkey % 5 WHEN 0 THEN ['remote', 'hybrid'] WHEN 1 THEN ['onsite', 'remote'] WHEN 2 THEN ['onsite'] "
       "ELSE CAST([] AS VARCHAR[]) END AS modes FROM n) a) b WHERE job_id IS NOT NULL", n=NORM_KEYS)
def _(t):
    return P.work_mode_table(P.accepted(P.normalize(raw(t))))


@query("normalized_confidence",
       "SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal <= 1 THEN c_acctbal WHEN c_acctbal > 1 AND c_acctbal <= 100 "
       "THEN c_acctbal / 100 END AS confidence FROM customer")
def _(t):
    return t.table("customer").select(K, N.confidence(F.col("c_acctbal").cast("string")).alias("confidence"))


@query("inferred_work_modes",
       "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'remote,hybrid,onsite' WHEN 3 THEN 'onsite' "
       "ELSE '' END AS modes, CASE c_custkey % 5 WHEN 1 THEN 'hybrid' WHEN 2 THEN 'remote,hybrid' WHEN 3 THEN 'onsite' ELSE '' END AS card_modes FROM customer")
def _(t):
    rows = cust(t, loc=words(K, "Work from home", "Hybrid", "Remote / hybrid / on-site", "Onsite", "Leeds"))
    none = F.lit(None).cast("string")
    return rows.select(
        K, F.array_join(N.inferred_work_modes(none, F.col("loc"), none), ",").alias("modes"),
        F.array_join(N.listing_work_modes(F.col("loc"), F.lit("")), ",").alias("card_modes"))


@query("inferred_places",
       "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'London' WHEN 3 THEN 'Berlin' WHEN 4 THEN 'Aarhus' END AS city, "
       "CASE c_custkey % 6 WHEN 0 THEN 'GB' WHEN 1 THEN 'IE' WHEN 2 THEN 'NL' WHEN 4 THEN 'DK' WHEN 5 THEN 'GB' END AS country, "
       "CASE c_custkey % 4 WHEN 0 THEN 'GB' WHEN 1 THEN 'US' WHEN 2 THEN 'CH' END AS host_country FROM customer")
def _(t):
    rows = cust(t, loc=words(K, "London, UK", "Remote Ireland", "The Netherlands remote", "Berlin - Mitte", "Aarhus (Denmark)", "United Kingdom"),
                url=words(K, "https://uk.indeed.com/viewjob?jk=1", "https://www.indeed.com/x", "http://ch.indeed.com", "https://example.com/uk."))
    return rows.select(K, N.city_of(F.col("loc")).alias("city"), N.country_of_location(F.col("loc")).alias("country"),
                       N.country_of_host(N.host_of(F.col("url"))).alias("host_country"))


@query("companies_from_links",
       "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Acme Labs ' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'Big Co' WHEN 2 THEN "
       "'Deep Mind' WHEN 3 THEN 'Mega' ELSE '' END AS from_url, CASE c_custkey % 4 WHEN 0 THEN 'Initech ' || CAST(c_custkey AS VARCHAR) "
       "WHEN 1 THEN 'Hooli' ELSE '' END AS from_title FROM customer")
def _(t):
    rows = cust(t, url=f"CASE {K} % 6 WHEN 0 THEN 'https://jobs.lever.co/acme-labs-' || CAST({K} AS STRING) || '/9' "
                       "WHEN 1 THEN 'https://boards.greenhouse.io/big_co/jobs/1' WHEN 2 THEN 'https://jobs.ashbyhq.com/DeepMind?x' "
                       "WHEN 3 THEN 'https://mega-wd5.myworkdayjobs.com/en' WHEN 4 THEN 'https://example.com/acme' ELSE 'not a link' END",
                page=f"CASE {K} % 4 WHEN 0 THEN 'Data Lead - Initech ' || CAST({K} AS STRING) WHEN 1 THEN 'Data Lead at Hooli' "
                     "WHEN 2 THEN 'Data Lead | Job board' ELSE '' END")
    return rows.select(K, N.company_of_url(F.col("url")).alias("from_url"),
                       N.company_of_title(F.col("page"), F.lit("Data Lead"), 120).alias("from_title"))


@query("split_cards",
       "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'acme' WHEN 1 THEN 'acme' WHEN 2 THEN 'plain' WHEN 3 THEN 'CognicoLondon,' END AS company, "
       "CASE c_custkey % 5 WHEN 0 THEN 'Leeds Bradford, England' WHEN 1 THEN 'Remote now' WHEN 3 THEN 'England' END AS location, "
       "CASE c_custkey % 3 WHEN 0 THEN 'Data Lead ' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'Engineer' ELSE 'Just a title' END AS title, "
       "CASE c_custkey % 3 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Hooli' END AS title_company, CASE c_custkey % 3 WHEN 0 THEN 'Leeds' END AS title_location "
       "FROM customer")
def _(t):
    rows = cust(t, card=words(K, "acmeLeeds Bradford, England", "acme Remote now", "plain", "CognicoLondon, England", None),
                page=f"CASE {K} % 3 WHEN 0 THEN 'Acme hiring Data Lead ' || CAST({K} AS STRING) || ' in Leeds | LinkedIn' "
                     "WHEN 1 THEN 'Engineer | Hooli | LinkedIn' ELSE 'Just a title' END")
    split, meta = N.company_and_location(F.col("card")), N.title_meta(F.col("page"))
    return rows.select(K, split["company"].alias("company"), split["location"].alias("location"),
                       meta["title"].alias("title"), meta["company"].alias("title_company"),
                       meta["location"].alias("title_location"))


@query("role_reports",
       "SELECT source, job_id, label AS role_label, raw AS raw_label, raw IN ('Primary role', 'Conditional', 'Out of scope', 'Unclassified', "
       "'Data-domain stretch') AS is_valid, raw IN ('adjacent-role', 'LEADERSHIP PROGRESSION') AS is_canonicalized, "
       "CASE CAST(job_id AS BIGINT) % 3 WHEN 0 THEN 'Matches title Evidence: a, b.' WHEN 1 THEN 'plain reason' ELSE "
       "CASE WHEN raw IS NULL THEN 'Unclassified because no role label was recorded. No role classification reason recorded; reclassification is required.' "
       "WHEN label = 'Unclassified' THEN 'Unclassified because stored role label \"' || raw || '\" is not recognized by the adjacent-role taxonomy; reclassification is required.' "
       "WHEN label <> raw THEN 'Legacy role label \"' || raw || '\" normalized to \"' || label || '\"; detailed JD reason unavailable, so reclassification is recommended.' "
       "ELSE label || ' classification has no detailed JD reason recorded; verify the full JD before applying.' END END AS reason_text, "
       "CASE WHEN coalesce(trim(description_text), '') <> '' THEN 'full-JD' ELSE 'provisional' END AS stage FROM (SELECT *, nullif(role_label, '') AS raw, "
       "CASE nullif(role_label, '') WHEN 'Primary role' THEN 'Primary role' WHEN 'adjacent-role' THEN 'Adjacent role' WHEN 'LEADERSHIP PROGRESSION' THEN "
       "'Leadership progression' WHEN 'Conditional' THEN 'Conditional' WHEN 'Out of scope' THEN 'Out of scope' WHEN 'Data-domain stretch' THEN "
       "'Data-domain stretch' ELSE 'Unclassified' END AS label FROM postings) s", ("postings",))
def _(t):
    r = N.role_report(F.col("role_label"), F.col("role_reason"), F.col("description_text"))
    # a missing label is neither valid nor invalid in the oracle
    return t.postings.select("source", "job_id", r.alias("r")).select(
        "source", "job_id", "r.role_label", "r.raw_label",
        F.when(F.col("r.raw_label").isNotNull(), F.col("r.is_valid")).alias("is_valid"),
        F.when(F.col("r.raw_label").isNotNull(), F.col("r.is_canonicalized")).alias("is_canonicalized"),
        "r.reason_text", "r.stage")


@query("slugs_and_labels",
       "SELECT p_partkey, rtrim(substr(trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 1, 32)) AS slug, "
       "CASE p_partkey % 3 WHEN 0 THEN '£' || CAST(p_partkey AS VARCHAR) || ' a year' END AS pay, "
       "CASE p_partkey % 2 WHEN 0 THEN 'https://jobs.example/' || CAST(p_partkey AS VARCHAR) ELSE 'https://plain.example' END AS target FROM part")
def _(t):
    rows = t.table("part").selectExpr(
        "p_partkey", "p_name || ' / ' || p_brand AS title",
        "CASE p_partkey % 3 WHEN 0 THEN '  £' || CAST(p_partkey AS STRING) || '  a   year' WHEN 1 THEN 'Salary  Guide' ELSE ' ' END AS pay",
        "CASE p_partkey % 2 WHEN 0 THEN 'https://www.linkedin.com/safety?url=https%3A%2F%2Fjobs.example%2F' || CAST(p_partkey AS STRING) || '&t=1' "
        "ELSE 'https://plain.example' END AS link")
    return rows.select("p_partkey", T.slug(F.col("title")).alias("slug"), N.salary_label(F.col("pay")).alias("pay"),
                       N.link_target(F.col("link")).alias("target"))


@query("listing_stubs",
       "SELECT substr(sha1(url), 1, 20) AS job_id, url, title, company, country_code, role_label, role_confidence FROM (SELECT *, row_number() OVER "
       "(PARTITION BY url ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM (SELECT *, 'https://jobs.lever.co/acme-' || CAST(l_suppkey AS VARCHAR) || '/' || "
       "CAST(l_partkey AS VARCHAR) AS url, 'Data Engineer ' || CAST(l_partkey AS VARCHAR) AS title, 'Acme ' || CAST(l_suppkey AS VARCHAR) AS company, "
       "CASE l_partkey % 3 WHEN 0 THEN 'GB' WHEN 1 THEN 'IE' END AS country_code, 'Primary role' AS role_label, 0.65 AS role_confidence FROM lineitem "
       "WHERE l_suppkey % 4 IN (0, 1) AND l_returnflag <> 'R') u) t WHERE rn = 1")
def _(t):
    # quarters of the suppliers: two portals, a job board, an unrelated site; returned lines are excluded roles
    results = t.table("lineitem").selectExpr(
        "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ordinal",
        f"CASE l_suppkey % 4 WHEN 2 THEN 'https://www.linkedin.com/jobs/view/' || {text('l_partkey')} WHEN 3 THEN 'https://blog.example/' || {text('l_partkey')} "
        f"ELSE 'https://jobs.lever.co/acme-' || {text('l_suppkey')} || '/' || {text('l_partkey')} END AS url",
        f"CASE WHEN l_returnflag = 'R' THEN 'Data Engineer intern ' ELSE 'Data Engineer ' END || {text('l_partkey')} AS title",
        "'we hire' AS content", "'data engineer' AS query", f"{words('l_partkey', 'London, United Kingdom', 'Ireland', 'Mars')} AS location")
    from vacantry.operators.roles import Taxonomy
    tax = Taxonomy(primary=("data engineer",), families=(TitleFamily("early", ("intern",)),))
    # returned lines share links with others, so their exclusion happens before the dedup
    return P.listings(results, tax).select("job_id", "url", "title", "company", "country_code", "role_label", "role_confidence")
