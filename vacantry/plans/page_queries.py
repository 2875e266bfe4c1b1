"""Queries: stored pages, text extraction and market-benchmark extractors.

Pages are taken whole; templated blocks built from page_id are appended where the test
pages lack the structure an operator reads.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantry.functions import pages as H
from vacantry.functions.text import html_to_text, squeeze, text_lines
from vacantry.operators import backfill
from vacantry.operators import extractors as E
from vacantry.operators.aggregates import run_status
from vacantry.plans.registry import query
from vacantry.plans.testbed import choose, text, words

P = "page_id"
ENTITIES = ("('&nbsp;', ' '), ('&amp;', '&'), ('&lt;', '<'), ('&gt;', '>'), ('&quot;', '\"')")


def page(t, **columns):
    return t.table("pages").selectExpr(P, "url", "html", *[f"{e} AS {n}" for n, e in columns.items()])


def duck_decode(x: str) -> str:
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                          ("&apos;", "''"), ("&pound;", "£"), ("&euro;", "€")):
        x = f"replace({x}, '{entity}', '{plain}')"
    return x


def duck_text(x: str) -> str:
    for tag in ("script", "style", "noscript"):
        x = f"regexp_replace({x}, '<{tag}\\b.*?</{tag}>', ' ', 'gis')"
    x = f"regexp_replace({x}, '</(?:h[1-6]|p|div|li|ul|ol|br|tr|td|th|table|section|article|header|footer|aside|nav|main)>', chr(10), 'gi')"
    x = duck_decode(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
    x = f"regexp_replace({x}, '[ \\t\\r\\f\\v]+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '\\n\\s+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query("page_text", f"SELECT page_id, md5({duck_text('html')}) AS digest, CAST(length({duck_text('html')}) AS BIGINT) AS chars FROM pages")
def _(t):
    body = html_to_text(F.col("html"))
    return page(t).withColumn("body", body).select(P, F.md5("body").alias("digest"), F.length("body").cast("bigint").alias("chars"))


@query("page_titles",
       f"SELECT page_id, trim({duck_decode('''regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '<[^>]+>', ' ', 'g')''')}) AS title, "
       "CASE page_id % 3 WHEN 0 THEN 'Acme & Sons' WHEN 1 THEN 'Hooli' ELSE '' END AS site FROM pages")
def _(t):
    extra = words(P, '<meta property="og:site_name" content="Acme &amp; Sons">', "<META content='Hooli' name='og:site_name' />", "")
    rows = page(t, doc=f"html || {extra}")
    return rows.select(P, H.page_title(F.col("html")).alias("title"), H.meta(F.col("doc"), "og:site_name").alias("site"))


LONG = "repeat('We build useful things for people. ', 10)"
PAGE_LD = choose(
    P,
    f"'<script type=\"application/ld+json\">{{\"@type\":\"WebPage\"}}</script><script type=\"application/ld+json\">{{\"@graph\":[{{\"@type\":\"Person\"}},{{\"@type\":\"JobPosting\",\"title\":\"Data Lead ' || {text(P)} || '\",\"description\":\"&lt;p&gt;' || {LONG} || '&lt;/p&gt;\",\"hiringOrganization\":{{\"name\":\"Acme\"}}}}]}}</script>'",
    f"'<script type=''application/ld+json''>[{{\"@type\":[\"JobPosting\"],\"title\":\"data lead\",\"description\":\"short\",\"hiringOrganization\":\"Hooli\"}}]</script>'",
    "'<script type=\"application/ld+json\">{broken</script>'", "''")


@query("page_job_postings",
       "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Data Lead ' || CAST(page_id AS VARCHAR) ELSE 'data lead' END AS title FROM pages WHERE page_id % 4 < 2")
def _(t):
    rows = page(t, doc=f"html || {PAGE_LD}").withColumn("posting", H.find_job_posting(H.json_ld(F.col("doc"))))
    return rows.select(P, F.try_variant_get("posting", "$.title", "string").alias("title")).filter(F.col("title").isNotNull())


@query("page_backfill",
       "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Data Lead ' || CAST(page_id AS VARCHAR) WHEN 1 THEN NULL ELSE 'Old title' END AS new_title, "
       "CASE page_id % 4 WHEN 0 THEN 'Acme' END AS named_company, page_id % 4 <> 1 AS ok, CASE page_id % 4 WHEN 1 THEN "
       "'backfill-failed: description too short (5 chars)' END AS failure FROM pages")
def _(t):
    rows = page(t, doc=f"html || {PAGE_LD} || '<p>' || {LONG} || '</p>'").select(
        P, F.col("url"), F.col("doc").alias("html"), F.lit("Old title").alias("old_title"), F.lit(None).cast("string").alias("old_company"),
        F.lit("data lead; other").alias("searched_keywords"))
    out = backfill.extract(rows, max_title=300, max_company=200)
    return out.select(P, "new_title", F.when(F.col("new_company") == "Acme", F.col("new_company")).alias("named_company"), "ok", "failure")


CARD = (f"'<h1 class=\"top-card-layout__title\">Data Lead ' || {text(P)} || '</h1><a class=\"topcard__org-name-link\" href=\"x\"> Acme </a>"
        f"<span class=\"' || {words(P, 'topcard__flavor--bullet', 'job-location')} || '\">Leeds</span><b>' || "
        + words(P, '<i class="num-applicants__figure">12</i>', "Over 34 applicants", "5 applicants have applied", "")
        + " || '</b><div class=\"description__text\">Good <b>work</b>\n here</div>' || "
        + words(P, '<a class="apply-link" href="https://a.example/1">', '<a class="apply-button" href="#">', "")
        + " || '<span class=\"hirer-name\">Jo Roe</span><a href=\"mailto:jo@acme.example\">mail</a><time class=\"posted-date\">Posted on 2025-04-15</time>'")


@query("page_fields",
       "SELECT page_id, 'Data Lead ' || CAST(page_id AS VARCHAR) AS title, 'Acme' AS company, 'Leeds' AS location, CAST(CASE page_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 34 "
       "WHEN 2 THEN 5 END AS BIGINT) AS applicants, 'Good work here' AS description, 'Jo Roe' AS recruiter, 'jo@acme.example' AS recruiter_email, "
       "'Posted on 2025-04-15' AS posting_date, CASE page_id % 3 WHEN 0 THEN 'https://a.example/1' ELSE '' END AS links FROM pages")
def _(t):
    rows = page(t, doc=f"html || {CARD}")
    f = H.posting_fields(F.col("doc"))
    names = ("title", "company", "location", "applicants", "description", "recruiter", "recruiter_email", "posting_date")
    return rows.select(P, *[f[n].alias(n) for n in names], F.array_join(f["application_links"], " ").alias("links"))


# the page's own text and address stand inside the templates, on one line each
FLAT = "flat"
HOST = "regexp_extract(url, '://([^/]+)', 1)"
BODY = (f"'Data Lead ' || {text(P)} || '\nData Lead ' || {text(P)} || '\n  Site ' || {HOST} || ' \nLeeds, England\nPosted ' || {text(P + ' % 9 + 1')} || ' days ago\nOver 40 applicants\n' || "
        + choose(P, f"'Report this job\nIntro line\nAbout us\n' || {LONG} || {FLAT} || '\nSeniority level\nMid\nEmployment type\nFull-time\n'",
                 f"'About the job\nThe role is ' || {LONG} || {FLAT} || '\nShow more\nIndustries\nIT\n'",
                 f"'Job description ' || {LONG} || {FLAT} || ' Show more\n'", "'Nothing else here\n'"))


DUCK_FLAT = f"trim(regexp_replace({duck_text('html')}, '\\s+', ' ', 'g'))"


def bodies(t):
    rows = page(t).withColumn("flat", squeeze(html_to_text(F.col("html"))))
    return rows.selectExpr(P, "url", f"{BODY} AS body")


@query("page_descriptions",
       "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'About us' || chr(10) || w WHEN 1 THEN 'The role is ' || w WHEN 2 THEN w END AS job_description FROM "
       f"(SELECT page_id, trim(repeat('We build useful things for people. ', 10) || {DUCK_FLAT}) AS w FROM pages) s")
def _(t):
    return H.with_job_description(bodies(t).select(P, "body"), "body").select(P, "job_description")


@query("page_lines",
       "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Mid' END AS seniority, 'Posted ' || CAST(page_id % 9 + 1 AS VARCHAR) || ' days ago' AS posted, "
       "'Over 40 applicants' AS applicants, 'Site ' || regexp_extract(url, '://([^/]+)', 1) AS company, 'Leeds, England' AS location FROM pages")
def _(t):
    rows = bodies(t).withColumn("lines", text_lines(F.col("body")))
    lines = F.col("lines")
    card = H.top_card(lines, F.concat(F.lit("Data Lead "), F.col(P).cast("string")), F.lit(None).cast("string"))
    return rows.select(P, H.line_after(lines, "seniority LEVEL").alias("seniority"), H.posted_line(lines).alias("posted"),
                       H.applicants_line(lines).alias("applicants"), card["company"].alias("company"), card["location"].alias("location"))


@query("page_job_ids",
       "SELECT page_id, CAST(page_id + 10 AS VARCHAR) || ',' || CAST(page_id + 20 AS VARCHAR) || ',' || CAST(page_id + 30 AS VARCHAR) || ',7' AS ids FROM pages")
def _(t):
    extra = (f"'{{&quot;job_id&quot;:' || {text(P + ' + 10')} || '}} /jobs/view/' || {text(P + ' + 20')} || ' &#34;job_id&#34;:' || {text(P + ' + 10')} || "
             f"' urn:li:fs_normalized_jobPosting:' || {text(P + ' + 30')} || ' fsd_jobPostingCard:(7,X)'")
    return page(t, doc=f"html || {extra}").select(P, F.array_join(H.job_ids(F.col("doc")), ",").alias("ids"))


STATES = ("healthy", "active_challenge", "rate_limited", "blocked", "login_required", "empty", "healthy", "blocked", "healthy")
STATE_TEXT = words(P, "See /jobs/view/123 and security check", "Please solve this captcha", "Too many requests; security check", "Unusual activity was seen",
                   "Sign in to LinkedIn", "0 results found", "Nice page", "/jobs/view/9 verify you are human", "security of data")
STATE_URL = words(P, *["https://www.linkedin.com/jobs/search"] * 7, "https://www.linkedin.com/checkpoint/x", "https://www.linkedin.com/jobs/search")
STATE_SQL = words(P, *STATES)


@query("page_states", f"SELECT page_id, {STATE_SQL} AS state FROM pages")
def _(t):
    rows = t.dealt("pages", P).selectExpr(P, f"{STATE_URL} AS link", f"html || '<p>' || {STATE_TEXT} || '</p>' AS doc")
    return rows.select(P, H.page_state(F.lit("Search"), F.col("link"), F.col("doc"), is_search=True).alias("state"))


@query("run_statuses",
       "SELECT run, count(*) AS pages, CASE WHEN min(CASE WHEN state IN ('blocked', 'rate_limited') THEN id END) IS NOT NULL THEN "
       "arg_min(state, id) FILTER (state IN ('blocked', 'rate_limited')) WHEN bool_and(state IN ('healthy', 'empty')) THEN CASE WHEN bool_or(state = 'empty') "
       "THEN 'empty' ELSE 'healthy' END WHEN bool_or(state = 'login_required') THEN 'login_required' ELSE 'failed' END AS status FROM "
       "(SELECT key || '-' || CAST(id % 97 AS VARCHAR) AS run, id, state FROM fetch_log) s GROUP BY run", ("fetch_log",))
def _(t):
    log = t.fetch_log.selectExpr("key || '-' || CAST(id % 97 AS STRING) AS run", "id AS position", "state")
    return run_status(log)


# -- benchmark pages -------------------------------------------------------
N = "CAST(40000 + length(html) % 5000 * 13 AS BIGINT)"


def money(n: str, sign: str = "£") -> str:
    return f"'{sign}' || format_number({n}, 0)"


TABLE = (f"'<table><tr><td>10<sup>th</sup> Percentile</td><td>' || {money(N)} || '</td></tr><tr><td>25<sup>th</sup> Percentile</td><td>' || {words(P, '-', '£50,000')} || "
         f"'</td></tr><tr><th>Median annual salary (50th Percentile)</th><td><b>&#163;' || format_number({N} + 20000, 0) || '</b></td></tr>"
         f"<tr><td>Number of salaries quoted</td><td>1,' || lpad({text(P + ' % 900')}, 3, '0') || '</td></tr><tr><td>UK excluding London median</td><td>£48,000</td></tr></table>"
         f"<table><tr><td>10<sup>th</sup> Percentile</td><td>£1</td></tr><tr><td>75<sup>th</sup> Percentile</td><td>£2</td></tr></table>'")


@query("percentile_tables",
       "SELECT page_id, CAST(n AS DOUBLE) AS p10, CASE WHEN page_id % 2 = 1 THEN 50000.0 END AS p25, CAST(n + 20000 AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS p75, "
       "CAST(1000 + page_id % 900 AS BIGINT) AS sample_size, 48000.0 AS median_ex_london FROM (SELECT page_id, 40000 + length(html) % 5000 * 13 AS n FROM pages) s")
def _(t):
    rows = page(t, doc=f"html || {TABLE}")
    return E.percentile_table(rows, "doc").select(P, "p10", "p25", "median", "p75", "sample_size", "median_ex_london")


SOURCE = words(P, "itjobswatch", "indeed", "levels_fyi", "robert_half", "salaryexpert")
BENCH_DOC = choose(
    P, f"html || {TABLE}", f"'<meta name=\"description\" content=\"The average is ' || {money(N, '€')} || ' per year\">' || html",
    f"'<title>Pay ' || {money(N)} || ' to ' || {money(N + ' + 9000')} || '</title><meta content=\"up from £9,000 and ' || {money(N + ' + 4000')} || '\" name=\"description\">' || html",
    f"'<p>engineer pay</p> 21,000 ' || format_number({N}, 0) || ' then ' || format_number({N} + 100, 0) || ' and ' || {text(N + ' + 200')} || ' <b>' || {text(N + ' + 900')} || '</b> 999' || regexp_replace(html, '[0-9]', '')",
    f"'<meta name=\"description\" content=\"' || {money(N)} || '; ' || {money(N + ' + 10')} || '; £9,999; ' || {money(N + ' + 30')} || '\">' || html")


@query("extracted_benchmarks",
       "SELECT page_id, data_source, CAST(CASE page_id % 5 WHEN 0 THEN CASE WHEN page_id % 2 = 1 THEN 50000 END WHEN 1 THEN n - floor(n * 0.15 + 0.5) WHEN 3 THEN 21000 ELSE n END AS DOUBLE) AS amount_min, "
       "CAST(CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN n + floor(n * 0.15 + 0.5) WHEN 2 THEN n + 9000 WHEN 3 THEN n + 200 ELSE n + 30 END AS DOUBLE) AS amount_max, "
       "CAST(CASE page_id % 5 WHEN 0 THEN n + 20000 WHEN 1 THEN n WHEN 2 THEN floor((2 * n + 9000) / 2 + 0.5) WHEN 3 THEN floor((21000 + n + 200) / 2 + 0.5) ELSE n + 10 END AS DOUBLE) AS amount_median "
       f"FROM (SELECT page_id, {SOURCE} AS data_source, 40000 + length(html) % 5000 * 13 AS n FROM pages) s")
def _(t):
    rows = page(t, data_source=SOURCE, doc=BENCH_DOC, title="'Senior Engineer'").select(
        P, "data_source", "title", F.col("doc").alias("html"))
    return E.extract_benchmarks(rows).select(P, "data_source", "amount_min", "amount_max", "amount_median")


@query("slug_benchmarks",
       "SELECT o_orderkey AS key, CASE o_custkey % 4 WHEN 0 THEN 'architect' WHEN 1 THEN 'data engineer' WHEN 2 THEN 'solutions architect' END AS slug FROM orders WHERE o_custkey % 4 < 3")
def _(t):
    titles = t.table("orders").selectExpr("o_orderkey AS key", words("o_custkey", "AI Architect", "Senior Data Engineer", "Solution Architect", "Nurse") + " AS title")
    figures = t.table("part").selectExpr(
        words("p_partkey", "architect", "data engineer", "solutions architect", "ai architect") + " AS slug",
        "CASE WHEN p_partkey % 4 < 3 THEN p_retailprice END AS median")
    return E.slug_benchmark(titles, figures).select("key", "slug")


@query("benchmarks_by_country",
       "SELECT l_orderkey AS key, arg_min(data_source, rank) AS data_source FROM (SELECT *, CASE country WHEN 'GB' THEN CASE data_source WHEN 'itjobswatch' THEN 0 WHEN 'indeed' THEN 1 "
       "WHEN 'levels_fyi' THEN 2 WHEN 'robert_half' THEN 3 WHEN 'salaryexpert' THEN 4 END WHEN 'US' THEN CASE data_source WHEN 'levels_fyi' THEN 0 WHEN 'indeed' THEN 1 WHEN 'robert_half' THEN 2 "
       "WHEN 'salaryexpert' THEN 3 END ELSE CASE data_source WHEN 'indeed' THEN 0 WHEN 'levels_fyi' THEN 1 WHEN 'salaryexpert' THEN 2 END END AS rank FROM (SELECT l_orderkey, "
       + words("l_orderkey", "GB", "US", "JP") + " AS country, " + words("l_suppkey", "itjobswatch", "indeed", "levels_fyi", "robert_half", "salaryexpert", "linkedin")
       + " AS data_source FROM lineitem) a) b WHERE rank IS NOT NULL GROUP BY l_orderkey")
def _(t):
    rows = t.table("lineitem").selectExpr(
        "l_orderkey AS key", words("l_orderkey", "GB", "US", "JP") + " AS country_code",
        words("l_suppkey", "itjobswatch", "indeed", "levels_fyi", "robert_half", "salaryexpert", "linkedin") + " AS data_source",
        "l_extendedprice AS amount_median")
    return E.pick_by_country(rows).select("key", "data_source")
