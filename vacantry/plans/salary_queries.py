"""Queries: pay text, JSON-LD pay, titles and cohorts.

Each part becomes one posting text with pay wording built from its key; the oracle knows
the numbers and never reads the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions import money as M
from vacantry.functions import titles as X
from vacantry.functions.text import html_to_pay_text
from vacantry.operators import salary as S
from vacantry.operators.quality import rule_words, rules_conflicts
from vacantry.plans.registry import query
from vacantry.plans.testbed import choose, text, words

LOW = "CAST(30000 + p_partkey * 7 AS BIGINT)"
HIGH = f"({LOW} + 5000 + p_size * 100)"
DAY = "CAST(300 + p_partkey % 400 AS BIGINT)"
KILO = "CAST(60 + p_partkey % 90 AS BIGINT)"


def commas(n: str) -> str:
    return f"format_number({n}, 0)"


def pay_text() -> str:
    """Twelve wordings; the trailing name keeps every text distinct."""
    return choose(
        "p_partkey",
        f"'Pay £' || {commas(LOW)} || ' - £' || {commas(HIGH)} || ' per annum. ' || p_name",
        f"'Salary £' || {commas(LOW)} || ' plus benefits. ' || p_name",
        f"'Rate £' || {text(DAY)} || '/day outside. ' || p_name",
        f"'CHF ' || replace({commas(LOW)}, ',', '''') || ' – ' || replace({commas(HIGH)}, ',', '''') || ' per year ' || p_name",
        f"'AED ' || {commas(LOW)} || ' / month ' || p_name",
        f"'Contract €' || {text(DAY)} || '/hour or $' || {text(KILO)} || '/week ' || p_name",
        f"'Band $' || {text(KILO)} || 'k–$' || {text(KILO + ' + 30')} || 'K ' || p_name",
        "'Competitive salary and ' || p_name",
        "'Pay negotiable for ' || p_name",
        f"'We make ' || p_name || '\n  Similar jobs  \n£' || {commas(LOW)} || ' - £' || {commas(HIGH)}",
        f"'Base £' || {commas(LOW)} || ' - £' || {commas(HIGH)} || ', OTE £' || {commas(HIGH + ' + 20000')} || ' ' || p_name",
        f"'<b title=\"£1,000,000 - £2,000,000\">' || p_name || '</b> https://x.example/£90000 for the whole wide team now £' || {commas(LOW)} || ' '",
    )


def texts(t):
    return t.table("part").selectExpr("p_partkey", f"{pay_text()} AS body")


FACTS = f"SELECT p_partkey, p_partkey % 12 AS v, CAST({LOW} AS DOUBLE) AS lo, CAST({HIGH} AS DOUBLE) AS hi, CAST({DAY} AS DOUBLE) AS d, CAST({KILO} AS DOUBLE) AS k FROM part"


def arm(where, ordinal, lo, hi, cur, period, kind="'base'", status="NULL"):
    return (f"SELECT p_partkey, {ordinal} AS ordinal, {lo} AS amount_min, {hi} AS amount_max, {cur} AS currency, {period} AS period, "
            f"{kind} AS compensation_type, {status} AS extraction_status FROM f WHERE {where}")


PAY = " UNION ALL ".join([
    arm("v IN (0, 10)", 0, "lo", "hi", "'GBP'", "'year'"),
    arm("v IN (1, 11)", 0, "lo", "CAST(NULL AS DOUBLE)", "'GBP'", "'year'"),
    arm("v = 2", 0, "d", "NULL", "'GBP'", "'day'"),
    arm("v = 3", 0, "lo", "hi", "'CHF'", "'year'"),
    arm("v = 4", 0, "lo", "NULL", "'AED'", "'month'"),
    arm("v = 5", 0, "d", "NULL", "'EUR'", "'hour'"),
    arm("v = 5", 1, "k", "NULL", "'USD'", "'week'"),
    arm("v = 6", 0, "k * 1000", "(k + 30) * 1000", "'USD'", "'year'"),
    arm("v = 10", 1, "hi + 20000", "NULL", "'GBP'", "'year'", "'ote_total'"),
    arm("v IN (7, 8, 9)", 0, "NULL", "NULL", "NULL", "NULL", "NULL",
        "CASE v WHEN 7 THEN 'competitive' WHEN 8 THEN 'doe' ELSE 'absent' END"),
])
FACTOR = "CASE period WHEN 'hour' THEN 1820 WHEN 'day' THEN 220 WHEN 'week' THEN 52 WHEN 'month' THEN 12 ELSE 1 END"


@query("parsed_salaries",
       f"SELECT p_partkey, CAST(ordinal AS BIGINT) AS ordinal, amount_min, amount_max, currency, period, compensation_type, extraction_status, "
       f"amount_min * {FACTOR} AS annualized_min, amount_max * {FACTOR} AS annualized_max, extraction_status IS NULL AS is_posted FROM pay", f=FACTS, pay=PAY)
def _(t):
    return S.parse_salary(texts(t), "body").select(
        "p_partkey", "ordinal", "amount_min", "amount_max", "currency", "period", "compensation_type", "extraction_status",
        "annualized_min", "annualized_max", "is_posted")


@query("salary_candidates",
       "SELECT p_partkey, amount_min, amount_max, currency, period FROM pay WHERE extraction_status IS NULL AND compensation_type = 'base' "
       "UNION ALL SELECT p_partkey, hi + 20000, NULL, 'GBP', 'year' FROM f WHERE v = 10 UNION ALL SELECT p_partkey, lo, hi, 'GBP', 'year' FROM f WHERE v = 9",
       f=FACTS, pay=PAY)
def _(t):
    rows = S.salary_candidates(texts(t), "body")
    return rows.select("p_partkey", F.explode("pay").alias("c")).select(
        "p_partkey", "c.amount_min", "c.amount_max", "c.currency", "c.period")


@query("no_salary_reasons",
       "SELECT p_partkey, CASE v WHEN 7 THEN 'competitive' WHEN 8 THEN 'doe' ELSE 'absent' END AS reason, CASE WHEN v = 10 THEN hi + 20000 END AS ote, "
       "v <> 9 AS unchanged FROM f", f=FACTS)
def _(t):
    body = F.col("body")
    return texts(t).select("p_partkey", S.no_salary_reason(body).alias("reason"), S.ote_amount(body)["amount"].alias("ote"),
                           (S.cut_at_similar_jobs(body) == body).alias("unchanged"))


@query("parsed_amounts",
       "SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN p_partkey * 1000 WHEN 1 THEN 1234567 WHEN 2 THEN p_partkey + 0.5 WHEN 3 THEN p_partkey * 1000 + 500 "
       "WHEN 4 THEN NULL ELSE 12000 + p_partkey END AS DOUBLE) AS amount, CAST(CASE p_partkey % 5 WHEN 0 THEN 1820 WHEN 1 THEN 220 WHEN 2 THEN 52 WHEN 3 THEN 12 "
       "ELSE 1 END * p_size AS DOUBLE) AS annual FROM part")
def _(t):
    rows = t.table("part").selectExpr(
        "p_partkey", "p_size", words("p_partkey", "hour", "day", "week", "month", "year") + " AS period",
        "CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey AS STRING) || 'k' WHEN 1 THEN '1,234''567' WHEN 2 THEN CAST(p_partkey AS STRING) || '.5' "
        "WHEN 3 THEN CAST(p_partkey AS STRING) || '.500' WHEN 4 THEN 'n/a' ELSE ' ' || CAST(12000 + p_partkey AS STRING) || '. ' END AS a")
    return rows.select("p_partkey", M.parse_amount(F.col("a")).alias("amount"),
                       M.annualize(F.col("p_size").cast("double"), F.col("period")).alias("annual"))


# JSON-LD in four shapes, a graph, and blocks that state no pay
LD = choose(
    "p_partkey",
    f"'{{\"@type\":\"JobPosting\",\"baseSalary\":{{\"value\":' || {text(LOW)} || ',\"currency\":\"GBP\",\"unitText\":\"YEAR\"}}}}'",
    f"'{{\"@type\":[\"Thing\",\"JobPosting\"],\"baseSalary\":{{\"currency\":\"EUR\",\"value\":{{\"value\":' || {text(DAY)} || '.5,\"unitText\":\"day\"}}}}}}'",
    f"'{{\"@graph\":[{{\"@type\":\"WebPage\"}},{{\"@type\":\"JobPosting\",\"baseSalary\":{{\"value\":{{\"minValue\":\"' || {text(LOW)} || '\",\"maxValue\":' || {text(HIGH)} || ',\"currency\":\"CHF\",\"unitText\":\"P1M\"}}}}}}]}}'",
    f"'{{\"@type\":\"JobPosting\",\"baseSalary\":{{\"minValue\":' || {text(LOW)} || ',\"currency\":\"USD\",\"unitText\":\"HOUR\"}}}}'",
    f"'{{\"@type\":\"JobPosting\",\"baseSalary\":{{\"value\":{{\"maxValue\":' || {text(HIGH)} || '}},\"currency\":\"USD\"}}}}'",
    f"'{{\"@type\":\"JobPosting\",\"baseSalary\":{{\"value\":' || {text(LOW)} || ',\"currency\":\"pounds\"}}}}'",
    "'{\"@type\":\"Article\",\"baseSalary\":{\"value\":1,\"currency\":\"GBP\"}}'",
    "'not json ' || p_name",
)
LD_PAY = ("SELECT p_partkey, CASE j WHEN 1 THEN d + 0.5 ELSE lo END AS amount_min, CASE j WHEN 0 THEN lo WHEN 1 THEN d + 0.5 WHEN 2 THEN hi END AS amount_max, "
          "CASE j WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 2 THEN 'CHF' ELSE 'USD' END AS currency, CASE j WHEN 0 THEN 'year' WHEN 1 THEN 'day' WHEN 2 THEN 'month' "
          "ELSE 'hour' END AS period FROM (SELECT *, p_partkey % 8 AS j FROM f) g WHERE j < 4")


@query("jsonld_salaries", "SELECT * FROM ld", f=FACTS, ld=LD_PAY)
def _(t):
    rows = t.table("part").selectExpr("p_partkey", f"{LD} AS ld")
    rows = S.with_jsonld_salary(rows, "ld", "pay")
    return rows.filter(F.col("pay").isNotNull()).select(
        "p_partkey", "pay.amount_min", "pay.amount_max", "pay.currency", "pay.period")


@query("preferred_jsonld_pay",
       "SELECT p_partkey, amount_min, amount_max, currency, period, 'jsonld' AS extractor FROM ld UNION ALL SELECT p_partkey, amount_min, amount_max, currency, period, "
       "CASE WHEN extraction_status IS NULL THEN 'regex' END FROM pay WHERE p_partkey % 8 >= 4", f=FACTS, ld=LD_PAY, pay=PAY)
def _(t):
    rows = t.dealt("part", "p_partkey").selectExpr("p_partkey", f"{pay_text()} AS body", f"{LD} AS ld")
    return S.parse_salary(rows, "body", "ld").select("p_partkey", "amount_min", "amount_max", "currency", "period", "extractor")


@query("advertiser_pay",
       "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'GBP' WHEN 1 THEN 'DKK' WHEN 2 THEN 'USD' END AS currency, CAST(CASE p_partkey % 5 WHEN 0 THEN lo WHEN 1 THEN k * 1000 "
       "WHEN 2 THEN lo END AS DOUBLE) AS low, CAST(CASE p_partkey % 5 WHEN 0 THEN hi WHEN 1 THEN (k + 9) * 1000 WHEN 2 THEN lo END AS DOUBLE) AS high FROM f", f=FACTS)
def _(t):
    rows = t.dealt("part", "p_partkey").selectExpr("p_partkey", choose(
        "p_partkey", f"p_name || ' pay range: GBP ' || {commas(LOW)} || ' to ' || {commas(HIGH)} || ' per year'",
        f"'Salary: DKK ' || {text(KILO)} || 'k - ' || {text(KILO + ' + 9')} || 'k ' || p_name",
        f"'The base is $' || {commas(LOW)} || ' annually for ' || p_name", "'Tickets cost £20 - £30 at ' || p_name", "p_name") + " AS body")
    return S.advertiser_pay(rows, "body", F.lit(True), S.MAX_ADVERTISER).select("p_partkey", "currency", "low", "high")


@query("pay_page_text",
       "SELECT p_partkey, 'Title' || chr(10) || '£' || CAST(p_size AS VARCHAR) || ' per hour & more' || chr(10) || 'Similar jobs' || chr(10) || p_name AS body FROM part")
def _(t):
    rows = t.table("part").selectExpr(
        "p_partkey", "'<script>x</script><h1>Title</h1>&pound;' || CAST(p_size AS STRING) || ' / hr &amp; <b>more</b><br/><h2>Similar jobs</h2><i>' || p_name || '</i>' AS html")
    return rows.select("p_partkey", F.trim(F.regexp_replace(html_to_pay_text(F.col("html")), r"\n+", "\n")).alias("b")).select(
        "p_partkey", F.regexp_replace("b", r"^\n|\n$", "").alias("body"))


# -- titles ----------------------------------------------------------------
HEAD = ("Sr. ", "Lead ", "", "Principal ", "Jr ", "Talented VP of ", "Chief ")
BASE = ("Software Engineer", "C++ Dev", "Architect Solutions", "Solutions Architect", "AI & ML Engineers", "Développeur .NET")
TAIL = ("", " – London (Remote)", " II, Berlin", " for the EMEA hybrid team")
HEAD_OUT = ("senior ", "lead ", "", "principal ", "junior ", "vice_president ", "chief ")
BASE_OUT = ("software_engineer", "cpp developer", "architect solutions", "solutions_architect",
            "artificial_intelligence machine_learning engineer", "developpeur dotnet")
TAIL_OUT = ("", "", " 2", " team")
RAW_TITLE = f"{words('l_orderkey', *HEAD)} || {words('l_partkey', *BASE)} || {words('l_suppkey', *TAIL)}"
LEVEL = words("l_orderkey", "senior", "lead", "_any", "principal", "junior", "vp", "cxo")


@query("normalized_titles",
       f"SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_orderkey % 7 = 1 AND l_partkey % 6 = 2 THEN 'lead_' ELSE {words('l_orderkey', *HEAD_OUT)} END || {words('l_partkey', *BASE_OUT)} || {words('l_suppkey', *TAIL_OUT)} AS title, "
       f"{LEVEL} AS seniority FROM lineitem")
def _(t):
    rows = t.table("lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", f"{RAW_TITLE} AS raw")
    return X.titled_rows(rows, "raw").drop("raw").withColumnRenamed("normalized_title", "title")


# mostly distinct titles, with full-width letters, ligatures and combining marks
FOLDED = ("Ｓｅｎｉｏｒ Ｓｏｆｔｗａｒｅ Ｅｎｇｉｎｅｅｒ", "Oﬃce Architect", "De\u0301veloppeur Sr.", "Lead ﬁeld Engineer", "Ⅻ Analyst²")
FOLDED_OUT = ("senior software_engineer", "office architect", "developpeur senior", "lead field engineer", "xii analyst2")
FOLDED_LEVEL = ("senior", "_any", "senior", "lead", "_any")


@query("folded_titles",
       f"SELECT o_orderkey, {words('o_orderkey', *FOLDED_OUT)} || ' x' || CAST(o_orderkey AS VARCHAR) AS title, {words('o_orderkey', *FOLDED_LEVEL)} AS seniority FROM orders")
def _(t):
    rows = t.table("orders").selectExpr("o_orderkey", f"{words('o_orderkey', *FOLDED)} || ' x' || CAST(o_orderkey AS STRING) AS raw")
    return X.titled_rows(rows, "raw").select("o_orderkey", F.col("normalized_title").alias("title"), "seniority")


@query("industries",
       "SELECT o_orderkey, CASE o_custkey % 7 WHEN 0 THEN 'finance' WHEN 1 THEN 'software' WHEN 2 THEN 'healthcare' WHEN 3 THEN '_any' WHEN 4 THEN 'energy' "
       "WHEN 5 THEN 'finance' ELSE '_any' END AS industry FROM orders")
def _(t):
    raw = words("o_custkey", "FinTech startup", "software", "A hospital group", "Circus", "Solar farm software", "cloud banking", None)
    return t.table("orders").selectExpr("o_orderkey", f"{raw} AS raw").select("o_orderkey", X.industry(F.col("raw")).alias("industry"))


@query("title_slugs",
       "SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'artificial intelligence architect|ai architect|architect' WHEN 1 THEN "
       "'senior data engineer (contract)|data engineer (contract)|data engineer|engineer' WHEN 2 THEN 'solutions architect|solution architect|architect' "
       "WHEN 3 THEN 'lead site reliability engineer at acme|site reliability engineer at acme|site reliability engineer|reliability engineer|engineer' ELSE 'nurse' END AS slugs FROM orders")
def _(t):
    raw = words("o_custkey", "AI  Architect", "Senior Data Engineer (contract)", "Solution_Architect", "Lead Site Reliability Engineer at Acme", "Nurse")
    return t.table("orders").selectExpr("o_orderkey", f"{raw} AS raw").select(
        "o_orderkey", F.array_join(X.candidate_slugs(F.col("raw")), "|").alias("slugs"))


SECTION = "CASE p_size % 4 WHEN 0 THEN 'stopwords' WHEN 1 THEN 'filler_adjectives' WHEN 2 THEN 'seniority_table' ELSE 'locations' END"
EDITED_SQL = (
    f"SELECT {SECTION} AS section, lower(unnest(string_split(p_name, ' '))) AS word FROM part UNION ALL SELECT * FROM (VALUES "
    + ", ".join([f"('stopwords', '{w}')" for w in lx.TITLE_STOPWORDS] + [f"('filler_adjectives', '{w}')" for w in lx.TITLE_FILLERS]
                + [f"('seniority_table', '{w}')" for _, words_ in lx.SENIORITY_TABLE for w in words_]) + ") v(section, word)")


@query("title_word_conflicts",
       "SELECT DISTINCT section, word FROM (" + EDITED_SQL + ") r WHERE section IN ('stopwords', 'filler_adjectives') AND word IN (SELECT word FROM (" + EDITED_SQL
       + ") s WHERE section = 'seniority_table')")
def _(t):
    # the tables in use, edited: words of part names join the section that the part's size names
    edits = t.table("part").selectExpr(f"{SECTION} AS section", "explode(split(p_name, ' ')) AS word")
    return rules_conflicts(rule_words(t.spark).unionByName(edits))
