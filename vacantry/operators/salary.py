"""Pay extraction from posting text and JSON-LD.

Patterns run in a fixed order over the same text.  Each accepted hit is blanked before
the next pattern runs, which is how hits never overlap; tags and links are blanked first,
which is how nothing inside them is ever read as pay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.money import (annual_note, annualize, currency_of, parse_amount,
                                      plain_amount)
from vacantry.functions.staging import computed_once
from vacantry.functions.text import first_items, squeeze

FILLER = " ¤ "
CANDIDATE = (
    "struct<amount_min:double,amount_max:double,currency:string,period:string,"
    "compensation_type:string,extractor:string,evidence:string>"
)


@dataclass(frozen=True)
class PayPattern:
    """One pattern with the groups that hold its parts (0 means the part is absent)."""

    pattern: str
    low: int
    high: int = 0
    currency: str = ""
    symbol: int = 0
    period: str = "year"
    period_group: int = 0


# fixed values: pay wording, in the order it is tried.  A single pound amount must exceed
# 100 and must not be one end of a range.
DASH = r"(?:-|to|–|—)"
YEARLY = r"(?:\s*(?:per\s+annum|annually|per\s+year|/year))?"
PAY_PATTERNS = [
    PayPattern(rf"(?i)£([\d,'.]+)\s*{DASH}\s*£([\d,'.]+){YEARLY}", 1, 2, "GBP"),
    PayPattern(
        r"(?i)(?<!£[\d,'.]{1,7}\s{0,2}[-–—]\s{0,2})"
        r"£([\d,'.]+)(?=\s*[.;,!?\s]|$)(?<!£0{0,9}\d{1,2}(?:\.(?:\d{0,2}|\d{4,8}))?)(?<!£0{0,9}100(?:\.0{0,2})?)"
        r"(?![\s\d,'.]{0,20}(?:[-–—]|to))", 1, 0, "GBP"),
    PayPattern(r"(?i)£([\d,'.]+)(?:\s*/day)", 1, 0, "GBP", period="day"),
    PayPattern(rf"(?i)CHF\s+([\d'.]+)\s*{DASH}\s*([\d'.]+){YEARLY}", 1, 2, "CHF"),
    PayPattern(r"(?i)AED\s+([\d,]+)(?:\s*/\s*(month|year|week|day|hour))?(?:\s+[a-z]+)?", 1, 0,
               "AED", period="month", period_group=2),
    PayPattern(r"(?i)([£$€])([\d,'.]+)(?:\s*/\s*(hour|day|week|month))", 2, 0, symbol=1,
               period_group=3),
    PayPattern(rf"(?i)\$([\d,]+k?)\s*{DASH}\s*\$([\d,]+k?){YEARLY}", 1, 2, "USD"),
]


def has_pay_mark(c: Column) -> Column:
    return c.rlike(r"(?i)[£$€]|CHF|AED")


def cut_at_similar_jobs(c: Column) -> Column:
    """Text above the first line that is a similar-jobs heading."""
    headings = "|".join(h.replace(" ", r"\s") for h in lx.SIMILAR_JOBS_HEADINGS)
    return F.split(c, rf"(?im)^\s*(?:{headings})\s*$", 2)[0]


def _hits(text: Column, p: PayPattern) -> Column:
    def group(n):
        return F.regexp_extract_all(text, F.lit(p.pattern), F.lit(n))

    whole = group(0)
    high = group(p.high) if p.high else F.transform(whole, lambda _: F.lit(None).cast("string"))
    symbol = group(p.symbol) if p.symbol else F.transform(whole, lambda _: F.lit(""))
    period = group(p.period_group) if p.period_group else F.transform(whole, lambda _: F.lit(""))
    rows = F.arrays_zip(whole, group(p.low), high, symbol, period)
    rows = F.transform(rows, lambda r: F.struct(
        parse_amount(r["1"]).alias("amount_min"),
        parse_amount(r["2"]).alias("amount_max"),
        (currency_of(r["3"]) if p.symbol else F.lit(p.currency)).alias("currency"),
        F.when(r["4"] != "", F.lower(r["4"])).otherwise(F.lit(p.period)).alias("period"),
        F.lit("base").alias("compensation_type"), F.lit("regex").alias("extractor"),
        F.trim(r["0"]).alias("evidence")))
    ok = F.filter(rows, lambda r: r["amount_min"].isNotNull() & (
        r["amount_max"].isNotNull() if p.high else F.lit(True)))
    return F.when(has_pay_mark(text), ok).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def salary_candidates(df: DataFrame, text: str, out: str = "pay") -> DataFrame:
    """Adds an array of pay candidates found in a text column."""
    masked = F.coalesce(F.col(text), F.lit(""))
    masked = F.regexp_replace(masked, r"<[^>]*>?", FILLER)
    masked = F.regexp_replace(masked, r"(?s)://.{0,27}", FILLER)
    given = [c for c in df.columns if c != out]
    df = df.withColumn("_text0", masked)
    names = []
    for i, p in enumerate(PAY_PATTERNS):
        df = df.withColumn(f"_pay{i}", _hits(F.col(f"_text{i}"), p))
        names.append(f"_pay{i}")
        if i + 1 < len(PAY_PATTERNS):
            df = df.withColumn(f"_text{i + 1}", F.when(
                F.size(f"_pay{i}") > 0, F.regexp_replace(f"_text{i}", p.pattern, FILLER)
            ).otherwise(F.col(f"_text{i}")))
    return computed_once(df.withColumn(out, F.concat(*names)).drop(
        *names, *[f"_text{i}" for i in range(len(PAY_PATTERNS))]), given)


def has_ote(c: Column) -> Column:
    return c.rlike(rf"(?i)\b{lx.OTE_WORDS}\b")


def ote_amount(c: Column) -> Column:
    """Struct (amount, currency) stated next to on-target wording, else NULL."""
    # fixed values: wording patterns
    near = r"[^£$€\w]{0,30}"
    amount = r"([\d,'.]+k?)"
    tries = [
        (rf"(?i){lx.OTE_WORDS}{near}([£$€])\s*{amount}", 2, 1),
        (rf"(?i){lx.OTE_WORDS}{near}{amount}\s+(CHF|AED)", 1, 2),
        (rf"(?i)([£$€])\s*{amount}{near}{lx.OTE_WORDS}\b", 2, 1),
        (rf"(?i){amount}\s+(CHF|AED){near}{lx.OTE_WORDS}\b", 1, 2),
    ]
    out = []
    for pattern, value, money in tries:
        parsed = parse_amount(F.regexp_extract(c, pattern, value))
        unit = currency_of(F.regexp_extract(c, pattern, money))
        out.append(F.when(c.rlike(pattern) & parsed.isNotNull() & unit.isNotNull(), F.struct(
            parsed.alias("amount"), unit.alias("currency"))))
    return F.coalesce(*out)


def ote_split(df: DataFrame, found: str, text: str) -> DataFrame:
    """On-target wording turns a row's candidates into the first one as base pay, plus
    the on-target total when it is stated."""
    first, ote = F.get(found, F.lit(0)), F.col("_ote")
    symbol = F.create_map(*[F.lit(x) for x in ("GBP", "£", "USD", "\\$", "EUR", "€")])[F.col("_ote.currency")]
    mentions = F.regexp_extract_all(
        F.col(text), F.concat(F.lit("("), symbol, F.lit(r"\s*[\d,'.]+)")), F.lit(1))
    total = F.struct(
        ote["amount"].alias("amount_min"), F.lit(None).cast("double").alias("amount_max"),
        ote["currency"].alias("currency"), first["period"].alias("period"),
        F.lit("ote_total").alias("compensation_type"), first["extractor"].alias("extractor"),
        F.coalesce(F.col("_last"), first["evidence"]).alias("evidence"))
    marked = (F.size(found) > 0) & has_ote(F.col(text))
    staged = df.withColumn("_marked", marked)
    staged = staged.withColumn("_ote", F.when(F.col("_marked"), ote_amount(F.col(text))))
    staged = staged.withColumn("_last", F.when(ote.isNotNull(), F.try_element_at(mentions, F.lit(-1))))
    split = F.when(ote.isNotNull(), F.array(first, total)).when(F.col("_marked"), F.array(first)).otherwise(
        F.col(found))
    return staged.withColumn(found, split).drop("_marked", "_ote", "_last")


def _number(v: Column, path: str) -> Column:
    """Numeric value at a path; numeric text counts, other types do not."""
    n = F.try_variant_get(v, path, "double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def _type_at(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def is_job_posting(v: Column) -> Column:
    types = F.try_variant_get(v, "$['@type']", "array<string>")
    one = F.try_variant_get(v, "$['@type']", "string")
    return F.coalesce(F.array_contains(types, "JobPosting"), one == "JobPosting", F.lit(False))


def jsonld_posting(block: Column) -> Column:
    """Posting inside a parsed block: the first in its graph, else the block itself."""
    graph = F.try_variant_get(block, "$['@graph']", "array<variant>")
    inner = F.get(F.filter(graph, is_job_posting), F.lit(0))
    return F.coalesce(inner, F.when(is_job_posting(block), block))


def jsonld_salary(posting: Column) -> Column:
    """Pay candidate from a posting's baseSalary in any of its four shapes, else NULL."""
    numeric = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
    flat = _type_at(posting, "$.baseSalary.value").rlike(numeric)
    boxed = _type_at(posting, "$.baseSalary.value.value").rlike(numeric)
    nested = _type_at(posting, "$.baseSalary.value").startswith("OBJECT")

    def text(path):
        return F.try_variant_get(posting, path, "string")

    outer, inner = text("$.baseSalary.currency"), text("$.baseSalary.value.currency")
    low = (
        F.when(flat, _number(posting, "$.baseSalary.value"))
        .when(boxed, _number(posting, "$.baseSalary.value.value"))
        .when(nested, _number(posting, "$.baseSalary.value.minValue"))
        .otherwise(_number(posting, "$.baseSalary.minValue")))
    high = (
        F.when(flat | boxed, low)
        .when(nested, _number(posting, "$.baseSalary.value.maxValue"))
        .otherwise(_number(posting, "$.baseSalary.maxValue")))
    unit = (
        F.when(flat, text("$.baseSalary.unitText"))
        .when(boxed, F.coalesce(text("$.baseSalary.value.unitText"), text("$.baseSalary.unitText")))
        .when(nested, text("$.baseSalary.value.unitText"))
        .otherwise(text("$.baseSalary.unitText")))
    currency = F.when(flat, outer).otherwise(F.coalesce(outer, inner))
    unit = F.upper(F.coalesce(unit, F.lit("")))
    period = (
        F.when(unit.isin("MONTH", "P1M"), F.lit("month")).when(unit.isin("WEEK", "P1W"), F.lit("week"))
        .when(unit.isin("DAY", "P1D"), F.lit("day")).when(unit.isin("HOUR", "PT1H"), F.lit("hour"))
        .otherwise(F.lit("year")))
    ok = posting.isNotNull() & low.isNotNull() & currency.rlike("^[A-Z]{3}$")
    return F.when(ok, F.struct(
        low.alias("amount_min"), high.alias("amount_max"), currency.alias("currency"),
        period.alias("period"), F.lit("base").alias("compensation_type"),
        F.lit("jsonld").alias("extractor"), F.lit("JobPosting.baseSalary").alias("evidence")))


def with_jsonld_salary(df: DataFrame, jsonld: str, out: str = "jsonld_pay") -> DataFrame:
    """Adds the pay candidate stated by a JSON-LD text column, NULL when none."""
    rows = df.withColumn("_ld", F.try_parse_json(F.col(jsonld)))
    rows = rows.withColumn("_posting", jsonld_posting(F.col("_ld")))
    rows = rows.withColumn(out, F.when(F.col("_posting").isNotNull(), jsonld_salary(F.col("_posting"))))
    return computed_once(rows.drop("_ld", "_posting"), [c for c in df.columns if c != out])


def no_salary_reason(c: Column) -> Column:
    """Why a text states no pay: competitive, then doe, else absent."""
    text = F.coalesce(c, F.lit(""))
    return (F.when(text.rlike(lx.COMPETITIVE_PATTERN), F.lit("competitive"))
            .when(text.rlike(lx.DOE_PATTERN), F.lit("doe")).otherwise(F.lit("absent")))


def parse_salary(df: DataFrame, text: str, jsonld: str | None = None) -> DataFrame:
    """Pay rows of every input row, never none.

    Each row is a candidate (extraction_status NULL) or one marker row that says why
    nothing was found.  JSON-LD pay replaces text pay.  Input columns are carried along.
    """
    columns = df.columns
    rows = df.withColumn("_body", cut_at_similar_jobs(F.coalesce(F.col(text), F.lit(""))))
    rows = salary_candidates(rows, "_body", "_found")
    rows = ote_split(rows, "_found", "_body")
    if jsonld is not None:
        rows = with_jsonld_salary(rows, jsonld, "_ld_pay")
        rows = rows.withColumn("_found", F.when(
            F.col("_ld_pay").isNotNull(), F.array("_ld_pay")).otherwise(F.col("_found")))
    rows = rows.select(*columns, F.posexplode_outer("_found").alias("ordinal", "c"))
    marker = F.col("c").isNull()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("_reason", F.when(marker, no_salary_reason(F.col(text))))
    reason = F.col("_reason")
    quote = F.when(reason == "competitive", F.regexp_extract(body, lx.COMPETITIVE_PATTERN, 0)).when(
        reason == "doe", F.regexp_extract(body, lx.DOE_PATTERN, 0))
    period = F.col("c.period")
    return rows.select(
        *columns, F.coalesce("ordinal", F.lit(0)).cast("bigint").alias("ordinal"),
        "c.amount_min", "c.amount_max", "c.currency", period.alias("period"),
        "c.compensation_type", "c.extractor",
        annualize(F.col("c.amount_min"), period).alias("annualized_min"),
        annualize(F.col("c.amount_max"), period).alias("annualized_max"),
        F.when(~marker, annual_note(period)).alias("annualization_note"),
        (~marker).alias("is_posted"), reason.alias("extraction_status"),
        F.when(marker, quote).otherwise(F.col("c.evidence")).alias("evidence"),
    )


# -- advertiser pages ------------------------------------------------------
MONEY_MARK = r"(?:GBP|EUR|USD|DKK|CHF|£|€|\$)"
AMOUNT = r"[0-9][0-9.,]*(?:\s?[kK])?"
PER_YEAR = r"(?:per year|/yr|year|annually|annual|p\.a\.)"
# fixed values: advertiser wording
ADVERTISER_PATTERNS = [
    rf"(?i)({MONEY_MARK}\s?{AMOUNT}\s*(?:-|–|—|to)\s*(?:{MONEY_MARK}\s?)?{AMOUNT}(?:\s*{PER_YEAR})?)",
    rf"(?i)({MONEY_MARK}\s?{AMOUNT}\s*{PER_YEAR})",
]
MAX_ADVERTISER = 8


BEFORE, BEHIND = 180, 220  # characters of a snippet around its match
LINE = r"[^\n\r\u0085\u2028\u2029]*"


def _with_snippets(text: Column, pattern: str) -> Column:
    """Array of (match, snippet) for every match, from left to right, each pattern read over the text twice.

    A snippet begins behind the match before and stays within the line.
    """
    whole = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("match"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<match:string,snippet:string>>").alias("out"))

    def take(acc: Column, m: Column) -> Column:
        behind = acc["at"] + F.length(m["gap"]) + F.length(m["match"])
        before = F.regexp_extract(F.right(m["gap"], F.lit(BEFORE)), LINE + r"\z", 0)
        after = F.regexp_extract(F.substring(text, behind, F.lit(BEHIND)), "^" + LINE, 0)
        made = F.struct(F.trim(m["match"]).alias("match"), F.trim(F.concat(before, m["match"], after)).alias("snippet"))
        return F.when(m["match"].isNull(), acc).otherwise(F.struct(behind.alias("at"), F.array_append(acc["out"], made).alias("out")))

    return F.aggregate(whole, start, take, lambda acc: acc["out"])


def advertiser_candidates(text: Column, limit: int | None = None) -> Column:
    """Array of (match, snippet): pay wording with the words around it; all, or the first ``limit``."""
    clean = F.regexp_replace(text, r"\s+", " ")
    found = F.concat(*[F.flatten(F.transform(F.array(clean), lambda t: _with_snippets(t, p))) for p in ADVERTISER_PATTERNS])
    return F.when(text.rlike(MONEY_MARK), first_items(F.array_distinct(found), limit))


def parse_range(match: Column) -> Column:
    """Struct (currency, low, high, mid) of advertiser wording, else NULL."""
    currency = (
        F.when(match.rlike("(?i)£|GBP"), F.lit("GBP")).when(match.rlike("(?i)€|EUR"), F.lit("EUR"))
        .when(match.rlike(r"(?i)\$|USD"), F.lit("USD")).when(match.rlike("(?i)DKK"), F.lit("DKK"))
        .when(match.rlike("(?i)CHF"), F.lit("CHF")))
    raw = F.regexp_extract_all(match, F.lit(r"([0-9][0-9.,]*\s*[kK]?)"), F.lit(1))

    def number(t):
        kilo = t.rlike("[kK]$")
        n = plain_amount(F.trim(F.regexp_replace(t, r"\s*[kK]$", "")))
        small = F.replace(F.trim(t), F.lit(","), F.lit("")).rlike(r"^\d+\.\d+$") & (n < 1000)
        return F.when(kilo | small, n * 1000).otherwise(n)

    values = F.filter(F.transform(raw, number), lambda n: n.isNotNull())

    def shaped(v: Column) -> Column:
        low, high = F.get(v, F.lit(0)), F.coalesce(F.get(v, F.lit(1)), F.get(v, F.lit(0)))
        return F.when(currency.isNotNull() & low.isNotNull(), F.struct(
            currency.alias("currency"), low.alias("low"), high.alias("high"), ((low + high) / 2).alias("mid")))

    return F.get(F.transform(F.array(values), shaped), F.lit(0))  # bound once, read several times


def likely_exact(snippet: Column, external: Column) -> Column:
    """True when the surrounding words say the amount is this posting's pay."""
    s = F.lower(snippet)
    return s.rlike(r"base pay range|provided pay range|salary\s*:|salary range|pay range") | (
        external & s.rlike("salary|compensation|remuneration|base"))


def advertiser_pay(df: DataFrame, text: str, external: Column, limit: int | None = None) -> DataFrame:
    """First likely-exact advertiser amount of each row (columns NULL when none)."""
    staged = df.withColumn("_cands", advertiser_candidates(F.col(text), limit))
    parsed = F.transform("_cands", lambda c: F.struct(
        c.alias("c"), parse_range(c["match"]).alias("r")))
    best = F.get(F.filter(parsed, lambda x: x["r"].isNotNull() & likely_exact(
        x["c"]["snippet"], external)), F.lit(0))
    return staged.withColumn("_best", best).select(
        *df.columns, F.col("_best.r.currency").alias("currency"), F.col("_best.r.low").alias("low"),
        F.col("_best.r.high").alias("high"), F.col("_best.r.mid").alias("mid"),
        F.col("_best.c.match").alias("match"))


def observation_shape(pay: DataFrame, as_of: str) -> DataFrame:
    """Observation rows from parsed pay; base and ote_total become stored type names."""
    from vacantry.functions.keys import observation_id

    kind = F.when(F.col("compensation_type") == "ote_total", F.lit("ote")).otherwise(F.lit("base_salary"))
    none = F.lit(None).cast("string")
    median = F.lit(None).cast("double")
    rows = pay.filter(F.col("extraction_status").isNull())
    return rows.select(
        F.col("source").alias("job_source"), "job_id",
        observation_id(F.col("currency"), F.col("amount_min"), F.col("amount_max"), median,
                       F.col("period"), F.col("source"), F.col("url"), F.col("country_code"),
                       F.col("region"), F.col("city")).alias("observation_id"),
        F.col("source").alias("data_source"), F.col("url").alias("data_source_url"),
        none.alias("benchmark_id"), F.lit("posted_exact").alias("confidence_label"),
        F.lit("exact_job").alias("matched_by"), F.lit(True).alias("is_posted"),
        F.lit(False).alias("is_predicted"), "currency", "amount_min", "amount_max",
        median.alias("amount_median"), "period", kind.alias("compensation_type"),
        "annualized_min", "annualized_max", median.alias("annualized_median"), "country_code",
        "region", "city", squeeze(F.col("evidence")).alias("evidence"),
        F.lit(as_of).cast("timestamp").alias("observed_at"),
        F.lit(as_of).cast("timestamp").alias("created_at"))
