"""Domain views over the star-schema test tables.

The test data holds no postings, so each domain table is an expression over one base
table: every row of the base becomes one domain row.  ``View.duck`` gives the same view
as DuckDB text for the oracle.  Free text exists on the Spark side only; the oracle works
from the numbers the text was built from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-15 12:00:00"


# instants are stored without a zone and read as UTC, so time predicates reach the scan
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def choose(on: str, *values: str | None) -> str:
    """CASE over ``on`` modulo the number of values."""
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values))
    return f"CASE CAST({on} AS BIGINT) % {len(values)} {arms} END"


def words(on: str, *values: str | None) -> str:
    return choose(on, *[None if v is None else "'" + v.replace("'", "''") + "'" for v in values])


@dataclass(frozen=True)
class View:
    """Base table, columns (name, Spark expression, DuckDB expression), optional filter.

    A DuckDB expression of None leaves the column out of the oracle.
    """

    base: str
    columns: tuple
    where: str | None = None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, self.base)
        if self.where:
            df = df.filter(self.where)
        return df.selectExpr(*[f"{c[1]} AS {c[0]}" for c in self.columns])

    def duck(self) -> str:
        picks = []
        for c in self.columns:
            expr = c[1] if len(c) == 2 else c[2]
            if expr is not None:
                picks.append(f'{expr} AS "{c[0]}"')
        where = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {', '.join(picks)} FROM {self.base}{where}"


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def plus_days(ts: str, n: str) -> tuple[str, str]:
    return f"{ts} + make_dt_interval(CAST({n} AS INT))", f"{ts} + to_days(CAST({n} AS INT))"


SOURCES = ("linkedin", "indeed", "external")
TITLES = (
    "Senior Software Engineer", "Solutions Architect (Remote)", "Enterprise AI Architect",
    "Engineering Manager", "Data Scientist", "Sales Manager", "Junior Developer",
    "Principal Engineer – London", "Head of Platform", "Landscape Architect", "Product Manager",
    "Nurse",
)
LABELS = (
    "Primary role", "adjacent-role", "LEADERSHIP PROGRESSION", "Conditional", "Out of scope",
    "Unclassified", "Data-domain stretch", "wizard of data", "", None, "Primary role",
)

_k = "o_orderkey"
POSTINGS = View("orders", (
    ("source", words(_k, *SOURCES)),
    ("job_id", text(_k)),
    ("posting_key", _k),
    ("title", words("o_custkey", *TITLES)),
    ("company", f"'Company ' || {text('o_custkey % 97')}"),
    ("country_code", words("o_custkey", "GB", "IE", "NL", "DK", "US", "DE", None)),
    ("region", f"CASE WHEN {_k} % 4 = 0 THEN 'Region ' || {text(_k + ' % 5')} END"),
    ("city", f"CASE WHEN {_k} % 3 = 0 THEN 'City ' || {text(_k + ' % 11')} END"),
    ("url", f"'https://example.com/jobs/' || {text(_k)}"),
    ("description_text", f"CASE {_k} % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' "
                         f"ELSE 'Role number ' || {text(_k)} || ' in our team' END"),
    ("job_posting_date", f"""CASE {_k} % 8
        WHEN 0 THEN date_format(o_orderdate - make_dt_interval(CAST({_k} % 50 AS INT)), 'yyyy-MM-dd')
        WHEN 1 THEN 'London · Reposted ' || {text(_k + ' % 45')} || ' days ago · 47 people clicked apply'
        WHEN 2 THEN 'Posted ' || {text(_k + ' % 9 + 1')} || ' weeks ago'
        WHEN 3 THEN {text(_k + ' % 23 + 1')} || ' hours ago'
        WHEN 4 THEN 'Reposted ' || {text(_k + ' % 11 + 1')} || ' months ago'
        WHEN 5 THEN 'Posted yesterday' WHEN 6 THEN NULL ELSE 'Be an early applicant' END""", None),
    ("created_at", "o_orderdate"),
    ("updated_at", *plus_days("o_orderdate", f"{_k} % 7")),
    ("role_label", words(_k, *LABELS)),
    ("role_confidence", f"CAST({_k} % 100 AS DOUBLE) / 100"),
    ("role_reason", words(_k, '{"summary":"Matches title","evidence":["a","b"],"gaps":[]}',
                          "plain reason", None)),
    ("taxonomy_version", words(_k, "3", "2", "", None)),
    ("application_status", words(_k, "applied", "withdrawn", "saved", "saved", "saved", "saved")),
    ("applied_at", *[f"CASE WHEN {_k} % 12 = 0 THEN {e} END" for e in plus_days("o_orderdate", "3")]),
    ("language_reason", words(_k, "scrape_failed: timeout", "FAIL: Could not extract JD from page",
                              None, None, None, None, None)),
))

_fit = f"CAST(({_k} * 37) % 1001 AS DOUBLE) / 10"
MATCHES = View("orders", (
    ("search_id", "o_orderpriority"),
    ("source", words(_k, *SOURCES)),
    ("job_id", text(_k)),
    ("fit_score", _fit),
    ("cta", f"CASE WHEN {_fit} >= 60 AND o_custkey % 5 <> 0 THEN 'Apply' "
            f"WHEN {_fit} >= 50 THEN 'Maybe' ELSE 'Skip' END"),
    ("stretch_label", words(_k, "Core fit", "Stretch", "Major domain stretch", "Blocked")),
    ("must_total", f"{_k} % 9"),
    ("must_matched", f"{_k} % 10"),
    ("nice_total", f"{_k} % 5"),
    ("nice_matched", f"{_k} % 4"),
    ("created_at", *plus_days("o_orderdate", "1")),
), "o_totalprice >= 30000")

_l = "l_orderkey"
_labels = ("posted_exact", "external_exact", "api_exact_match", "aggregated_exact_title",
           "company_benchmark", "estimated_market", "official_baseline", "unknown_exact",
           "unknown_estimate")
OBSERVATIONS = View("lineitem", (
    ("job_source", words(_l, *SOURCES)),
    ("job_id", text(_l)),
    ("observation_id", f"{text('l_linenumber')} || '-' || {text('l_partkey')} || '-' || "
                       f"{text('l_suppkey')} || '-' || {text('CAST(floor(l_extendedprice * 100) AS BIGINT)')}"),
    ("data_source", words("l_suppkey", "itjobswatch", "indeed", "levels_fyi", "robert_half",
                          "salaryexpert", "linkedin")),
    ("data_source_url", f"'https://example.com/pay/' || {text('l_suppkey')}"),
    ("benchmark_id", f"CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'b' || {text('l_partkey')} END"),
    ("confidence_label", words("l_suppkey", *_labels)),
    ("matched_by", words("l_linenumber", "exact_job", "role_location", "manual", "guess")),
    ("is_posted", "l_returnflag = 'R'"),
    ("is_predicted", "l_linestatus = 'F'"),
    ("currency", words("l_partkey", "GBP", "EUR", "USD", "CHF")),
    ("amount_min", "CAST(floor(l_extendedprice * CAST(0.9 AS DOUBLE)) AS DOUBLE)"),
    ("amount_max", "CAST(floor(l_extendedprice * CAST(1.1 AS DOUBLE)) AS DOUBLE)"),
    ("amount_median", "l_extendedprice"),
    ("period", words("l_linenumber", "year", "year", "month", "day", "hour", "week")),
    ("compensation_type", words("l_linenumber", "base_salary", "total_compensation", "base_salary",
                                "contract_rate")),
    ("annualized_median", "l_extendedprice"),
    ("country_code", words("l_suppkey", "GB", "IE", "NL", "DK", "US")),
    ("region", f"CASE WHEN l_suppkey % 4 = 0 THEN 'Region ' || {text('l_suppkey % 3')} END"),
    ("city", f"CASE WHEN l_partkey % 3 = 0 THEN 'City ' || {text('l_partkey % 5')} END"),
    ("observed_at", "l_shipdate"),
    ("created_at", *plus_days("l_shipdate", "l_linenumber")),
))

_bench = (
    ("benchmark_id", f"'b' || {text('p_partkey')}"),
    ("normalized_title", "lower(p_type) || '_role'"),
    ("seniority", words("p_size", "senior", "_any", "lead", None)),
    ("industry", words("p_size", "software", None, "finance")),
    ("country_code", words("p_size", "GB", "IE", "NL", "DK", "US")),
    ("region", "''"),
    ("city", words("p_size", "London", "", "Leeds")),
    ("currency", words("p_size", "GBP", "EUR", "EUR", "DKK", "USD")),
    ("period", "'year'"),
    ("compensation_type", words("p_size", "base_salary", "total_compensation")),
    ("amount_median", "p_retailprice"),
    ("payload", "'{\"b\":' || CAST(p_size AS STRING) || ',\"a\":{\"y\":1,\"x\":\"' || p_brand || '\"}}'"),
    ("fetched_at", *plus_days("TIMESTAMP '2001-06-01 00:00:00'", "p_partkey % 90")),
)
BENCHMARKS = View("part", _bench)

STAGE_EVENTS = View("events", (
    ("id", "event_id"),
    ("job_source", words("user_id", *SOURCES)),
    ("job_id", text("user_id")),
    ("stage", "CASE event_type WHEN 'click' THEN 'applied' WHEN 'view' THEN 'screening' "
              "WHEN 'signup' THEN 'interview' WHEN 'error' THEN 'rejected' ELSE 'offer' END"),
    ("note", "CASE WHEN value < 5 THEN 'backfilled from log' WHEN value < 20 THEN NULL ELSE 'by hand' END"),
    ("occurred_at", "ts"),
))

FETCH_LOG = View("events", (
    ("id", "event_id"),
    ("source", f"'origin' || {text('user_id % 3')}"),
    ("key", f"'page' || {text('user_id')}"),
    ("state", "CASE event_type WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'rate_limited' "
              "WHEN 'view' THEN 'healthy' WHEN 'click' THEN 'empty' ELSE 'login_required' END"),
    ("new_ids", "CASE WHEN event_type IN ('view', 'signup', 'error') THEN 0 ELSE user_id END"),
    ("at", "ts"),
))

RUNS = View("customer", (
    ("job_source", words("c_custkey", *SOURCES)),
    ("job_id", text("c_custkey")),
    ("status", words("c_custkey", "submitted", "failed", "success", "pending")),
))

_c = "c_custkey"
STATE = View("customer", (
    ("job_source", words(_c, *SOURCES)),
    ("job_id", text(_c)),
    ("exact_status", words(_c, "found", "not_found", "error", "pending", "not_found")),
    ("exact_attempts", f"CAST({_c} % 7 AS INT)"),
    ("exact_next_retry_at", *[f"CASE WHEN {_c} % 5 IN (1, 2) THEN {e} END" for e in
                              plus_days("TIMESTAMP '2001-08-01 00:00:00'", f"{_c} % 30")]),
    ("exact_last_attempt_at", "CAST(NULL AS TIMESTAMP)"),
    ("exact_error", "CAST(NULL AS STRING)"),
    ("benchmark_status", words(_c, "pending", "found", "not_found")),
    ("benchmark_attempts", f"CAST({_c} % 3 AS INT)"),
    ("benchmark_next_retry_at", "CAST(NULL AS TIMESTAMP)"),
    ("benchmark_last_attempt_at", "CAST(NULL AS TIMESTAMP)"),
    ("benchmark_error", "CAST(NULL AS STRING)"),
))

VIEWS = {
    "postings": POSTINGS, "matches": MATCHES, "observations": OBSERVATIONS,
    "benchmarks": BENCHMARKS, "stage_events": STAGE_EVENTS, "fetch_log": FETCH_LOG,
    "runs": RUNS, "state": STATE,
}


class Testbed:
    """Domain views of one test-data folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return VIEWS[name].spark(self.spark, self.sf_dir)
        raise AttributeError(name)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def dealt(self, name: str, key: str, *columns: str) -> DataFrame:
        """A table dealt by key over all cores, for work that costs far more than its rows have bytes.

        A table of few bytes is one file of one or two row groups, which one or two tasks would read and work off.
        Large tables get as many parts as the session's shuffles, so that a part need not grow with the table.
        """
        rows = self.table(name).select(*columns) if columns else self.table(name)
        parts = max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return rows.repartition(parts, key)


def with_views(sql: str, *names: str, **extra: str) -> str:
    """Oracle text: the named views (and extra ones) as common tables before ``sql``."""
    parts = [f"{n} AS ({VIEWS[n].duck()})" for n in names]
    parts += [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {sql}"
