"""Row rules on literal rows: freshness, roles, requirements, pay, pages, titles."""

import pytest
from pyspark.sql import functions as F

from vacantry.functions import pages as H
from vacantry.functions import text as T
from vacantry.functions import titles as X
from vacantry.functions.keys import canonical_json, number_text
from vacantry.operators import candidates
from vacantry.operators import extractors as E
from vacantry.operators import requirements as R
from vacantry.operators import roles as C
from vacantry.operators import salary as S
from vacantry.plans.reports import freshness

NOW = "2026-07-21 12:00:00"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("posted,created,cutoff,verdict,method", [
    ("2026-03-02T13:01:27.407Z", "2026-06-07 15:26:36", 30, "stale", "posting_date_iso"),
    ("London · Reposted 4 days ago · 47 people", "2026-07-20 07:47:58", 30, "fresh", "relative_day"),
    ("Reposted 38 minutes ago", "2026-07-20 08:09:57", 30, "fresh", "relative_minute"),
    ("Posted yesterday", "2026-07-02 05:25:02", 30, "fresh", "yesterday"),
    (None, "2026-05-30 00:00:00", 30, "stale", "no_signal_but_discovery_exceeds_cutoff"),
    (None, "2026-07-15 00:00:00", 30, "unverified", "no_signal"),
    ("2026-06-23", "2026-07-21 00:00:00", 30, "fresh", "posting_date_iso"),
    ("2026-06-23", "2026-07-21 00:00:00", 14, "stale", "posting_date_iso"),
])
def test_freshness(spark, posted, created, cutoff, verdict, method):
    df = spark.createDataFrame([(posted, created)], "job_posting_date string, c string").select(
        "job_posting_date", F.to_timestamp("c").alias("created_at"))
    row = one(freshness(df, NOW, cutoff))
    assert (row.verdict, row.age_method) == (verdict, method)


TAX = C.Taxonomy(primary=("Platform Architect",), adjacent=("Architect", "C++ Lead"), leadership=("Head of Data",),
                 conditional=("Data Architect",), excluded_titles=("intern",), excluded_duties=("quota",),
                 families=(C.TitleFamily("bim", ("bim", "riba"), ("software",)),))


@pytest.mark.parametrize("title,desc,label,conf", [
    ("Senior Platform  Architect", "x", "Primary role", 0.9),
    ("Data Architect", None, "Conditional", 0.65),
    ("C++ Lead (m/f)", "x", "Adjacent role", 0.9),
    ("Architecture fan", "x", "Unclassified", 0.1),
    ("Platform Architect intern", "x", "Out of scope", 0.9),
    ("Platform Architect", "carry a Quota daily", "Out of scope", 0.9),
    ("BIM Architect", " ", "Out of scope", 0.65),
    ("BIM Software Architect", "x", "Adjacent role", 0.9),
    ("Ünïcode Architecté", "x", "Unclassified", 0.1),
])
def test_classify(spark, title, desc, label, conf):
    df = spark.createDataFrame([(title, desc)], "title string, description_text string")
    row = one(C.classify(df, TAX))
    assert (row.role_label, row.role_confidence) == (label, conf)


VOCAB = R.Vocabulary.of([{"term": "kafka"}, {"term": "c++"}, {"term": ".net"}, {"term": "machine learning"},
                         {"term": "kubernetes", "aliases": ["k8s"]}])


def criteria(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return one(R.mandatory_criteria(df, F.col("t"), VOCAB)).criteria


def test_symbol_terms_and_longest_phrase(spark):
    got = criteria(spark, "Must have C++, .NET and machine  learning.")
    assert got[0].terms == [".net", "c++", "machine learning"]


def test_whole_sentence_when_nothing_is_recognized(spark):
    got = criteria(spark, "A driving licence is required")
    assert [(c.kind, c.terms) for c in got] == [("skill", ["a driving licence is required"])]


def test_repeats_count_once_and_limits_are_asked_for(spark):
    text = " ".join(f"Must have knowledge of topic{i}." for i in range(40)) + " Must have knowledge of topic0."
    assert [c.terms[0] for c in criteria(spark, text)] == [f"topic{i}" for i in range(40)]
    df = spark.createDataFrame([("s", "1", "Cook", text, "GB", "Primary role")],
                               "source string, job_id string, title string, description_text string, country_code string, role_label string")
    first = one(R.mandatory_criteria(df, F.col("description_text"), VOCAB, limits=R.STATED)).criteria
    assert [c.terms[0] for c in first] == [f"topic{i}" for i in range(12)]
    assert one(R.score(df, R.Candidate(), VOCAB)).must_total == 40
    assert one(R.score(df, R.Candidate(), VOCAB, limits=R.STATED)).must_total == 12


def test_nice_to_have_is_never_mandatory(spark):
    assert criteria(spark, "Kafka experience with k8s is a plus, required or not.") == []


def test_no_criteria_is_insufficient_evidence(spark):
    df = spark.createDataFrame([("s", "1", "Cook", "Nice place.", "GB", "Primary role")],
                               "source string, job_id string, title string, description_text string, country_code string, role_label string")
    row = one(R.score(df, R.Candidate(), VOCAB))
    assert (row.fit_score, row.assessment_status, row.cta, row.stretch_label) == (0.0, "insufficient_evidence", "Skip", "Blocked")


def test_unknown_authorization_does_not_block(spark):
    df = spark.createDataFrame([("s", "1", "Cook", "No sponsorship available.", "FR", "Primary role")],
                               "source string, job_id string, title string, description_text string, country_code string, role_label string")
    row = one(R.score(df, R.Candidate(authorization={"US": "no"}), VOCAB))
    assert row.must_total == 1 and row.must_matched == 0 and row.blockers == []


def test_search_id_ignores_row_order(spark):
    rows = [("s", str(i), f"t{i}", "c", "GB" if i % 2 else "IE", "d") for i in range(200)]
    cols = "source string, job_id string, title string, company string, country_code string, description_text string"
    a = one(R.search_id(spark.createDataFrame(rows, cols).repartition(1), "Data Lead", "p"))
    b = one(R.search_id(spark.createDataFrame(rows[::-1], cols).repartition(7), "Data Lead", "p"))
    c = one(R.search_id(spark.createDataFrame(rows[1:], cols), "Data Lead", "p"))
    assert a == b and a.search_id != c.search_id and a.search_id.startswith("score-data-lead-gb-ie-")


def pay(spark, text, ld=None):
    df = spark.createDataFrame([(text, ld)], "t string, ld string")
    return [(r.amount_min, r.amount_max, r.currency, r.period, r.compensation_type, r.extraction_status)
            for r in S.parse_salary(df, "t", "ld").orderBy("ordinal").collect()]


PAY_CASES = [
    # both ends of a k range are scaled, also with an en dash
    ("$120k–$150k", [(120000.0, 150000.0, "USD", "year", "base", None)]),
    ("£40,000 - £50,000", [(40000.0, 50000.0, "GBP", "year", "base", None)]),
    # a dash elsewhere in the sentence does not make a single amount a range
    ("Great team – we pay £60,000 plus bonus", [(60000.0, None, "GBP", "year", "base", None)]),
    ("Fee £50 only", [(None, None, None, None, None, "absent")]),
    ("£1.500/day", [(1500.0, None, "GBP", "day", "base", None)]),
    ("AED 30,000", [(30000.0, None, "AED", "month", "base", None)]),
    ("CHF 120'000 – 150'000", [(120000.0, 150000.0, "CHF", "year", "base", None)]),
    ("Competitive salary, DOE", [(None, None, None, None, None, "competitive")]),
    ("Pay DOE", [(None, None, None, None, None, "doe")]),
    ("x\nPeople also viewed\n£90,000 - £95,000", [(None, None, None, None, None, "absent")]),
    ("", [(None, None, None, None, None, "absent")]),
    (None, [(None, None, None, None, None, "absent")]),
    ("£50,000 - £60,000 OTE £80,000", [(50000.0, 60000.0, "GBP", "year", "base", None),
                                       (80000.0, None, "GBP", "year", "ote_total", None)]),
]


def test_pay_text(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(PAY_CASES)], "i int, t string")
    got = {}
    for r in S.parse_salary(df, "t").orderBy("i", "ordinal").collect():
        got.setdefault(r.i, []).append((r.amount_min, r.amount_max, r.currency, r.period, r.compensation_type, r.extraction_status))
    for i, (text, want) in enumerate(PAY_CASES):
        assert got[i] == want, text


def test_jsonld_replaces_text_pay(spark):
    ld = '{"@type":"JobPosting","baseSalary":{"value":{"minValue":10,"maxValue":"20.5","unitText":"HOUR"},"currency":"USD"}}'
    assert pay(spark, "£40,000 - £50,000", ld) == [(10.0, 20.5, "USD", "hour", "base", None)]
    assert pay(spark, "£40,000 - £50,000", '{"@type":"JobPosting","baseSalary":null}')[0][0] == 40000.0


def test_filter_on_staged_columns_stays_small(spark):
    df = spark.createDataFrame([("£40,000 - £50,000",)], "t string")
    plan = S.salary_candidates(df, "t").filter(F.size("pay") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40000


def test_titles(spark):
    rows = [("Solutions Architect", "solutions_architect"), ("Architect Solutions", "architect solutions"),
            ("Sr. C++ Développeur – Remote", "senior cpp developpeur"), ("ML Engineers II", "machine_learning engineer 2")]
    df = spark.createDataFrame(rows, "t string, want string").select("want", X.normalize_title(F.col("t")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_html_entities_and_lines(spark):
    html = "<p>Caf&#233; &amp;amp; &#x20AC;5</p><script>no()</script><ul><li>a</li><li>a</li></ul>"
    df = spark.createDataFrame([(html,)], "h string").select(T.html_to_text(F.col("h")).alias("t"))
    row = one(df.withColumn("lines", T.text_lines(F.col("t"))))
    assert row.lines == ["Café &amp; €5", "a"]


def test_job_posting_is_found_depth_first(spark):
    html = ('<script type="application/ld+json">{"x":{"y":[{"@type":"JobPosting","title":"deep"}]}}</script>'
            '<script type="application/ld+json">{"@type":"JobPosting","title":"second"}</script>')
    df = spark.createDataFrame([(html,)], "h string").withColumn("p", H.find_job_posting(H.json_ld(F.col("h"))))
    assert one(df.select(F.try_variant_get("p", "$.title", "string").alias("t"))).t == "deep"


def test_job_posting_is_found_at_any_depth(spark):
    block = '{"@type":"JobPosting","title":"below"}'
    for _ in range(40):
        block = '{"@type":"List","items":[1,{"item":%s}]}' % block
    html = f'<script type="application/ld+json">{block}</script><script type="application/ld+json">{{"@type":"JobPosting","title":"second"}}</script>'
    df = spark.createDataFrame([(html,), ("no blocks",)], "h string").withColumn("p", H.find_job_posting(H.json_ld(F.col("h"))))
    assert [r.t for r in df.select(F.try_variant_get("p", "$.title", "string").alias("t")).collect()] == ["below", None]


def test_unknown_benchmark_sources_keep_their_row(spark):
    from vacantry.operators.extractors import extract_benchmarks

    pages = spark.createDataFrame([("x", "nowhere", "<p>1</p>", "t"), ("y", None, None, "t")], "id string, data_source string, html string, title string")
    got = extract_benchmarks(pages).collect()
    assert len(got) == 2 and all(r.amount_min is None for r in got)


def test_work_folder_needs_a_shared_place_on_a_cluster():
    from vacantry.session import work_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session(), "x")


def test_percentiles_stop_at_the_next_table(spark):
    def table(rows):
        return "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in rows) + "</table>"

    role = [("10th Percentile", "£71,349"), ("25th Percentile", "£80,000"), ("Median annual salary (50th)", "£90,000"),
            ("75th Percentile", "£100,000"), ("90th Percentile", "£102,600"), ("Number of salaries quoted", "127")]
    market = [("10th Percentile", "£1"), ("25th Percentile", "£2"), ("Median annual salary (50th)", "£3")]
    df = spark.createDataFrame([(table(role) + table(market),), (table(role[:1] + [("25th Percentile", "-")]),)], "html string")
    full, sparse = E.percentile_table(df).collect()
    assert (full.p10, full.p25, full.median, full.p75, full.p90, full.sample_size) == (71349, 80000, 90000, 100000, 102600, 127)
    assert sparse.p25 is None and sparse.median is None


def test_canonical_json_sorts_every_level(spark):
    df = spark.createDataFrame([('{"b":1,"a":{"d":2,"c":[{"z":1,"y":2}]}}', '{"a":{"c":[{"y":2,"z":1}],"d":2},"b":1}')], "x string, y string")
    row = one(df.select(canonical_json(F.col("x")).alias("x"), canonical_json(F.col("y")).alias("y"), number_text(F.lit(50000.0)).alias("n")))
    assert row.x == row.y and row.n == "50000"


@pytest.mark.parametrize("title,url,text,searched,state", [
    (None, None, None, False, "healthy"),
    ("", "https://www.linkedin.com/checkpoint/x", "/jobs/view/1 nothing else", False, "healthy"),
    ("", "https://www.linkedin.com/checkpoint/x", "/jobs/view/1 security check", False, "blocked"),
    ("Captcha", "", "a captcha to <b>verify</b>", False, "active_challenge"),
    ("", "", "<body>security<br>check, rate&nbsp;limit", False, "rate_limited"),
    ("", "", "<body><!-- unusual activity -->authwall", False, "login_required"),
    ("", "", "0 results", True, "empty"),
    ("", "", "0 results", False, "healthy"),
])
def test_page_state(spark, title, url, text, searched, state):
    df = spark.createDataFrame([(title, url, text)], "title string, url string, text string")
    assert one(df.select(H.page_state(F.col("title"), F.col("url"), F.col("text"), searched).alias("s"))).s == state


def test_resume_languages_by_section(spark):
    rows = [(1, "French\nLanguages\nSkills\nItalian\nLanguages:\n German \nGermanic\nItalian b2\nExperience"), (2, None), (3, ""),
            (4, "Languages"), (5, "Languages\nΕΛΛΗΝΙΚΆ\n#Dutch\n" + "Spanish " + "x" * 40), (6, "Fluent in Danish\nDanish A1")]
    df = spark.createDataFrame(rows, "resume_id int, text string")
    got = {tuple(r) for r in candidates.languages(df).collect()}
    assert got == {(1, "German", "unspecified"), (1, "Italian", "b2"), (5, "Greek", "unspecified"), (6, "Danish", "c1")}
