"""Every registered query against its oracle on the smallest tables, and plan checks."""

import pytest
from compare import check, duck

from vacantry.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# queries whose rule hits nothing in so few rows; both sides must agree on that
EMPTY_HERE: set[str] = set()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    ok, message = check(spark, con, SF, name, catalog.QUERIES, catalog.ORACLES)
    assert ok or (message == "no rows" and name in EMPTY_HERE), message


STREAMS = [n for n in catalog.QUERIES if "_stream" in n]


def test_no_query_pairs_rows_without_a_key(spark):
    offenders = []
    for name, run in catalog.QUERIES.items():
        if name in STREAMS:
            continue
        plan = run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        if "NestedLoop" in plan or "Cartesian" in plan:
            offenders.append(name)
    assert not offenders


def test_predicates_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["hit_rates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert "l_comment" not in plan and "l_tax" not in plan


@pytest.mark.parametrize("name", ["advertiser_pay", "preferred_jsonld_pay"])
def test_heavy_work_on_small_tables_is_dealt_over_the_cores(spark, name):
    # each of these tables is one file of one row group, which one task would work off
    assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_portal_markers_share_one_text(spark):
    # host and text were put together anew for every marker
    plan = catalog.QUERIES["listing_stubs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("concat_ws") <= 2


def test_postings_of_the_enrichment_pass_are_dealt_over_the_cores(spark):
    from vacantry.plans.report_queries import pass_inputs
    from vacantry.plans.testbed import Testbed

    assert pass_inputs(Testbed(spark, SF))[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["salary_lines", "scan_queue", "latest_observation_per_job"])
def test_top_rows_carry_only_the_columns_shown(spark, monkeypatch, name):
    # the picked row was shuffled with every column of an observation
    from pyspark.sql import functions as F

    from vacantry.operators import selection

    monkeypatch.setattr(selection, "with_position", lambda df, *order: df.withColumn("position", F.lit(1)))
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" in plan and "matched_by" not in plan


def test_block_wording_shares_one_visible_text(spark):
    # the visible text was made anew for every wording
    plan = catalog.QUERIES["page_states"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!--") == 1


@pytest.mark.parametrize("name", ["page_states", "resume_languages", "resume_titles"])
def test_text_rules_are_dealt_over_the_cores(spark, name):
    assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_levels_are_read_on_lines_that_name_a_language(spark):
    # every line of a resume was split into words and tried for all levels
    plan = catalog.QUERIES["resume_languages"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS _names") > plan.index("AS _rows")  # printed from the top: names are found below the rows


def test_dealt_parts_follow_the_shuffle_partitions(spark):
    from vacantry.plans.testbed import Testbed

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert Testbed(spark, SF).dealt("pages", "page_id").rdd.getNumPartitions() == 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
