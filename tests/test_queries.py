"""A sample of queries against DuckDB, and plan checks, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelspark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")

SAMPLE = [
    "mart_panel_weekly",
    "mart_household_weekly",
    "mart_customer_segment",
    "mart_category_weekly",
    "mart_category_household",
    "mart_promotion_category_week",
    "mart_campaign_household",
    "mart_cross_category_pair",
    "analysis_household_engagement_sequence",
    "analysis_category_materiality",
    "analysis_segment_stability",
    "qa_source_contract_audit",
    "measures_core",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def normal(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    wanted = rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert normal(got.select(*columns).collect()) == normal(wanted)


def test_every_query_is_named_once_and_most_have_sql():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names
    assert set(catalog.QUERIES) - sql <= {"stats_basket_by_segment", "stats_promotion_state"}


def plan(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["mart_panel_weekly", "mart_store_weekly", "mart_brand_category"])
def test_plans_have_no_cross_join_and_read_few_columns(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "l_shipdate" not in text and "o_totalprice" not in text and "p_retailprice" not in text


def test_segment_free_measures_assign_no_segments(spark):
    catalog.forget()
    w = catalog.warehouse(spark, FOLDER)
    assert w["measures_window_13w"] is not None
    assert "household_scores" not in w._tables


def test_measures_reach_attributes_along_the_star(panel):
    from panelspark.operators.measures import UnreachableError, evaluate

    rows = evaluate(panel, ["Baskets"], ["dim_household.age_desc"]).collect()
    assert {r.age_desc: r.value for r in rows} == {"25-34": 2.0, None: 4.0}
    some = evaluate(panel, ["Baskets"], where="dim_household.age_desc = '25-34'").collect()
    assert [r.value for r in some] == [2.0]
    with pytest.raises(UnreachableError, match="Decision Alert Count"):
        evaluate(panel, ["Baskets", "Decision Alert Count"], ["dim_household.age_desc"])
