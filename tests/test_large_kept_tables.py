import re

import pytest
from conftest import as_dicts, frames

from panelspark import Warehouse
from panelspark.operators import facts
from panelspark.plans import warehouse


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hash_joins(df, column):
    """Broadcast joins on ``column``, as Spark would plan them from the sizes of files."""
    return re.findall(rf"BroadcastHashJoin \[(?:\w*\()?{column}#", physical(df))


@pytest.mark.parametrize("name", ["fct_basket", "product_lines", "category_lines", "governed_lines", "mart_household_weekly"])
def test_products_of_many_rows_are_not_sent_by_the_size_of_their_files(spark, monkeypatch, name):
    """At 360 times sf0.1 the kept products are 8 MB of files and 558 MB of rows."""
    def build():
        return Warehouse(spark, frames(spark)).fork(("products", "transaction_data"))[name]

    assert hash_joins(build(), "product_id")
    monkeypatch.setattr(warehouse, "BROADCAST_ROWS", 0)
    assert not hash_joins(build(), "product_id")


def test_exposures_and_households_are_not_sent(spark):
    kept = Warehouse(spark, frames(spark)).stored()
    assert not hash_joins(kept["mart_campaign_household"], "household_key")
    assert not hash_joins(kept["mart_basket"], "household_key")


def test_panel_amounts_come_from_written_trips(spark):
    w, plain = Warehouse(spark, frames(spark)), Warehouse(spark, frames(spark))
    w["household_segment"]
    assert "trips-" in physical(w["mart_panel_weekly"])
    assert w["mart_panel_weekly"].schema == plain["mart_panel_weekly"].schema
    assert as_dicts(w["mart_panel_weekly"], "week_number") == as_dicts(plain["mart_panel_weekly"], "week_number")


@pytest.mark.parametrize("most", [facts.MOST_NAMES, 1])
def test_names_are_counted_alike_as_bits_and_as_sets(spark, monkeypatch, most):
    monkeypatch.setattr(facts, "MOST_NAMES", most)
    w = Warehouse(spark, frames(spark))
    got = as_dicts(w["fct_basket"], "basket_id")
    counts = ("basket_distinct_products", "basket_distinct_departments", "basket_distinct_commodities")
    assert {b: tuple(r[c] for c in counts) for b, r in got.items()} == {
        10: (2, 1, 2), 11: (1, 1, 1), 20: (1, 1, 1), 21: (1, 1, 1), 30: (1, 0, 1), 31: (1, 0, 0),
    }
    plan = w["fct_basket"]._jdf.queryExecution().executedPlan().toString()
    assert ("collect_set" in plan) == (most == 1)
