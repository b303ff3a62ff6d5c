import numpy as np
from conftest import PANEL, as_dicts, frames, line

from panelspark import Warehouse
from panelspark.functions import bootstrap
from panelspark.operators.marts import scored_households, trip_baskets
from panelspark.plans import warehouse as plans

#: a basket of two households and weeks, a basket without an id and one without sales
ODD = [line(1, 40, 2, 1, 1, 3, coupon=1), line(2, 40, 9, 2, 1, 4), line(None, 41, 3, 1, 1, 5)]
ODD += [(1, None, *line(1, 42, 2, 1, 1, 3)[2:]), (*line(2, 43, 2, 1, 1, 3)[:5], None, *line(2, 43, 2, 1, 1, 3)[6:])]


def odd_panel(spark):
    return Warehouse(spark, frames(spark, transaction_data=PANEL["transaction_data"] + ODD))


def test_scores_and_basket_values_from_trips_are_those_of_the_marts(spark):
    w = odd_panel(spark)
    columns = trip_baskets(w).columns
    wanted = w["fct_basket"].select(*columns)
    assert sorted(map(str, trip_baskets(w).collect())) == sorted(map(str, wanted.collect()))
    scored, summary = scored_households(w), w["mart_household_summary"]
    assert as_dicts(scored, "household_key") == as_dicts(summary.select(*scored.columns), "household_key")
    labels = as_dicts(w["mart_customer_segment"], "household_key")
    for key, row in as_dicts(w["household_scores"], "household_key").items():
        assert all(labels[key][c] == v for c, v in row.items() if c != "has_demographics")


def test_counts_of_labels_do_not_read_products_bought(spark):
    w = odd_panel(spark)
    for name in ("snapshot_trajectories", "snapshot_segments", "finding_segment_rollup"):
        assert "mart_household_weekly" not in w.inputs and w[name].count()
    found = {(r.segment, r.trajectory): r.households for r in w["snapshot_trajectories"].collect()}
    assert "mart_household_weekly" not in w.inputs
    rows = w["mart_customer_segment"].collect()
    assert found == {k: [(r.segment, r.trajectory) for r in rows].count(k) for k in found}
    assert sum(found.values()) == len(rows)


def test_steps_over_many_lines_take_more_partitions(spark, monkeypatch):
    monkeypatch.setattr(plans, "LINES_A_TASK", 1)
    w = odd_panel(spark)
    assert w.spread(w["lines"], "basket_id").rdd.getNumPartitions() == w.bounds.lines == 12
    few = Warehouse(spark, frames(spark))
    wanted = as_dicts(few["stats_basket_effect_size"], "segment")
    monkeypatch.undo()
    usual = as_dicts(Warehouse(spark, frames(spark))["stats_basket_effect_size"], "segment")
    assert str(wanted) == str(usual)


def test_draws_of_a_reused_generator_are_those_of_a_new_one():
    generator = np.random.Generator(np.random.Philox(key=bootstrap.SEED))
    origin = generator.bit_generator.state
    for cell, n in ((-5, 1), (7, 40), (2**62, 3), (7, 40)):
        key = np.array([bootstrap.SEED, cell % 2**64], dtype=np.uint64)
        fresh = np.random.Generator(np.random.Philox(key=key)).poisson(n, bootstrap.DRAWS)
        assert (bootstrap._draws(generator, origin, cell, n) == fresh).all()
