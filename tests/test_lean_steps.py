from conftest import PANEL, as_dicts, frames, line

from panelspark import Warehouse
from panelspark.operators.measures import RELATIONSHIPS, fact_keys


def test_redemption_counts_read_neither_trips_nor_segments(spark):
    w = Warehouse(spark, frames(spark))
    assert w["stats_campaign_chi_square"].count() == 1 and w["campaign_kpi_scope"].count() == 1
    assert not {"lines", "household_scores", "mart_campaign_household"} & set(w.inputs)
    columns = w["redeeming_exposures"].columns
    wanted = as_dicts(w["mart_campaign_household"].select(*columns), "household_key", "campaign_id")
    assert as_dicts(w["redeeming_exposures"], "household_key", "campaign_id") == wanted


def test_promotion_sales_are_those_of_the_mart_and_group_lines_once(spark):
    w = Warehouse(spark, frames(spark))
    keys = ("category_key", "commodity", "week_number", "promo_state_group")
    wanted = w["mart_promotion_category_week"].drop("panel_buying_households", "panel_baskets")
    assert as_dicts(w["promotion_amounts"], *keys) == as_dicts(wanted, *keys)
    assert w["stats_promotion_state"].count()
    values = w["promotion_values"]._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in values


def test_category_losses_count_each_window_on_one_row_per_household(spark):
    w = Warehouse(spark, frames(spark))
    mart = w["mart_category_household_weekly"].collect()
    lost = {r.category_key: r for r in w["category_losses"].collect()}
    weeks = [r.week_number for r in w["stg_transaction"].collect()]
    assert max(weeks) - min(weeks) < w.rules.window_weeks  # both windows hold every week
    for key in {r.category_key for r in mart}:
        rows = [r for r in mart if r.category_key == key]
        people = {r.household_key for r in rows if r.household_key is not None}
        assert lost[key].early_buying_households == lost[key].late_buying_households == len(people)
        assert lost[key].late_category_baskets == sum(r.category_baskets for r in rows)
        assert lost[key].early_penetration == len(people) / 3
    assert "mart_category_household_weekly" not in w.inputs["category_losses"]


def test_relationships_check_the_keys_of_the_marts(spark):
    odd = [line(None, 50, 3, 1, 1, 5), line(2, 51, 9, 77, 1, 5, store=4), line(2, 51, 9, 1, 1, 5, store=4)]
    w = Warehouse(spark, frames(spark, transaction_data=PANEL["transaction_data"] + odd))
    facts = {}
    for (_, key), names in RELATIONSHIPS.items():
        for fact in names:
            facts.setdefault(fact, []).append(key)
    for fact, keys in facts.items():
        got, wanted = (sorted(map(str, df.select(*keys).collect())) for df in (fact_keys(w, fact), w[fact]))
        assert got == wanted, fact
    checks = as_dicts(w["star_relationships"], "from_table", "to_table")
    for (dim, key), names in RELATIONSHIPS.items():
        for fact in names:
            lost = w[fact].join(w[dim].select(key).distinct(), key, "left_anti").count()
            assert checks[dim, fact]["orphan_rows"] == lost, (dim, fact)
    assert checks["dim_household", "mart_basket"]["status"] == "REVIEW"
