from conftest import as_dicts


def test_baskets_read_without_their_variety_are_grouped_once_and_need_no_products(panel):
    amounts = panel["fct_basket"].select("basket_id", "household_key", "basket_net_spend")
    plan = amounts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
    assert as_dicts(panel["fct_basket"], "basket_id")[10]["basket_distinct_products"] == 2
