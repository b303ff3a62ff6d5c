"""Values worked out by hand on the made-up panel of conftest."""

from collections import defaultdict

import pytest
from conftest import PANEL, as_dicts, frames, line

from panelspark import Thresholds, Warehouse


def test_weekly_panel(panel):
    weeks = as_dicts(panel["mart_panel_weekly"], "week_number")
    assert set(weeks) == {1, 2, 4}
    one = weeks[1]
    assert float(one["panel_net_spend"]) == 17 and one["baskets"] == 2
    assert one["active_households"] == 2 and one["trips_per_household"] == 1
    assert float(one["discount_value"]) == 2 and one["discount_rate"] == pytest.approx(2 / 19)
    assert one["coupon_basket_rate"] == 0.5
    assert float(one["private_label_spend"]) == 8
    assert one["private_label_share"] == pytest.approx(8 / 17)
    assert weeks[4]["private_label_share"] == 0


def test_spines_have_no_gaps(panel):
    assert [r.week_number for r in panel["dim_week"].orderBy("week_number").collect()] == [1, 2, 3, 4]
    assert panel["dim_day"].count() == 24


def test_brand_and_blank_names(panel):
    brands = as_dicts(panel["dim_product"], "product_id")
    assert brands[2]["brand_type"] == "NATIONAL"
    keys = {r.category_key for r in panel["dim_category"].collect()}
    assert keys == {"FOOD|SNACK", "FOOD|DRINK", "Unknown|SNACK", "Unknown|Unknown"}


def test_line_without_product_joins_the_unknown_category(panel):
    rows = as_dicts(panel["mart_category_household_weekly"], "household_key", "week_number")
    assert rows[(3, 4)]["category_key"] == "Unknown|Unknown"


def test_outliers_are_flagged_not_dropped(panel):
    flagged = {(r.household_key, r.day_key) for r in panel["flagged_lines"].collect() if r.quantity_outlier_flag}
    assert flagged == {(2, 24), (3, 22)}
    assert panel["fct_transaction_line"].count() == len(PANEL["transaction_data"])


def test_promotion_states_are_merged_and_zero_sale_rows_kept(panel):
    states = {
        (r.product_id, r.store_id, r.week_number): r.promo_state_group
        for r in panel["fct_promotion_product_store_week"].collect()
    }
    assert states == {
        (1, 1, 1): "none",
        (1, 1, 2): "display_and_mailer",
        (3, 2, 1): "mailer_only",
        (3, 2, 3): "display_only",
        (2, 1, 1): "none",
    }
    mart = panel["mart_promotion_category_week"].collect()
    assert sum(r.product_store_weeks for r in mart) == 5
    assert sum(float(r.panel_sales) for r in mart) == 8 + 2 + 5 + 7
    assert [float(r.panel_sales) for r in mart if r.week_number == 3] == [0]


def test_campaign_windows_null_only_when_unobservable(panel):
    rows = as_dicts(panel["mart_campaign_household"], "household_key", "campaign_id")
    assert all(r["pre_28d_spend"] is None and r["post_28d_spend"] is None for r in rows.values())
    assert float(rows[(1, 1)]["during_spend"]) == 5 and rows[(1, 1)]["during_baskets"] == 1
    assert float(rows[(2, 1)]["during_spend"]) == 7
    assert float(rows[(2, 2)]["during_spend"]) == 0
    assert rows[(1, 1)]["redemption_count"] == 2 and rows[(1, 1)]["redeemed_coupon_flag"]
    # Exposed but never seen buying: no segment and no demographic flag.
    assert rows[(7, 2)]["segment"] is None and rows[(7, 2)]["has_demographics"] is None
    assert rows[(1, 1)]["has_demographics"] is True


def test_campaign_windows_with_short_windows(spark):
    short = Warehouse(spark, frames(spark), Thresholds(pre_days=1, post_short_days=1, post_days=3))
    rows = as_dicts(short["mart_campaign_household"], "household_key", "campaign_id")
    assert float(rows[(1, 1)]["pre_28d_spend"]) == 10 and rows[(1, 1)]["pre_28d_baskets"] == 1
    assert float(rows[(1, 1)]["post_28d_spend"]) == 0


def test_coupon_counts_follow_the_bridge(panel):
    row = panel["mart_coupon_summary"].collect()[0]
    assert (row.redemption_events, row.redeemer_households, row.linked_products) == (4, 1, 2)
    campaign = as_dicts(panel["analysis_coupon_campaign"], "campaign_id")
    assert campaign[1]["redemption_events"] == 2 and campaign[1]["redemption_rate"] == 0.5
    category = as_dicts(panel["analysis_coupon_category"], "campaign_id", "commodity")
    assert category[(1, "SNACK")]["mapped_redemption_events"] == 2
    assert category[(2, "SNACK")]["mapped_redemption_events"] == 0


def test_repeat_needs_a_later_purchase(panel):
    rows = as_dicts(panel["analysis_coupon_repeat_category"], "commodity")
    assert rows["SNACK"]["later_observed_repeat_households"] == 1
    assert rows["SNACK"]["observed_repeat_rate"] == 1


def test_every_household_has_one_segment(panel):
    rows = panel["mart_customer_segment"].collect()
    assert sorted(r.household_key for r in rows) == [1, 2, 3]
    assert all(r.segment for r in rows)


def test_pairs_against_brute_force(spark):
    import random

    random.seed(5)
    lines, baskets = [], defaultdict(set)
    for b in range(300):
        for p in random.sample([1, 2, 3], random.randint(1, 3)):
            lines.append(line(b % 7, b, 1 + b % 20, p, 1, 2))
            baskets[b].add({1: "A", 2: "B", 3: "C"}[p])
    # One basket holds a third of all lines.
    lines += [line(299 % 7, 299, 1 + 299 % 20, 1, 1, 2)] * 300
    baskets[299].add("A")
    product = [(i, 1, "D", "Private", c, "x", "1") for i, c in ((1, "A"), (2, "B"), (3, "C"))]
    w = Warehouse(spark, frames(spark, transaction_data=lines, product=product))
    got = as_dicts(w["mart_cross_category_pair"], "commodity_a", "commodity_b")
    for a, b in (("A", "B"), ("A", "C"), ("B", "C")):
        both = sum({a, b} <= s for s in baskets.values())
        with_a, with_b = (sum(x in s for s in baskets.values()) for x in (a, b))
        if both < 100:
            assert (a, b) not in got
            continue
        row = got[(a, b)]
        assert row["pair_baskets"] == both and row["support"] == pytest.approx(both / 300)
        assert row["confidence_a_to_b"] == pytest.approx(both / with_a)
        assert row["lift_a_to_b"] == pytest.approx((both / with_a) / (with_b / 300))


def test_alert_levels(spark):
    lines = [line(h, f"{h}{d}", d, 1, 1, 10 if d < 8 else 7) for h in (1, 2) for d in (1, 8)]
    w = Warehouse(spark, frames(spark, transaction_data=lines))
    rows = as_dicts(w["mart_decision_alerts"], "metric")
    fall = rows["panel_net_spend_decline"]
    assert (fall["baseline"], fall["current"], fall["variance"]) == (20, 14, -6)
    assert fall["relative_variance"] == pytest.approx(-0.3) and fall["severity"] == "high"
    assert rows["active_households_decline"]["severity"] == "normal"


def test_driver_split_adds_up(spark):
    lines = [
        line(h, f"{h}-{d}".replace("-", "0"), d, 1 + d % 3, 1, 3 + d % 5 + h)
        for h in range(1, 6)
        for d in range(h, 7 * 30, 4 + h)
    ]
    w = Warehouse(spark, frames(spark, transaction_data=lines))
    for name in ("analysis_root_cause_lmdi",):
        rows = w[name].collect()
        assert len(rows) == 3
        assert sum(r.contribution for r in rows) == pytest.approx(rows[0].total_spend_change)
        assert {r.reconciliation_status for r in rows} == {"PASS"}
    shares = [r.contribution_share for r in w["root_cause_drivers"].collect()]
    assert sum(shares) == pytest.approx(1)
    for r in w["analysis_category_lmdi"].where("reconciliation_status <> 'NOT_APPLICABLE'").collect():
        assert r.contribution_sum == pytest.approx(r.spend_change, abs=0.01)
    for r in w["analysis_panel_driver_tree"].collect():
        assert abs(r.driver_identity_delta) < 1e-6


def test_household_tables_against_brute_force(panel):
    weekly = as_dicts(panel["mart_household_weekly"], "household_key", "week_number")
    assert weekly[(1, 1)]["baskets"] == 1 and weekly[(1, 1)]["distinct_products"] == 2
    assert weekly[(1, 1)]["distinct_commodities"] == 2 and weekly[(1, 1)]["distinct_departments"] == 1
    summary = as_dicts(panel["mart_household_summary"], "household_key")
    assert summary[1]["active_weeks"] == 2 and float(summary[1]["observed_lifetime_spend"]) == 15
    assert summary[1]["median_weekly_spend"] == 7.5 and summary[1]["has_demographics"]
    assert not summary[2]["has_demographics"]


def test_shuffled_rows_give_the_same_marts(spark, panel):
    source = frames(spark)
    mixed = Warehouse(spark, lambda name: source(name).repartition(5))
    for name in ("mart_basket", "mart_category_household", "mart_customer_segment"):
        columns = sorted(panel[name].columns)
        first = sorted(map(str, panel[name].select(columns).collect()))
        assert first == sorted(map(str, mixed[name].select(columns).collect()))
