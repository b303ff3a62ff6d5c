"""Findings computed from the analyses: window comparison, extremes and rankings."""

from pyspark.sql import functions as F

from panelspark.functions.columns import ratio
from panelspark.operators.analysis import distinct_window_totals
from panelspark.plans.registry import table


@table("finding")
def finding_window_comparison(w):
    def change(early, late):
        return ratio(late, early) - 1

    def trips(t):
        return ratio(f"{t}_baskets", f"{t}_households")

    def value(t):
        return ratio(f"{t}_spend", f"{t}_baskets")

    moves = {
        "active_households_change": change("early_households", "late_households"),
        "trips_per_household_change": change(trips("early"), trips("late")),
        "spend_per_basket_change": change(value("early"), value("late")),
    }
    names = {
        "active_households_change": "Active Panel Households",
        "trips_per_household_change": "Trips per Active Household",
        "spend_per_basket_change": "Spend per Basket",
    }
    largest = F.greatest(*[F.abs(c) for c in moves])
    primary = F.coalesce(*[F.when(F.abs(c) == largest, names[c]) for c in moves])
    out = distinct_window_totals(w).withColumn(
        "spend_change", F.col("late_spend") - F.col("early_spend")
    )
    return out.withColumns(moves).withColumn("primary_driver", primary)


@table("finding")
def finding_category_erosion(w):
    fall = ratio("spend_change", "early_spend")
    return (
        w["analysis_category_decomposition"]
        .where("early_spend > 0 AND late_spend IS NOT NULL")
        .withColumn("spend_change_pct", fall)
        .orderBy("spend_change_pct", "department", "commodity")
        .limit(1)
    )


def _campaign(w, order):
    return (
        w["analysis_campaign_funnel"]
        .where(F.col("campaign_recipients") >= w.rules.finding_min_recipients)
        .select(
            "campaign_id",
            "campaign_type",
            "campaign_recipients",
            "campaign_redeemers",
            "campaign_redemption_rate",
            "post_28d_observable_rows",
        )
        .orderBy(order, "campaign_id")
        .limit(1)
    )


@table("finding")
def finding_weakest_campaign(w):
    return _campaign(w, F.col("campaign_redemption_rate").asc_nulls_last())


@table("finding")
def finding_strongest_campaign(w):
    return _campaign(w, F.col("campaign_redemption_rate").desc_nulls_last())


@table("finding")
def finding_segment_rollup(w):
    return (
        w["household_scores"]
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("households"),
            F.sum("observed_lifetime_spend").alias("spend"),
            F.count_if(F.col("trajectory") == "Declining").alias("declining_households"),
        )
        .orderBy(F.col("spend").desc())
    )


@table("finding")
def finding_promo_rank(w):
    cells = F.sum("product_store_weeks")
    return (
        w["promotion_amounts"]
        .groupBy("promo_state_group")
        .agg(
            cells.alias("product_store_weeks"),
            F.sum("panel_sales").alias("panel_sales"),
            ratio(F.sum("panel_sales"), cells).alias("sales_per_product_store_week"),
        )
        .orderBy(F.col("sales_per_product_store_week").desc())
    )
