"""Dashboard aggregates: top lists, counts, pivots and week bands."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.columns import ratio
from panelspark.operators.analysis import or_unknown
from panelspark.functions.ordering import pinned
from panelspark.plans.registry import table


@table("snapshot")
def snapshot_top_commodities(w):
    """The ten categories with the highest spend."""
    return (
        w["analysis_category_penetration"]
        .select(
            "department",
            "commodity",
            F.col("panel_net_spend").alias("spend"),
            "buying_households",
            F.col("household_penetration").alias("penetration"),
            F.col("category_baskets").alias("baskets"),
            F.col("spend_per_category_basket").alias("spend_per_basket"),
            "private_label_share",
        )
        .orderBy(F.col("spend").desc(), "department", "commodity")
        .limit(10)
    )


@table("snapshot")
def snapshot_segments(w):
    trips = F.sum("frequency_baskets")
    return w["household_scores"].groupBy("segment").agg(
        F.count(F.lit(1)).alias("households"),
        F.sum("observed_lifetime_spend").alias("spend"),
        trips.alias("trips"),
        ratio(F.sum("observed_lifetime_spend"), trips).alias("spend_per_basket"),
        ratio(trips, F.count(F.lit(1))).alias("avg_trips_per_household"),
        F.count_if(F.col("trajectory") == "Declining").alias("declining_households"),
    )


def _states(cells, *keys, sums=("product_store_weeks", "panel_sales")):
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


@table("snapshot")
def snapshot_promo_states(w):
    sums = ("product_store_weeks", "panel_sales", "panel_baskets")
    return _states(w["mart_promotion_category_week"], "promo_state_group", sums=sums).withColumn(
        "sales_per_product_store_week", ratio("panel_sales", "product_store_weeks")
    )


@table("snapshot")
def snapshot_promotion_weekly(w):
    return _states(w["promotion_amounts"], "week_number", "promo_state_group")


@table("snapshot")
def snapshot_trajectories(w):
    return w["household_scores"].groupBy("segment", "trajectory").agg(
        F.count(F.lit(1)).alias("households")
    )


@table("snapshot")
def snapshot_declining_households(w):
    """The twelve households with the largest fall in weekly spend."""
    return (
        w["mart_household_summary"]
        .where("trajectory = 'Declining'")
        .select(
            "household_key",
            "observed_lifetime_spend",
            "absolute_change",
            "early_avg_weekly_spend",
            "late_avg_weekly_spend",
            "trajectory",
        )
        .orderBy("absolute_change", "household_key")
        .limit(12)
    )


@table("snapshot")
def snapshot_brand_mix(w):
    return w["mart_brand_category"].groupBy("brand_type").agg(
        F.sum("panel_net_spend").alias("spend"),
        F.sum("buying_households").alias("households"),
        F.sum("baskets").alias("baskets"),
    )


@table("snapshot")
def snapshot_department_brand(w):
    """Department spend by brand, widest departments first; the brand list is fixed."""
    brands = ("NATIONAL", "PRIVATE")
    return (
        w["mart_brand_category"]
        .groupBy("department")
        .agg(
            *[
                F.sum(F.when(F.col("brand_type") == b, F.col("panel_net_spend"))).alias(b)
                for b in brands
            ],
            F.sum("panel_net_spend").alias("total_spend"),
        )
        .orderBy(F.col("total_spend").desc(), "department")
        .limit(12)
    )


@table("snapshot")
def snapshot_campaign_types(w):
    people, used = F.sum("campaign_recipients"), F.sum("campaign_redeemers")
    return w["mart_campaign_summary"].groupBy("campaign_type").agg(
        people.alias("recipients"),
        used.alias("redeemers"),
        F.sum("post_28d_observable_rows").alias("observable_rows"),
        ratio(used, people).alias("redemption_rate"),
    )


@table("snapshot")
def snapshot_campaign_segments(w):
    people, used = F.sum("recipient_households"), F.sum("redeemer_households")
    return w["analysis_campaign_segment"].groupBy(F.col("customer_segment").alias("segment")).agg(
        people.alias("recipients"),
        used.alias("redeemers"),
        F.sum("post_28d_observable_rows").alias("observable_rows"),
        ratio(used, people).alias("redemption_rate"),
    )


@table("snapshot")
def snapshot_campaign_funnel(w):
    totals = w["mart_campaign_summary"].agg(
        F.sum("campaign_recipients").alias("all"),
        F.sum("campaign_redeemers").alias("used"),
        F.sum("post_28d_observable_rows").alias("seen"),
    )
    stages = (
        ("Recipient households", "all"),
        ("Redeemer households", "used"),
        ("Post-28d observable rows", "seen"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("stage"), F.col(c).alias("value"), ratio(c, "all").alias("rate")
            )
            for name, c in stages
        ]
    )
    return totals.select(F.explode(rows).alias("r")).select("r.*")


@table("snapshot")
def snapshot_pair_affinity(w):
    """Share of a commodity's buyers who also buy another, among the six top commodities."""
    # Six names, worked out once.
    top = pinned(
        w["product_lines"]
        .where("commodity IS NOT NULL")
        .groupBy("commodity")
        .agg(F.sum("sales_value").alias("spend"))
        .orderBy(F.col("spend").desc(), "commodity")
        .limit(6)
        .select("commodity")
    )
    # At most six names per household; equal sets collapse before pairs are formed.
    sets = (
        w["product_lines"]
        .where("household_key IS NOT NULL")
        .select("household_key", "commodity")
        .join(F.broadcast(top), "commodity", "left_semi")
        .groupBy("household_key")
        .agg(F.sort_array(F.collect_set("commodity")).alias("items"))
        .groupBy("items")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    both = (
        sets.select("items", "n", F.explode("items").alias("left"))
        .select("n", "left", F.explode("items").alias("right"))
        .groupBy("left", "right")
        .agg(F.sum("n").alias("both"))
    )
    buyers = both.where(F.col("left") == F.col("right")).select("left", F.col("both").alias("base"))
    self_pair = F.col("left") == F.col("right")
    # At most 36 pairs; one without a common buyer has the rate 0.
    names = top.agg(F.sort_array(F.collect_list("commodity")).alias("names"))
    pairs = names.select(F.explode("names").alias("left"), "names").select(
        "left", F.explode("names").alias("right")
    )
    found = pairs.join(both, ["left", "right"], "left").join(buyers, "left", "left")
    shared = F.coalesce("both", F.lit(0).cast("bigint"))
    return found.select(
        "left", "right", F.when(~self_pair, ratio(shared, "base")).alias("attach_rate")
    )


@table("snapshot")
def snapshot_week_bands(w):
    """Weeks cut into at most twelve equal bands (one row per week, at most 102)."""
    rows = w["mart_panel_weekly"].select(
        "week_number", "panel_net_spend", "baskets", "active_households"
    )
    place = F.row_number().over(Window.orderBy(F.col("week_number").asc_nulls_last())) - 1
    weeks = F.count(F.lit(1)).over(Window.partitionBy())
    size = F.greatest(F.lit(1), F.ceil(weeks / 12))
    banded = rows.withColumn("band", F.floor(place / size).cast("int"))
    first, last = F.min("week_number"), F.max("week_number")
    name = F.concat(F.lit("W"), first.cast("string"), F.lit("–W"), last.cast("string"))
    return banded.groupBy("band").agg(
        name.alias("label"),
        F.sum("panel_net_spend").alias("panel_net_spend"),
        F.sum("baskets").alias("baskets"),
        F.max("active_households").alias("active_households"),
    )


@table("snapshot")
def snapshot_department_promo(w):
    promoted = F.coalesce(F.col("promo_state_group") != "none", F.lit(True))
    cells = F.sum("product_store_weeks")
    on = F.sum(F.when(promoted, F.col("product_store_weeks")).otherwise(0))
    return (
        w["promotion_amounts"]
        .groupBy(or_unknown("department").alias("department"))
        .agg(
            cells.alias("total"),
            on.alias("promoted"),
            ratio(on, cells).alias("observed_coverage"),
        )
    )
