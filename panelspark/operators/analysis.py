"""Analyses over marts. Every split of spend is an accounting identity, not a causal estimate."""

from functools import reduce
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark import fixed_text as text
from panelspark.functions.bits import bit_words, bits_set
from panelspark.functions.columns import (
    in_first_weeks,
    in_last_weeks,
    label,
    mean,
    mean_ratio,
    mean_when,
    ratio,
    total_ratio,
    total_rows,
    trajectory,
    wilson,
)
from panelspark.functions.ordering import pinned, rank_table
from panelspark.functions.quantiles import grouped_quantile
from panelspark.operators.facts import named_categories
from panelspark.operators.marts import (
    PROMOTED,
    campaign_averages,
    redeemer,
    scored_households,
    segment_label,
    segmented,
    week_bounds,
    with_quintiles,
    zero_if_null,
)
from panelspark.operators.staging import DEMOGRAPHICS
from panelspark.plans.registry import table


def log_mean(early, late):
    """Logarithmic mean of two positive totals; NULL when either is not positive."""
    early, late = F.col(early).cast("double"), F.col(late).cast("double")
    change = (late - early) / F.ln(late / early)
    return F.when((early > 0) & (late > 0), F.when(early != late, change).otherwise(late))


def positive_ln(c):
    """LN that is NULL, not an error or -inf, outside its domain."""
    return F.when(c > 0, F.ln(c))


def first_last_totals(w):
    """One row: spend, household-weeks, distinct households and baskets of both windows."""
    r = w.rules
    lo, hi = week_bounds(w)
    weekly = w["mart_panel_weekly"]
    first = in_first_weeks("week_number", lo, r.window_weeks)
    # A week in both windows counts as first.
    last = ~first & in_last_weeks("week_number", hi, r.window_weeks)
    sums = {"spend": "panel_net_spend", "households": "active_households", "baskets": "baskets"}
    return weekly.agg(
        *[
            F.sum(F.when(flag, F.col(c))).alias(f"{when}_{name}")
            for when, flag in (("early", first), ("late", last))
            for name, c in sums.items()
        ]
    )


def distinct_window_totals(w):
    """Like :func:`first_last_totals` with households counted once per window."""
    r = w.rules
    lo, hi = week_bounds(w)
    first = in_first_weeks("week_number", lo, r.window_weeks)
    last = ~first & in_last_weeks("week_number", hi, r.window_weeks)
    spend, flags = F.col("basket_net_spend"), (("early", first), ("late", last))
    # one row per household; a basket is one row of the fact
    people = w["fct_basket"].where(first | last).groupBy("household_key").agg(
        *[
            c
            for when, flag in flags
            for c in (
                F.sum(F.when(flag, spend)).alias(f"{when}_spend"),
                F.count_if(flag).alias(f"{when}_rows"),
                F.count(F.when(flag, F.col("basket_id"))).alias(f"{when}_baskets"),
            )
        ]
    )
    known, none = F.col("household_key").isNotNull(), F.lit(0).cast("bigint")
    return people.agg(
        *[
            c
            for when, _ in flags
            for c in (
                F.sum(f"{when}_spend").alias(f"{when}_spend"),
                F.count_if(known & (F.col(f"{when}_rows") > 0)).alias(f"{when}_households"),
                F.coalesce(F.sum(f"{when}_baskets"), none).alias(f"{when}_baskets"),
            )
        ]
    )


def driver_split(totals):
    """Three rows: the log-mean share of households, trips and basket value in the change."""
    drivers = (
        ("active_households", lambda t: F.col(f"{t}_households").cast("double")),
        ("trips_per_active_household", lambda t: ratio(f"{t}_baskets", f"{t}_households")),
        ("spend_per_basket", lambda t: ratio(f"{t}_spend", f"{t}_baskets")),
    )
    weight = log_mean("early_spend", "late_spend")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("driver"),
                value("early").alias("early_value"),
                value("late").alias("late_value"),
                (weight * positive_ln(ratio(value("late"), value("early")))).alias("contribution"),
            )
            for name, value in drivers
        ]
    )
    change = (F.col("late_spend") - F.col("early_spend")).cast("double")
    split = totals.select(rows.alias("d"), change.alias("total_spend_change"))
    parts = [F.col("d")[i]["contribution"] for i in range(len(drivers))]
    summed = parts[0] + parts[1] + parts[2]
    return split.withColumn("summed_driver_contribution", summed).select(
        F.explode("d").alias("d"), "total_spend_change", "summed_driver_contribution"
    ).select("d.*", "total_spend_change", "summed_driver_contribution")


@table("analysis")
def analysis_root_cause_lmdi(w):
    delta = F.col("summed_driver_contribution") - F.col("total_spend_change")
    return driver_split(first_last_totals(w)).select(
        F.lit("D01").alias("decision_id"),
        F.lit("Panel Spend Movement").alias("case_name"),
        "driver",
        "early_value",
        "late_value",
        (ratio("late_value", "early_value") - 1).alias("relative_change"),
        "contribution",
        "total_spend_change",
        "summed_driver_contribution",
        delta.alias("reconciliation_delta"),
        F.when(F.abs(delta) <= 0.01, "PASS").otherwise("REVIEW").alias("reconciliation_status"),
        F.lit(text.ROOT_CAUSE).alias("limitation"),
    )


@table("analysis")
def root_cause_periods(w):
    t = distinct_window_totals(w)
    r = w.rules
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{name} {r.window_weeks} weeks").alias("period"),
                F.col(f"{when}_spend").cast("double").alias("panel_net_spend"),
                F.col(f"{when}_households").alias("active_households"),
                F.col(f"{when}_baskets").alias("baskets"),
            )
            for name, when in (("First", "early"), ("Last", "late"))
        ]
    )
    return t.select(F.explode(rows).alias("p")).select(
        "p.*",
        ratio("p.baskets", "p.active_households").alias("trips_per_household"),
        ratio("p.panel_net_spend", "p.baskets").alias("spend_per_basket"),
    )


@table("analysis")
def root_cause_drivers(w):
    return driver_split(distinct_window_totals(w)).select(
        "driver",
        "early_value",
        "late_value",
        (ratio("late_value", "early_value") - 1).alias("relative_change"),
        F.col("contribution").alias("spend_change_contribution"),
        ratio("contribution", "summed_driver_contribution").alias("contribution_share"),
    )


@table("analysis")
def analysis_campaign_denominators(w):
    n, k = "campaign_household_exposures", "redeeming_exposures"
    people, buyers = "unique_exposed_households", "unique_redeeming_households"
    counted = w["redeeming_exposures"].groupBy("campaign_id", "campaign_type").agg(
        F.count(F.lit(1)).alias(n),
        F.count_distinct("household_key").alias(people),
        F.count_if("redeemed_coupon_flag").alias(k),
        F.count_distinct(redeemer()).alias(buyers),
    )
    return counted.select(
        "*",
        ratio(k, n).alias("exposure_redemption_rate"),
        ratio(buyers, people).alias("unique_household_redemption_rate"),
        wilson(k, n, -1).alias("exposure_rate_ci_low"),
        wilson(k, n, 1).alias("exposure_rate_ci_high"),
        wilson(buyers, people, -1).alias("unique_rate_ci_low"),
        wilson(buyers, people, 1).alias("unique_rate_ci_high"),
        F.lit(text.DENOMINATORS).alias("interpretation_boundary"),
    )


def state_counts():
    return [F.count(F.lit(1)).alias("total_rows")] + [
        F.count_if(F.col("promo_state_group") == s).alias(f"{s}_rows")
        for s in ("none", *PROMOTED)
    ]


def promotion_universe(w):
    """State counts and distinct products, stores and weeks over the promotion fact, in one scan.

    Rows become one per product and store first, their weeks as bits; products and stores are then
    counted as tagged keys of those. Weeks outside the planned range have no bit and are keys as well.
    """
    r = w.rules
    week = F.col("week_number")
    planned = week.between(r.first_week, r.last_week)
    words = {f"_w{i}": c for i, c in enumerate(bit_words("week_number", r.first_week, r.last_week))}
    states = [f"{s}_rows" for s in ("none", *PROMOTED)]
    placed = (
        w["fct_promotion_product_store_week"]
        .groupBy("product_id", "store_id", F.when(~planned, week).cast("bigint").alias("_week"))
        .agg(*state_counts(), *[c.alias(n) for n, c in words.items()])
    )
    sums = ["total_rows", *states]
    entry = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.col(c).cast("bigint").alias("key"),
            # counts and weeks ride with the product
            *[(F.col(n) if kind == 0 else F.lit(None).cast("bigint")).alias(n) for n in (*sums, *words)],
        )
        for kind, c in enumerate(("product_id", "store_id", "_week"))
    ]
    keys = (
        placed.select(F.explode(F.array(*entry)).alias("e"))
        .select("e.*")
        .groupBy("kind", "key")
        .agg(*[F.sum(n).alias(n) for n in sums], *[F.bit_or(n).alias(n) for n in words])
    )

    def distinct(kind):
        return F.count_if((F.col("kind") == kind) & F.col("key").isNotNull())

    none = F.lit(0).cast("bigint")
    weeks = bits_set([F.coalesce(F.bit_or(n), none) for n in words])
    return keys.agg(
        *[F.coalesce(F.sum(n), none).alias(n) for n in sums],
        distinct(0).alias("products"),
        distinct(1).alias("stores"),
        (distinct(2) + weeks).alias("weeks"),
    )


@table("analysis")
def analysis_promotion_universe_audit(w):
    found = F.col("none_rows") > 0
    return promotion_universe(w).select(
        "*",
        F.when(found, "RECOVERED").otherwise("NOT_OBSERVED").alias("none_state_status"),
        F.when(found, text.NONE_OBSERVED)
        .otherwise(text.NONE_MISSING)
        .alias("interpretation_boundary"),
    )


@table("analysis")
def analysis_basket_category(w):
    return w["mart_category_weekly"].groupBy("commodity").agg(
        F.sum("panel_net_spend").alias("panel_net_spend"),
        F.sum("buying_households").alias("buying_household_week_records"),
        F.sum("category_baskets").alias("category_baskets"),
        mean_ratio("private_label_share").alias("avg_private_label_share"),
        mean_ratio("discount_rate").alias("avg_discount_rate"),
    )


@table("analysis")
def analysis_campaign_funnel(w):
    before = F.col("avg_pre_28d_spend")
    return w["mart_campaign_summary"].select(
        "campaign_id",
        "campaign_type",
        "campaign_recipients",
        "campaign_redeemers",
        "campaign_redemption_rate",
        "avg_pre_28d_spend",
        "avg_during_spend",
        "avg_post_28d_spend",
        "post_28d_observable_rows",
        (F.col("avg_during_spend") - before).alias("avg_spend_change_during"),
        (F.col("avg_post_28d_spend") - before).alias("avg_spend_change_post"),
    )


def or_unknown(c):
    return F.coalesce(c, F.lit("Unknown"))


@table("analysis")
def analysis_campaign_segment(w):
    people, buyers = F.count_distinct("household_key"), F.count_distinct(redeemer())
    averages = campaign_averages()
    short = F.count_if("post_14d_observable").alias("post_14d_observable_rows")
    return (
        w["mart_campaign_household"]
        .groupBy(
            "campaign_id",
            or_unknown("campaign_type").alias("campaign_type"),
            or_unknown("segment").alias("customer_segment"),
        )
        .agg(
            people.alias("recipient_households"),
            buyers.alias("redeemer_households"),
            ratio(buyers, people).alias("redemption_rate"),
            *averages[:5],
            short,
            averages[5],
            F.count_distinct(F.when(F.col("has_demographics"), F.col("household_key"))).alias(
                "demographic_households"
            ),
        )
        .withColumn("interpretation_boundary", F.lit(text.CAMPAIGN_SEGMENT))
    )


@table("analysis")
def analysis_category_penetration(w):
    panel = w["dim_household"].agg(F.count_distinct("household_key")).scalar()
    # The mart has one row per household and category, but raw names may repeat a category.
    buyers = F.count_distinct("household_key")
    spend, trips = F.sum("panel_net_spend"), F.sum("category_baskets")
    return (
        w["mart_category_household"]
        .groupBy("department", "commodity")
        .agg(
            buyers.alias("buying_households"),
            spend.alias("panel_net_spend"),
            trips.alias("category_baskets"),
            F.sum("active_weeks").alias("household_category_active_weeks"),
            ratio(spend, trips).alias("spend_per_category_basket"),
            ratio(spend, buyers).alias("spend_per_buying_household"),
            ratio(trips, buyers).alias("purchase_frequency_per_buying_household"),
            ratio(
                F.sum("discount_value"), F.sum(F.col("panel_net_spend") + F.col("discount_value"))
            ).alias("discount_rate"),
            ratio(F.sum("coupon_baskets"), trips).alias("coupon_basket_rate"),
            ratio(F.sum("private_label_spend"), spend).alias("private_label_share"),
        )
        .withColumn("panel_households", panel)
        .withColumn("household_penetration", ratio("buying_households", "panel_households"))
    )


@table("analysis")
def analysis_category_decomposition(w):
    r = w.rules
    lo, hi = week_bounds(w)
    first = in_first_weeks("week_number", lo, r.window_weeks)
    last = in_last_weeks("week_number", hi, r.window_weeks)
    # One row per category and period, so each distinct count is shuffled on its own value.
    periods = (
        w["category_lines"]
        .where(first | last)
        .groupBy("category_no", first.alias("early"))
        .agg(
            F.sum("sales_value").alias("spend"),
            F.count_distinct("household_key").alias("buying_households"),
            F.count_distinct("basket_id").alias("category_baskets"),
        )
    )
    measures = ("spend", "buying_households", "category_baskets")
    sides = periods.groupBy("category_no").agg(
        *[
            F.max(F.when(F.col("early") == is_early, F.col(m))).alias(f"{side}_{m}")
            for m in measures
            for side, is_early in (("early", True), ("late", False))
        ]
    )
    sides = named_categories(w, sides)
    early, late = F.col("early_spend").cast("double"), F.col("late_spend").cast("double")
    path = F.when((early == 0) & (late > 0), "Emerging").otherwise(trajectory(early, late, r))
    return sides.select(
        "department",
        "commodity",
        "early_spend",
        "late_spend",
        (F.col("late_spend") - F.col("early_spend")).alias("spend_change"),
        "early_buying_households",
        "late_buying_households",
        (F.col("late_buying_households") - F.col("early_buying_households")).alias(
            "buying_household_change"
        ),
        "early_category_baskets",
        "late_category_baskets",
        (F.col("late_category_baskets") - F.col("early_category_baskets")).alias("basket_change"),
        *[
            ratio(f"{s}_category_baskets", f"{s}_buying_households").alias(
                f"{s}_baskets_per_buying_household"
            )
            for s in ("early", "late")
        ],
        *[
            ratio(f"{s}_spend", f"{s}_category_baskets").alias(f"{s}_spend_per_category_basket")
            for s in ("early", "late")
        ],
        path.alias("category_trajectory"),
    )


@table("analysis")
def analysis_coupon_campaign(w):
    exposed = w["fct_campaign_exposure"].groupBy("campaign_id").agg(
        F.max("campaign_type").alias("campaign_type"),
        F.count_distinct("household_key").alias("recipient_households"),
    )
    used = w["stg_coupon_redemption"].groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("redemption_events"),
        F.count_distinct("household_key").alias("redeemer_households"),
    )
    linked = w["bridge_coupon_product_campaign"].groupBy("campaign_id").agg(
        F.count_distinct("coupon_upc").alias("linked_coupons"),
        F.count_distinct("product_id").alias("linked_products"),
    )
    counts = ["redemption_events", "redeemer_households", "linked_coupons", "linked_products"]
    joined = exposed.join(used, "campaign_id", "left").join(linked, "campaign_id", "left")
    return joined.fillna(0, counts).select(
        "campaign_id",
        "campaign_type",
        "recipient_households",
        "redemption_events",
        "redeemer_households",
        ratio("redeemer_households", "recipient_households").alias("redemption_rate"),
        "linked_coupons",
        "linked_products",
        F.lit(text.COUPON_CAMPAIGN).alias("interpretation_boundary"),
    )


@table("analysis")
def analysis_coupon_segment(w):
    keys = ["campaign_id", "customer_segment"]

    def by_segment(df):
        named = df.join(w["household_segment"], "household_key", "left")
        return named.withColumn("customer_segment", or_unknown("segment")).groupBy(*keys)

    exposed = by_segment(w["fct_campaign_exposure"]).agg(
        F.max("campaign_type").alias("campaign_type"),
        F.count_distinct("household_key").alias("recipient_households"),
    )
    used = by_segment(w["stg_coupon_redemption"]).agg(
        F.count_distinct("household_key").alias("redeemer_households"),
        F.count(F.lit(1)).alias("redemption_events"),
    )
    joined = exposed.join(used, keys, "left").fillna(0, ["redeemer_households", "redemption_events"])
    return joined.select(
        "campaign_id",
        "campaign_type",
        "customer_segment",
        "recipient_households",
        "redeemer_households",
        "redemption_events",
        ratio("redeemer_households", "recipient_households").alias("redemption_rate"),
        F.lit(text.COUPON_SEGMENT).alias("interpretation_boundary"),
    )


@table("analysis")
def analysis_coupon_category(w):
    keys = ["campaign_id", "department", "commodity"]
    names = w["products"].select(
        "product_id",
        F.col("department_name").alias("department"),
        F.col("commodity_name").alias("commodity"),
    )
    linked = w["bridge_coupon_product_campaign"].join(names, "product_id", "left").fillna(
        "Unknown", ["department", "commodity"]
    )
    links = linked.groupBy(*keys).agg(
        F.count_distinct("coupon_upc").alias("linked_coupons"),
        F.count_distinct("product_id").alias("linked_products"),
    )
    # An event counts once per category however many products link it there.
    events = w["stg_coupon_redemption"].groupBy("campaign_id", "coupon_upc", "household_key").agg(
        F.count(F.lit(1)).alias("events")
    )
    once = linked.select(*keys, "coupon_upc").distinct()
    used = once.join(events, ["campaign_id", "coupon_upc"]).groupBy(*keys).agg(
        F.sum("events").alias("mapped_redemption_events"),
        F.count_distinct("household_key").alias("mapped_redeemer_households"),
    )
    return (
        links.join(used, keys, "left")
        .fillna(0, ["mapped_redemption_events", "mapped_redeemer_households"])
        .withColumn("interpretation_boundary", F.lit(text.COUPON_CATEGORY))
    )


@table("analysis")
def analysis_coupon_basket(w):
    keys = ["customer_segment", "basket_type"]
    baskets = w["mart_basket"].select(
        or_unknown("segment").alias("customer_segment"),
        F.when(F.col("has_coupon_discount"), "Coupon-discounted")
        .otherwise("No-coupon-discount")
        .alias("basket_type"),
        "household_key",
        "basket_net_spend",
        "basket_distinct_products",
        "basket_line_count",
        "basket_coupon_discount",
    )
    stats = baskets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("basket_count"),
        F.count_distinct("household_key").alias("households"),
        mean("basket_net_spend").alias("avg_basket_net_spend"),
        mean("basket_distinct_products").alias("avg_distinct_products"),
        mean("basket_line_count").alias("avg_line_count"),
        mean("basket_coupon_discount").alias("avg_coupon_discount"),
    )
    middle = grouped_quantile(baskets, keys, "basket_net_spend", 0.5, "median_basket_net_spend")
    return stats.join(middle, keys, "left").select(
        *keys,
        "basket_count",
        "households",
        "avg_basket_net_spend",
        "median_basket_net_spend",
        "avg_distinct_products",
        "avg_line_count",
        "avg_coupon_discount",
        F.lit(text.COUPON_BASKET).alias("interpretation_boundary"),
    )


@table("analysis")
def analysis_coupon_repeat_category(w):
    """A later purchase exists exactly when the last purchase day is after the first coupon day."""
    with_coupon = F.when(F.col("coupon_discount") > 0, F.col("day_key"))
    pairs = (
        w["product_lines"]
        .groupBy("household_key", label("commodity").alias("commodity"))
        .agg(F.min(with_coupon).alias("first_coupon"), F.max("day_key").alias("last_day"))
        .where("first_coupon IS NOT NULL")
    )
    again = F.col("last_day") > F.col("first_coupon")
    # A household that is not known cannot be matched to a later purchase.
    again = again & F.col("household_key").isNotNull()
    return pairs.groupBy("commodity").agg(
        F.count(F.lit(1)).alias("first_observed_coupon_households"),
        F.count_if(again).alias("later_observed_repeat_households"),
        ratio(F.count_if(again), F.count(F.lit(1))).alias("observed_repeat_rate"),
        F.lit(text.COUPON_REPEAT).alias("interpretation_boundary"),
    )


@table("analysis")
def analysis_customer_engagement(w):
    return (
        segmented(w, scored_households(w))
        .where(F.col("trajectory").isin("Growing", "Stable", "Declining"))
        .select(
            "household_key",
            "segment",
            "trajectory",
            "observed_lifetime_spend",
            "frequency_baskets",
            "avg_basket_value",
            "early_avg_weekly_spend",
            "late_avg_weekly_spend",
            "absolute_change",
            "discount_share",
            "coupon_basket_rate",
            "private_label_share",
        )
    )


@table("analysis")
def analysis_panel_driver_tree(w):
    """Windows run over one row per week (at most 102)."""
    by_week = Window.orderBy(F.col("week_number").asc_nulls_last())
    recent, sofar = by_week.rowsBetween(-3, 0), by_week.rowsBetween(Window.unboundedPreceding, 0)
    drivers = ["active_households", "trips_per_household", "spend_per_basket"]
    weekly = w["mart_panel_weekly"].select(
        "week_number",
        "panel_net_spend",
        *drivers,
        ratio(F.sum("panel_net_spend").over(recent), F.count("panel_net_spend").over(recent)).alias(
            "rolling_4w_panel_spend"
        ),
        F.sum("panel_net_spend").over(sofar).alias("cumulative_panel_spend"),
        *[F.lag(c).over(by_week).alias(f"prior_{c}") for c in ("panel_net_spend", *drivers)],
    )
    rebuilt = (
        F.col("active_households").cast("double")
        * F.col("trips_per_household")
        * F.col("spend_per_basket")
    )
    changes = {
        "panel_spend_change_pct": "panel_net_spend",
        "active_household_change_pct": "active_households",
        "trip_frequency_change_pct": "trips_per_household",
        "basket_value_change_pct": "spend_per_basket",
    }
    return weekly.select(
        "*",
        rebuilt.alias("reconstructed_panel_net_spend"),
        (F.col("panel_net_spend").cast("double") - rebuilt).alias("driver_identity_delta"),
        *[(ratio(c, f"prior_{c}") - 1).alias(name) for name, c in changes.items()],
    )


@table("analysis")
def analysis_household_engagement_sequence(w):
    """Per-household sequence plus ranks inside each week.

    A household has at most one row per week, so its window stays small. A week may hold a large
    share of all households, so ranks come from value counts ordered across the cluster.
    """
    along = Window.partitionBy("household_key").orderBy(F.col("week_number").asc_nulls_last())
    rows = w["household_week_spend"].select("household_key", "week_number", "net_spend", "baskets")
    sequence = rows.select(
        "*",
        F.lag("net_spend").over(along).alias("prior_week_spend"),
        F.lead("net_spend").over(along).alias("next_week_spend"),
        F.sum("net_spend")
        .over(along.rowsBetween(Window.unboundedPreceding, 0))
        .alias("cumulative_household_spend"),
    )
    by_spend = rank_table(rows, ["net_spend"], ["week_number"]).select(
        F.col("week_number").alias("_week"),
        F.col("net_spend").alias("_spend"),
        F.col("rank").alias("weekly_spend_rank"),
    )
    # Distinct basket counts per week are few: the window sees one row per count.
    most = Window.partitionBy("_week").orderBy(F.col("_baskets").desc_nulls_last())
    by_trips = (
        rows.select(F.col("week_number").alias("_week"), F.col("baskets").alias("_baskets"))
        .distinct()
        .withColumn("weekly_frequency_rank", F.row_number().over(most).cast("bigint"))
    )

    def same(**columns):
        return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in columns.items()])

    # A missing week or spend is a value of its own here and ranks last.
    spent = sequence.join(by_spend, same(week="week_number", spend="net_spend")).drop("_week")
    return spent.join(by_trips, same(week="week_number", baskets="baskets")).select(
        *sequence.columns, "weekly_spend_rank", "weekly_frequency_rank"
    )


@table("analysis")
def analysis_private_label(w):
    private = F.col("brand_type") == "PRIVATE"
    own = F.sum(zero_if_null(F.when(private, F.col("panel_net_spend"))))
    buyers = F.sum(F.when(private, F.col("buying_households")).otherwise(0))
    return w["mart_brand_category"].groupBy("department", "commodity").agg(
        own.alias("private_label_spend"),
        F.sum("panel_net_spend").alias("category_spend"),
        ratio(own, F.sum("panel_net_spend")).alias("private_label_share"),
        buyers.alias("private_label_buying_households"),
    )


@table("analysis")
def analysis_private_label_anomalies(w):
    share, spend = F.col("private_label_share"), F.col("category_spend")
    kind = (
        F.when(share < 0, "share_below_zero")
        .when(share > 1, "share_above_one")
        .when(spend <= 0, "non_positive_denominator")
        .otherwise("review")
    )
    return w["analysis_private_label"].where((share < 0) | (share > 1) | (spend <= 0)).select(
        "department",
        "commodity",
        "private_label_spend",
        "category_spend",
        "private_label_share",
        kind.alias("anomaly_type"),
        F.lit(text.PRIVATE_LABEL_ANOMALY).alias("limitation"),
    )


@table("analysis")
def private_label_category_audit(w):
    """Full-period private-label share per governed category, with its range check."""
    own = F.sum("private_sales")
    shares = w["governed_lines"].groupBy("category_no").agg(
        own.alias("private_label_spend"),
        F.sum("sales_value").alias("category_spend"),
        ratio(own, F.sum("sales_value")).alias("private_label_share"),
    )
    in_range = F.col("private_label_share").between(0, 1)
    return shares.join(w["governed_numbers"], "category_no", "left").select(
        "category_key",
        "private_label_spend",
        "category_spend",
        "private_label_share",
        F.when(in_range, "PASS").otherwise("REVIEW").alias("audit_status"),
    )


@table("analysis")
def analysis_promotion_association(w):
    cells = F.sum("product_store_weeks")
    return (
        w["mart_promotion_category_week"]
        .groupBy("department", "commodity", "promo_state_group")
        .agg(
            cells.alias("product_store_weeks"),
            F.sum("panel_sales").alias("panel_sales"),
            F.sum("panel_units").alias("panel_units"),
            F.sum("panel_buying_households").alias("panel_buying_households"),
            F.sum("panel_baskets").alias("panel_baskets"),
            ratio(F.sum("panel_sales"), cells).alias("avg_panel_sales_per_product_store_week"),
            ratio(F.sum("panel_baskets"), cells).alias("avg_panel_baskets_per_product_store_week"),
        )
    )


def promoted_sum(c):
    on = F.col("promo_state_group").isin(*PROMOTED)
    return F.sum(F.when(on, F.col(c)).otherwise(F.lit(0)))


@table("analysis")
def analysis_promotion_dependency(w):
    return (
        w["promotion_amounts"]
        .groupBy("department", "commodity")
        .agg(
            F.sum("panel_sales").alias("total_panel_sales"),
            promoted_sum("panel_sales").alias("promoted_panel_sales"),
            F.sum("product_store_weeks").alias("total_product_store_weeks"),
            promoted_sum("product_store_weeks").alias("promoted_product_store_weeks"),
        )
        .select(
            "*",
            ratio("promoted_panel_sales", "total_panel_sales").alias(
                "share_of_observed_sales_during_promoted_states"
            ),
            ratio("promoted_product_store_weeks", "total_product_store_weeks").alias(
                "share_of_product_store_weeks_promoted"
            ),
            F.lit(text.PROMOTION_DEPENDENCY).alias("interpretation_boundary"),
        )
    )


def loss(c):
    return F.greatest(F.lit(0.0), c)


@table("internal")
def category_losses(w):
    r = w.rules
    lo, hi = week_bounds(w)
    first = in_first_weeks("week_number", lo, r.window_weeks)
    last = in_last_weeks("week_number", hi, r.window_weeks)
    both = (("early", first), ("late", last))
    # One row per household and category, written once: it is counted per category and per household.
    people = pinned(
        w["category_week_amounts"]
        .where(first | last)
        .groupBy("category_no", "household_key")
        .agg(
            *[
                F.sum(zero_if_null(F.when(flag, F.col("panel_net_spend")))).alias(f"{s}_spend")
                for s, flag in both
            ],
            *[F.max(flag).alias(s) for s, flag in both],
            *[
                F.sum(F.when(flag, F.col("category_baskets")).otherwise(0)).alias(
                    f"{s}_category_baskets"
                )
                for s, flag in both
            ],
        )
    )
    seen = people.where("household_key IS NOT NULL").groupBy("household_key")
    either = seen.agg(*[F.max(s).alias(s) for s, _ in both])
    counts = either.agg(F.struct(*[F.count_if(s).alias(s) for s, _ in both])).scalar()
    active = {s: counts[s] for s, _ in both}
    per_category = people.groupBy("category_no").agg(
        *[F.sum(f"{s}_spend").alias(f"{s}_spend") for s, _ in both],
        *[
            F.count_if(F.col(s) & F.col("household_key").isNotNull()).alias(f"{s}_buying_households")
            for s, _ in both
        ],
        *[F.sum(f"{s}_category_baskets").alias(f"{s}_category_baskets") for s, _ in both],
    )
    windows = per_category.join(w["governed_numbers"], "category_no", "left").select(
        "category_key", "department", "commodity", *[c for c in per_category.columns if c != "category_no"]
    )
    measured = windows.select(
        "*",
        *[
            (F.col(f"late_{a}") - F.col(f"early_{a}")).alias(b)
            for a, b in (
                ("spend", "spend_change"),
                ("buying_households", "buying_household_change"),
                ("category_baskets", "basket_change"),
            )
        ],
        *[ratio(f"{s}_buying_households", active[s]).alias(f"{s}_penetration") for s, _ in both],
        *[
            ratio(f"{s}_category_baskets", f"{s}_buying_households").alias(
                f"{s}_baskets_per_buying_household"
            )
            for s, _ in both
        ],
        *[
            ratio(f"{s}_spend", f"{s}_category_baskets").alias(f"{s}_spend_per_category_basket")
            for s, _ in both
        ],
    )

    def fall(c):
        return loss(F.col(f"early_{c}").cast("double") - F.col(f"late_{c}").cast("double"))

    scored = measured.select(
        "*",
        loss((-F.col("spend_change")).cast("double")).alias("spend_loss"),
        loss((-F.col("buying_household_change")).cast("double")).alias("buying_household_loss"),
        fall("penetration").alias("penetration_loss"),
        fall("baskets_per_buying_household").alias("frequency_loss"),
        fall("spend_per_category_basket").alias("basket_value_loss"),
    )
    # One row per category, read by the totals, the scores and the ranks.
    return pinned(scored)


@table("analysis")
def analysis_category_materiality(w):
    r = w.rules
    losses = w["category_losses"]
    weights = {
        "spend_loss": r.spend_loss_weight,
        "buying_household_loss": r.household_loss_weight,
        "penetration_loss": r.penetration_loss_weight,
        "frequency_loss": r.frequency_loss_weight,
        "basket_value_loss": r.basket_value_loss_weight,
    }
    places = {"spend_loss": 6, "buying_household_loss": 0, "basket_value_loss": 6}
    totals = losses.agg(
        F.struct(*[total_ratio(c, places.get(c, 12)).alias(c) for c in weights])
    ).scalar()
    shared = losses
    score = None
    for c, weight in weights.items():
        shared = shared.withColumn(f"{c}_share", ratio(c, totals[c]))
        part = F.lit(weight) * F.coalesce(f"{c}_share", F.lit(0.0))
        score = part if score is None else score + part
    scored = shared.withColumn("commercial_materiality_score", score)
    ordered = scored.withColumn("_size", F.abs("spend_change"))
    order = ["commercial_materiality_score", "_size"]
    ranks = rank_table(ordered, order).select(
        *order, F.col("rank").alias("commercial_materiality_rank")
    )
    return ordered.join(ranks, order).select(
        *scored.columns,
        "commercial_materiality_rank",
        F.lit(text.MATERIALITY).alias("interpretation_boundary"),
    )


@table("analysis")
def analysis_category_lmdi(w):
    """Rows whose components are all positive are split; rows failing a test are withheld.

    A row whose test is NULL (a missing component, nothing failing) belongs to neither side.
    """
    v = w["category_losses"].select(
        "category_key",
        "department",
        "commodity",
        F.col("early_spend").cast("double").alias("early_spend"),
        F.col("late_spend").cast("double").alias("late_spend"),
        F.col("spend_change").cast("double").alias("spend_change"),
        *[
            F.col(c).cast("double").alias(c)
            for c in ("early_buying_households", "late_buying_households")
        ],
        F.col("early_baskets_per_buying_household").alias("early_frequency"),
        F.col("late_baskets_per_buying_household").alias("late_frequency"),
        F.col("early_spend_per_category_basket").alias("early_basket_value"),
        F.col("late_spend_per_category_basket").alias("late_basket_value"),
    )
    parts = ("buying_households", "frequency", "basket_value")
    eligible = (F.col("early_spend") > 0) & (F.col("late_spend") > 0)
    for p in parts:
        eligible = eligible & (F.col(f"early_{p}") > 0) & (F.col(f"late_{p}") > 0)
    early, late = F.col("early_spend"), F.col("late_spend")
    weight = F.when(late == early, early).otherwise(
        (late - early) / F.nullif(positive_ln(late) - positive_ln(early), F.lit(0.0))
    )
    shares = {
        f"{p}_contribution": F.when(
            eligible, weight * positive_ln(ratio(f"late_{p}", f"early_{p}"))
        )
        for p in parts
    }
    named = v.where(eligible | ~eligible).withColumn("_ok", eligible).withColumns(shares)
    a, b, c = (F.col(x) for x in shares)
    total = a + b + c
    delta = F.col("spend_change") - total
    return named.select(
        "category_key",
        "department",
        "commodity",
        "early_spend",
        "late_spend",
        "spend_change",
        *shares,
        total.alias("contribution_sum"),
        delta.alias("reconciliation_delta"),
        F.when(~F.col("_ok"), "NOT_APPLICABLE")
        .when(F.abs(delta) < 0.01, "PASS")
        .otherwise("REVIEW")
        .alias("reconciliation_status"),
        F.when(F.col("_ok"), text.CATEGORY_LMDI)
        .otherwise(text.CATEGORY_LMDI_WITHHELD)
        .alias("interpretation_boundary"),
    )


@table("analysis")
def analysis_demographic_summary(w):
    spend = w["household_week_spend"].groupBy("household_key").agg(
        F.sum("net_spend").alias("observed_lifetime_spend")
    )
    people = w["dim_household"].agg(F.count_distinct("household_key")).scalar()
    base = w["dim_household"].join(spend, "household_key", "left")
    long = base.unpivot(
        ["household_key", "observed_lifetime_spend"],
        list(DEMOGRAPHICS),
        "attribute_name",
        "attribute_value",
    )
    seen = F.count_distinct("household_key")
    return (
        long.groupBy("attribute_name", or_unknown("attribute_value").alias("attribute_value"))
        .agg(
            seen.alias("households"),
            F.sum("observed_lifetime_spend").alias("observed_lifetime_spend"),
        )
        .select(
            "*",
            ratio("households", people).alias("household_coverage"),
            F.lit(text.DEMOGRAPHICS).alias("interpretation_boundary"),
        )
    )


@table("analysis")
def analysis_first_observed_cohort(w):
    weeks = w.rules.window_weeks
    _, last = week_bounds(w)
    first_week = w["household_week_spend"].groupBy("household_key").agg(
        F.min("week_number").alias("first_observed_week"),
        F.sum("net_spend").alias("spend"),
        F.sum("baskets").alias("trips"),
        # The weeks of one household are few, and the second smallest decides the repeat.
        F.sort_array(F.collect_set("week_number")).alias("weeks"),
    )
    follow = F.col("first_observed_week") + weeks <= last
    second = F.try_element_at("weeks", F.lit(2))
    # rows without a household cannot be told to be the same household again
    again = F.col("household_key").isNotNull() & second.isNotNull() & (
        second <= F.col("first_observed_week") + weeks
    )
    return first_week.groupBy("first_observed_week").agg(
        F.count(F.lit(1)).alias("first_observed_households"),
        F.count_if(follow).alias("households_with_observable_follow_up"),
        F.count_if(follow & again).alias("repeat_households_within_13_weeks"),
        ratio(F.count_if(follow & again), F.count_if(follow)).alias(
            "observed_repeat_rate_within_13_weeks"
        ),
        mean("spend").alias("avg_observed_lifetime_spend"),
        mean("trips").alias("avg_observed_lifetime_baskets"),
        F.lit(text.COHORT).alias("interpretation_boundary"),
    )


@table("internal")
def trimmed_segment(w):
    """Segments recomputed without the last weeks; 'engaged' needs growth here, as specified.

    As in its SQL, a week whose spend is unknown is a week of its window and its discounts count in the
    discount share, and a household that is both (0 after 0, or a negative early average) is declining.
    """
    r = w.rules
    lo, hi = week_bounds(w)
    top = hi - F.lit(r.exclusion_weeks)
    early = in_first_weeks("week_number", lo, r.window_weeks)
    late = in_last_weeks("week_number", top, r.window_weeks)
    coupons = w["fct_basket"].where(F.col("week_number") <= top).groupBy("household_key").agg(
        ratio(F.count_if("has_coupon_discount"), F.count(F.lit(1))).alias("coupon_basket_rate")
    )
    summary = (
        w["household_week_spend"]
        .where(F.col("week_number") <= top)
        .groupBy("household_key")
        .agg(
            F.sum("net_spend").alias("observed_lifetime_spend"),
            F.sum("baskets").alias("frequency_baskets"),
            F.count("week_number").alias("active_weeks"),
            ratio(
                F.sum("discount_value"), F.sum("net_spend") + F.sum("discount_value")
            ).alias("discount_share"),
            ratio(F.sum("private_label_spend"), F.sum("net_spend")).alias("private_label_share"),
            ratio(F.sum(F.when(early, F.col("net_spend"))), F.count_if(early)).alias("early"),
            ratio(F.sum(F.when(late, F.col("net_spend"))), F.count_if(late)).alias("late"),
        )
        .join(coupons, "household_key", "left")
        .fillna(0.0, ["coupon_basket_rate"])
    )
    scored = with_quintiles(pinned(summary))
    declining = F.col("late") <= F.col("early") * F.lit(r.declining_factor)
    named = segment_label(r, declining, F.col("late") >= F.col("early") * F.lit(r.growing_factor))
    return scored.select("household_key", named.alias("trimmed_segment"))


@table("analysis")
def analysis_segment_stability(w):
    both = w["household_segment"].join(w["trimmed_segment"], "household_key", "left")
    total = total_rows(w["household_segment"])
    moves = both.groupBy(
        F.col("segment").alias("full_segment"),
        F.coalesce("trimmed_segment", F.lit(text.NOT_IN_TRIMMED)).alias("trimmed_segment"),
    ).agg(F.count(F.lit(1)).alias("household_count"))
    nothing = F.lit(None).cast("double")
    name = F.lit("full_vs_excluding_last_13_weeks").alias("comparison_name")
    note = F.lit(text.STABILITY).alias("interpretation_boundary")
    transitions = moves.select(
        name,
        F.lit("transition").alias("row_type"),
        "full_segment",
        "trimmed_segment",
        "household_count",
        ratio("household_count", total).alias("pct_of_households"),
        nothing.alias("unchanged_pct"),
        nothing.alias("moved_pct"),
        note,
    )
    kept = F.coalesce(F.col("segment") == F.col("trimmed_segment"), F.lit(False))
    rows = F.count(F.lit(1))
    overall = both.agg(
        rows.alias("household_count"),
        ratio(F.count_if(kept), rows).alias("unchanged_pct"),
        ratio(F.count_if(~kept), rows).alias("moved_pct"),
    ).select(
        name,
        F.lit("overall").alias("row_type"),
        F.lit(None).cast("string").alias("full_segment"),
        F.lit(None).cast("string").alias("trimmed_segment"),
        "household_count",
        F.lit(1.0).alias("pct_of_households"),
        "unchanged_pct",
        "moved_pct",
        note,
    )
    return overall.unionByName(transitions)


@table("analysis")
def campaign_kpi_scope(w):
    """Exposure-level and household-level campaign counts side by side."""
    used = F.col("redeemed_coupon_flag")
    counts = w["redeeming_exposures"].agg(
        F.count(F.lit(1)).alias("campaign_household_exposures"),
        F.count_if(used).alias("redeeming_exposures"),
        F.count_distinct("household_key").alias("unique_exposed_households"),
        F.count_distinct(redeemer()).alias("unique_redeeming_households"),
    )
    return counts.select(
        "*",
        ratio("redeeming_exposures", "campaign_household_exposures").alias(
            "exposure_redemption_rate"
        ),
        ratio("unique_redeeming_households", "unique_exposed_households").alias(
            "unique_household_redemption_rate"
        ),
    )
