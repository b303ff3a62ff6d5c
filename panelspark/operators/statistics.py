"""Statistics as distributed aggregates: moments, value-count ranks and a Poisson bootstrap."""

from pyspark.sql import functions as F

from panelspark import fixed_text as text
from panelspark.functions.bootstrap import bootstrap_interval
from panelspark.functions.columns import label, ratio, wilson
from panelspark.functions.ordering import pinned, with_before
from panelspark.functions.quantiles import weighted_quantile
from panelspark.functions.tails import chi_square_p, mann_whitney_p
from panelspark.operators.marts import trip_baskets
from panelspark.plans.registry import table


@table("internal")
def basket_value_counts(w):
    """Baskets per segment and value: what moments, medians and the bootstrap all read."""
    value = F.col("basket_net_spend").cast("decimal(16,4)").alias("value")
    baskets = trip_baskets(w).where("basket_net_spend IS NOT NULL")
    rows = baskets.join(w["household_segment"], "household_key", "left")
    counts = rows.select(label("segment").alias("segment"), value).groupBy("segment", "value")
    return pinned(counts.agg(F.count(F.lit(1)).alias("n")))


def basket_moments(w):
    """Per segment and for all others: n, exact sum and sum of squares."""
    x, n = F.col("value"), F.col("n").cast("decimal(18,0)")
    square = x.cast("double") * x.cast("double") * F.col("n")
    own = w["basket_value_counts"].groupBy("segment").agg(
        F.sum("n").alias("n"),
        F.sum((x * n).cast("decimal(34,4)")).alias("s"),
        F.sum(square).alias("q"),
    )
    parts = {"n": "bigint", "s": "decimal(38,4)", "q": "double"}
    all_of = own.agg(F.struct(*[F.sum(c).cast(t).alias(c) for c, t in parts.items()])).scalar()
    return own.select(
        "segment",
        *[F.col(c).cast(t).alias(c) for c, t in parts.items()],
        *[(all_of[c] - F.col(c)).cast(t).alias(f"o{c}") for c, t in parts.items()],
    )


@table("statistic")
def stats_basket_effect_size(w):
    """Mean, median, difference to all other segments and Cohen's d."""
    m = basket_moments(w)

    def spread(n, s, q):
        """Sum of squared deviations."""
        s = F.col(s).cast("double")
        return F.col(q).cast("double") - ratio(s * s, n)

    own, rest = spread("n", "s", "q"), spread("on", "os", "oq")
    pooled = ratio(own + rest, F.col("n") + F.col("on") - 2)
    gap = ratio("s", "n") - ratio("os", "on")
    enough = (F.col("n") >= 2) & (F.col("on") >= 2)
    effect = F.when(pooled <= 0, F.lit(0.0)).otherwise(gap / F.sqrt(pooled))
    counts = w["basket_value_counts"].withColumn("value", F.col("value").cast("double"))
    middle = weighted_quantile(counts, ["segment"], "value", "n", 0.5, "median_basket_value")
    return m.join(middle, "segment", "left").select(
        "segment",
        "n",
        ratio("s", "n").alias("mean_basket_value"),
        "median_basket_value",
        gap.alias("mean_vs_other_segments"),
        F.when(enough, effect).otherwise(F.lit(float("nan"))).alias("effect_size_cohens_d"),
        F.lit(text.STATS_BASKET).alias("limitation"),
    )


@table("statistic")
def stats_basket_by_segment(w):
    interval = bootstrap_interval(w["basket_value_counts"])
    return w["stats_basket_effect_size"].join(interval, "segment", "left").select(
        "segment",
        "n",
        "mean_basket_value",
        "median_basket_value",
        "mean_vs_other_segments",
        "ci_low",
        "ci_high",
        "effect_size_cohens_d",
        "limitation",
    )


@table("internal")
def promotion_values(w):
    """Sales per product-store-week by category, week and state."""
    return (
        w["promotion_amounts"]
        .where("product_store_weeks > 0 AND panel_sales IS NOT NULL")
        .select(
            label("promo_state_group").alias("promo_state_group"),
            ratio("panel_sales", "product_store_weeks").alias("value"),
        )
    )


@table("internal")
def promotion_ranks(w):
    """One row per (value, state) with ties and the rows below it, overall and in 'none'."""
    cells = pinned(
        w["promotion_values"].groupBy("value", "promo_state_group").agg(
            F.count(F.lit(1)).alias("n")
        )
    )
    base = F.col("promo_state_group") == "none"
    values = cells.groupBy("value").agg(
        F.sum("n").alias("ties"), F.sum(F.when(base, F.col("n")).otherwise(0)).alias("n0")
    )
    placed = with_before(
        values, [F.col("value")], {"before": F.col("ties"), "before0": F.col("n0")}
    )
    return pinned(cells.join(placed, "value"))


def tie_term(t):
    t = t.cast("decimal(20,0)")
    return (t * t).cast("decimal(38,0)") * t - t


@table("statistic")
def stats_promotion_kruskal(w):
    """Kruskal-Wallis H with tie correction over value-count ranks."""
    ranks = w["promotion_ranks"]
    # Twice the average rank is a whole number, so rank sums stay exact.
    twice = F.col("before") * 2 + F.col("ties") + 1
    groups = ranks.groupBy("promo_state_group").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * twice).alias("r2")
    )
    square_share = ratio(F.col("r2").cast("double") * F.col("r2"), F.col("n") * 4)
    whole = groups.agg(
        F.struct(
            F.sum("n").cast("double").alias("n"),
            F.count(F.lit(1)).cast("double").alias("k"),
            F.sum(square_share.cast("decimal(38,4)")).cast("double").alias("r"),
        )
    ).scalar()
    ties = (
        ranks.select("value", "ties")
        .distinct()
        .agg(F.sum(tie_term(F.col("ties")).cast("decimal(38,0)")).cast("double"))
        .scalar()
    )
    n, k = F.col("_w.n"), F.col("_w.k")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("_w.r") - F.lit(3.0) * (n + 1)
    h = raw / F.nullif(F.lit(1.0) - F.col("_t") / (n * n * n - n), F.lit(0.0))
    nan = F.lit(float("nan"))
    eta = F.when(n > k, F.greatest(F.lit(0.0), ratio(h - k + 1, n - k))).otherwise(nan)
    kept = F.col("value").cast("double") * F.col("n")
    stats = ranks.groupBy("promo_state_group").agg(
        F.sum("n").alias("n"),
        ratio(F.sum(kept), F.sum("n")).alias("mean_panel_sales_per_product_store_week"),
    )
    cells = ranks.select("promo_state_group", "value", F.col("n").alias("c"))
    middle = weighted_quantile(
        cells,
        ["promo_state_group"],
        "value",
        "c",
        0.5,
        "median_panel_sales_per_product_store_week",
    )
    return (
        stats.join(middle, "promo_state_group", "left")
        .withColumn("_w", whole)
        .withColumn("_t", ties)
        .select(
            "promo_state_group",
            "n",
            "mean_panel_sales_per_product_store_week",
            "median_panel_sales_per_product_store_week",
            F.when(k >= 2, h).otherwise(nan).alias("kruskal_wallis_stat"),
            F.when(k >= 2, chi_square_p(h, k - 1)).otherwise(nan).alias("kruskal_wallis_p_value"),
            F.when(k >= 2, eta).otherwise(nan).alias("effect_size_eta_squared"),
        )
    )


@table("statistic")
def stats_promotion_mann_whitney(w):
    """Each state against 'none'; NaN where there is nothing to compare with."""
    ranks = w["promotion_ranks"]
    twice = F.col("n") * (F.col("before0") * 2 + F.col("n0"))
    base = ranks.where(F.col("promo_state_group") == "none")
    size0 = base.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    # Values only 'none' holds are tied among themselves in every pair.
    ties0 = base.agg(F.sum(tie_term(F.col("n")).cast("decimal(38,0)"))).scalar()
    pair_ties = tie_term(F.col("n") + F.col("n0")) - tie_term(F.col("n0"))
    pairs = ranks.groupBy("promo_state_group").agg(
        F.sum("n").alias("n1"),
        F.sum(twice).alias("u2"),
        F.sum(pair_ties.cast("decimal(38,0)")).alias("extra"),
    )
    valid = (F.col("promo_state_group") != "none") & (F.col("n0") > 0)
    u = F.col("u2").cast("double") / 2.0
    nan = F.lit(float("nan"))
    ties = (F.coalesce(F.col("t0"), F.lit(0)) + F.col("extra")).cast("double")
    return (
        pairs.withColumn("n0", size0)
        .withColumn("t0", ties0)
        .select(
            "promo_state_group",
            F.when(valid, u).otherwise(nan).alias("mann_whitney_u_vs_none"),
            F.when(valid, mann_whitney_p(u, "n1", "n0", ties))
            .otherwise(nan)
            .alias("mann_whitney_p_value_vs_none"),
            F.when(
                valid,
                F.lit(1.0) - ratio(u * 2.0, F.col("n1").cast("double") * F.col("n0")),
            )
            .otherwise(nan)
            .alias("effect_size_rank_biserial_vs_none"),
        )
    )


@table("statistic")
def stats_promotion_state(w):
    """Both promotion tests in one report row per state."""
    pair = w["stats_promotion_mann_whitney"]
    return (
        w["stats_promotion_kruskal"]
        .join(pair, "promo_state_group", "left")
        .withColumn("limitation", F.lit(text.STATS_PROMOTION))
    )


@table("statistic")
def stats_campaign_redemption(w):
    kind = label("campaign_type").alias("campaign_type")
    groups = w["redeeming_exposures"].groupBy(kind).agg(
        F.count(F.lit(1)).alias("n_recipients"),
        F.count_if("redeemed_coupon_flag").alias("redeemers"),
    )
    return groups.select(
        "*",
        ratio("redeemers", "n_recipients").alias("redemption_rate"),
        wilson("redeemers", "n_recipients", -1).alias("ci_low"),
        wilson("redeemers", "n_recipients", 1).alias("ci_high"),
        F.lit(text.STATS_CAMPAIGN).alias("limitation"),
    )


def contingency_test(groups, hits, size):
    """Chi-square without continuity correction for groups x (hit, miss), as one row."""
    whole = groups.agg(
        F.struct(
            F.sum(size).cast("double").alias("n"),
            F.sum(hits).cast("double").alias("h"),
            F.count(F.lit(1)).cast("double").alias("k"),
            F.min(size).alias("least"),
        )
    ).scalar()
    n, h = F.col("_w.n"), F.col("_w.h")
    expected = F.col(size) * h / n
    missed = F.col(size) * (n - h) / n
    gap = F.col(hits).cast("double") - expected
    cell = ratio(gap * gap, expected) + ratio(gap * gap, missed)
    valid = (F.col("k") >= 2) & (F.col("h") > 0) & (F.col("h") < F.col("n")) & (F.col("least") > 0)
    nan = F.lit(float("nan"))
    total = (
        groups.withColumn("_w", whole)
        .agg(F.sum(cell.cast("decimal(38,10)")).cast("double").alias("x"), F.max("_w").alias("_w"))
        .select("x", "_w.*")
    )
    return total.select(
        F.when(valid, F.col("x")).otherwise(nan).alias("chi_square_statistic"),
        F.when(valid, chi_square_p("x", F.col("k") - 1)).otherwise(nan).alias("chi_square_p_value"),
        F.when(valid, F.sqrt(ratio("x", F.col("n")))).otherwise(nan).alias("effect_size_cramers_v"),
    )


@table("statistic")
def stats_campaign_chi_square(w):
    return contingency_test(w["stats_campaign_redemption"], "redeemers", "n_recipients")
