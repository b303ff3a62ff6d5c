"""Findings, statistics, measures, exports, snapshots and source operations."""

from oracle.analysis import q, wilson
from oracle.layers import div
from oracle.quality import union
from panelspark import fixed_text as text
from panelspark.operators.exports import EXPORTS
from panelspark.operators.measures import RELATIONSHIPS
from panelspark.sources.contracts import CONTRACTS

BODIES = {}

# ---------------------------------------------------------------- findings
BODIES["finding_window_comparison"] = """
SELECT *, CASE greatest(abs(a), abs(b), abs(c)) WHEN abs(a) THEN 'Active Panel Households'
               WHEN abs(b) THEN 'Trips per Active Household' ELSE 'Spend per Basket' END
          AS primary_driver
FROM (SELECT es AS early_spend, eh::BIGINT AS early_households, eb::BIGINT AS early_baskets,
             ls AS late_spend, lh::BIGINT AS late_households, lb::BIGINT AS late_baskets, ls - es AS spend_change, lh / eh - 1 AS a,
             (lb / lh) / (eb / eh) - 1 AS b, (ls / lb) / (es / eb) - 1 AS c FROM distinct_sides)
"""
BODIES["finding_window_comparison"] = (
    "SELECT * RENAME (a AS active_households_change, b AS trips_per_household_change, "
    "c AS spend_per_basket_change) FROM (" + BODIES["finding_window_comparison"] + ")"
)
BODIES["finding_category_erosion"] = f"""
SELECT *, {div("spend_change", "early_spend")} AS spend_change_pct
FROM analysis_category_decomposition WHERE early_spend > 0 AND late_spend IS NOT NULL
ORDER BY spend_change_pct, department NULLS FIRST, commodity NULLS FIRST LIMIT 1
"""
for _name, _order in (("weakest", "ASC"), ("strongest", "DESC")):
    BODIES[f"finding_{_name}_campaign"] = f"""
SELECT campaign_id, campaign_type, campaign_recipients, campaign_redeemers,
       campaign_redemption_rate, post_28d_observable_rows
FROM analysis_campaign_funnel WHERE campaign_recipients >= 50
ORDER BY campaign_redemption_rate {_order} NULLS LAST, campaign_id LIMIT 1
"""
BODIES["finding_segment_rollup"] = """
SELECT segment, count(*) AS households, sum(observed_lifetime_spend) AS spend,
       count(*) FILTER (trajectory = 'Declining') AS declining_households
FROM mart_customer_segment GROUP BY segment
"""
BODIES["finding_promo_rank"] = f"""
SELECT promo_state_group, sum(product_store_weeks) AS product_store_weeks,
       sum(panel_sales) AS panel_sales,
       {div("sum(panel_sales)", "sum(product_store_weeks)")} AS sales_per_product_store_week
FROM mart_promotion_category_week GROUP BY promo_state_group
"""

# -------------------------------------------------------------- statistics
BODIES["segment_values"] = """
SELECT COALESCE(NULLIF(trim(segment), ''), 'Unknown') AS segment, basket_net_spend AS x
FROM mart_basket WHERE basket_net_spend IS NOT NULL
"""
BODIES["segment_split"] = """
SELECT g.segment, v.x, v.segment = g.segment AS own
FROM (SELECT DISTINCT segment FROM segment_values) g CROSS JOIN segment_values v
"""
BODIES["stats_basket_effect_size"] = f"""
SELECT segment, n, m1 AS mean_basket_value, med AS median_basket_value,
       m1 - m2 AS mean_vs_other_segments,
       CASE WHEN n < 2 OR o < 2 THEN 'NaN'::DOUBLE
            WHEN (n - 1) * v1 + (o - 1) * v2 <= 0 THEN 0
            ELSE (m1 - m2) / sqrt(((n - 1) * v1 + (o - 1) * v2) / (n + o - 2)) END
           AS effect_size_cohens_d,
       {q(text.STATS_BASKET)} AS limitation
FROM (SELECT segment, count(*) FILTER (own) AS n, count(*) FILTER (NOT own) AS o,
             {div("sum(x) FILTER (own)", "count(*) FILTER (own)")} AS m1,
             {div("sum(x) FILTER (NOT own)", "count(*) FILTER (NOT own)")} AS m2,
             median(CAST(x AS DOUBLE)) FILTER (own) AS med,
             var_samp(CAST(x AS DOUBLE)) FILTER (own) AS v1,
             var_samp(CAST(x AS DOUBLE)) FILTER (NOT own) AS v2
      FROM segment_split GROUP BY segment)
"""
BODIES["promo_values"] = f"""
SELECT promo_state_group AS st, {div("panel_sales", "product_store_weeks")} AS v
FROM mart_promotion_category_week WHERE product_store_weeks > 0
"""
BODIES["promo_ranked"] = """
SELECT st, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r,
       count(*) OVER (PARTITION BY v) AS t
FROM promo_values
"""


def upper_gamma(a, y):
    """Upper regularised gamma Q(a, y) by the lower series, all of whose terms are positive; a chi-square
    tail is Q(df / 2, x / 2), erfc(z) is Q(1 / 2, z * z). Beyond y = 700 it is under 1e-300."""
    term = f"exp(({a} + i) * ln({y}) - ({y}) - lgamma({a} + i + 1))"
    return (
        f"CASE WHEN {y} <= 0 THEN 1.0::DOUBLE WHEN {y} > 700 THEN 0.0::DOUBLE "
        f"ELSE greatest(0.0::DOUBLE, 1 - list_sum(list_transform(range(0, 3000), lambda i: {term}))) END"
    )


BODIES["kruskal"] = """
SELECT n, k, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h
FROM (SELECT CAST(sum(c) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum(rs * rs / c) AS s
      FROM (SELECT st, count(*) AS c, sum(r) AS rs FROM promo_ranked GROUP BY st)),
     (SELECT sum(CAST(t AS DOUBLE) * t * t - t) AS tie FROM (SELECT DISTINCT v, t FROM promo_ranked))
"""
BODIES["stats_promotion_kruskal"] = f"""
SELECT st AS promo_state_group, count(*) AS n,
       avg(CAST(v AS DOUBLE)) AS mean_panel_sales_per_product_store_week,
       median(v) AS median_panel_sales_per_product_store_week,
       any_value(h) AS kruskal_wallis_stat, any_value(p) AS kruskal_wallis_p_value,
       greatest(0, (any_value(h) - any_value(k) + 1) / (any_value(kruskal.n) - any_value(k)))
           AS effect_size_eta_squared
FROM promo_values, (SELECT *, {upper_gamma("((k - 1) / 2)", "(h / 2)")} AS p FROM kruskal) kruskal GROUP BY st
"""
BODIES["rank_sums"] = """
SELECT st, u, n1, n0, CASE WHEN spread > 0 THEN (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / spread END AS z
FROM (SELECT *, sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS spread
      FROM (SELECT st, CAST(count(*) FILTER (own = st) AS DOUBLE) AS n1,
                   CAST(count(*) FILTER (own <> st) AS DOUBLE) AS n0,
                   sum(r) FILTER (own = st)
                   - CAST(count(*) FILTER (own = st) AS DOUBLE) * (count(*) FILTER (own = st) + 1) / 2 AS u,
                   sum(CAST(t AS DOUBLE) * t - 1) AS ties
            FROM (SELECT s.st AS st, x.st AS own, count(*) OVER (PARTITION BY s.st, x.v) AS t,
                         rank() OVER (PARTITION BY s.st ORDER BY x.v)
                         + (count(*) OVER (PARTITION BY s.st, x.v) - 1) / 2.0::DOUBLE AS r
                  FROM (SELECT DISTINCT st FROM promo_values WHERE st <> 'none') s
                  JOIN promo_values x ON x.st IN (s.st, 'none'))
            GROUP BY st))
"""
BODIES["stats_promotion_mann_whitney"] = f"""
SELECT st AS promo_state_group, u AS mann_whitney_u_vs_none,
       CASE WHEN z IS NULL OR z <= 0 THEN 1.0::DOUBLE ELSE {upper_gamma("0.5::DOUBLE", "(z * z / 2)")} END
           AS mann_whitney_p_value_vs_none,
       1 - 2 * u / (n1 * n0) AS effect_size_rank_biserial_vs_none
FROM rank_sums
UNION ALL SELECT 'none', 'NaN'::DOUBLE, 'NaN'::DOUBLE, 'NaN'::DOUBLE
WHERE EXISTS (SELECT 1 FROM promo_values WHERE st = 'none')
"""
BODIES["stats_campaign_redemption"] = f"""
SELECT kind AS campaign_type, n AS n_recipients, k AS redeemers, {div("k", "n")} AS redemption_rate,
       {wilson("k", "n", "-")} AS ci_low, {wilson("k", "n", "+")} AS ci_high,
       {q(text.STATS_CAMPAIGN)} AS limitation
FROM (SELECT COALESCE(NULLIF(trim(campaign_type), ''), 'Unknown') AS kind, count(*) AS n,
             count(*) FILTER (redeemed_coupon_flag) AS k
      FROM mart_campaign_household GROUP BY 1)
"""
BODIES["stats_campaign_chi_square"] = """
SELECT x AS chi_square_statistic, exp(-x / 2) AS chi_square_p_value,
       sqrt(x / n) AS effect_size_cramers_v
FROM (SELECT sum((o - e) * (o - e) / e) AS x, any_value(n) AS n
      FROM (SELECT CAST(c.o AS DOUBLE) AS o, c.size * CAST(t.tot AS DOUBLE) / n AS e, n
            FROM (SELECT campaign_type, TRUE AS hit, redeemers AS o, n_recipients AS size
                  FROM stats_campaign_redemption
                  UNION ALL SELECT campaign_type, FALSE, n_recipients - redeemers, n_recipients
                  FROM stats_campaign_redemption) c
            JOIN (SELECT redeemed_coupon_flag AS hit, count(*) AS tot, sum(count(*)) OVER () AS n
                  FROM mart_campaign_household GROUP BY 1) t ON t.hit = c.hit))
"""

# ---------------------------------------------------------------- measures
_BASKET = {
    "Panel Net Spend": "sum(basket_net_spend)",
    "Panel Gross Spend": "sum(basket_gross_spend)",
    "Total Recorded Discount": "sum(basket_discount_value)",
    "Discount Rate": div("sum(basket_discount_value)", "sum(basket_gross_spend)"),
    "Baskets": "count(*)",
    "Active Panel Households": "count(DISTINCT household_key)",
    "Spend per Basket": div("sum(basket_net_spend)", "count(*)"),
    "Trips per Active Household": div("count(*)", "count(DISTINCT household_key)"),
    "Spend per Active Household": div("sum(basket_net_spend)", "count(DISTINCT household_key)"),
    "Spend Driver Check": "CAST(count(DISTINCT household_key) AS DOUBLE) * ("
    + div("count(*)", "count(DISTINCT household_key)")
    + ") * ("
    + div("sum(basket_net_spend)", "count(*)")
    + ")",
    "Coupon Baskets": "count(*) FILTER (has_coupon_discount)",
    "Coupon Basket Rate": div("count(*) FILTER (has_coupon_discount)", "count(*)"),
}
_WEEKLY = {
    "Private Label Spend": "sum(private_label_spend)",
    "Private Label Share": div("sum(private_label_spend)", "sum(panel_net_spend)"),
}
_CAMPAIGN = {
    "Campaign Recipients": "count(DISTINCT household_key)",
    "Campaign Redeemers": "count(DISTINCT household_key) FILTER (redeemed_coupon_flag)",
    "Campaign Redemption Rate": div(
        "count(DISTINCT household_key) FILTER (redeemed_coupon_flag)",
        "count(DISTINCT household_key)",
    ),
}
_PROMO = {
    "Promo Product-Store-Weeks": "sum(product_store_weeks)",
    "Promo Panel Sales": "sum(panel_sales)",
    "Promo Sales per PSW": f"avg({div('panel_sales', 'product_store_weeks')})",
    "Promoted State Sales Share": div(
        "sum(panel_sales) FILTER (promo_state_group <> 'none')", "sum(panel_sales)"
    ),
    "Promotion Dependency": div(
        "sum(product_store_weeks) FILTER (promo_state_group <> 'none')", "sum(product_store_weeks)"
    ),
    "Display + Mailer Activity": div(
        "sum(product_store_weeks) FILTER (promo_state_group = 'display_and_mailer')",
        "sum(product_store_weeks)",
    ),
}
_STORE = {"Store Panel Net Spend": "sum(panel_net_spend)", "Store Baskets": "sum(baskets)"}


def _mean(c):
    return f"avg(CAST({c} AS DOUBLE))"


def long(measures, source, by=""):
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return union(
        f"SELECT {keys}'{n}' AS measure, CAST({e} AS DOUBLE) AS value FROM {source}{group}"
        for n, e in measures.items()
    )


BODIES["measures_core"] = union(
    [
        long(_BASKET, "mart_basket"),
        long(_WEEKLY, "mart_panel_weekly"),
        long(
            {
                "Category Household Penetration": div(
                    "sum(buying_households)", "sum(panel_households)"
                )
            },
            "analysis_category_penetration",
        ),
        long(_CAMPAIGN, "mart_campaign_household"),
        long({"Decision Alert Count": "count(*)"}, "mart_decision_alerts"),
    ]
)
BODIES["measures_core_by_segment"] = long(_BASKET, "mart_basket", "segment")
BODIES["measures_core_by_week"] = union(
    [long(_BASKET, "mart_basket", "week_number"), long(_WEEKLY, "mart_panel_weekly", "week_number")]
)
BODIES["basket_with_age"] = """
SELECT b.*, d.age_desc FROM mart_basket b LEFT JOIN dim_household d ON d.household_key = b.household_key
"""
BODIES["measures_core_by_age"] = long(_BASKET, "basket_with_age", "age_desc")
BODIES["exposure_with_type"] = """
SELECT e.*, d.campaign_type AS kind FROM mart_campaign_household e
JOIN dim_campaign d ON d.campaign_id = e.campaign_id WHERE d.start_day > 100
"""
BODIES["measures_campaign_by_type"] = "SELECT * RENAME (kind AS campaign_type) FROM (" + long(
    {
        **_CAMPAIGN,
        "Campaign-Household Exposures": "count(*)",
        "Redeeming Exposures": "count(*) FILTER (redeemed_coupon_flag)",
        "Exposure Redemption Rate": div("count(*) FILTER (redeemed_coupon_flag)", "count(*)"),
    },
    "exposure_with_type",
    "kind",
) + ")"
BODIES["panel_with_week"] = """
SELECT p.*, d.observation_week FROM mart_panel_weekly p LEFT JOIN dim_week d ON d.week_number = p.week_number
"""
BODIES["store_with_week"] = """
SELECT p.*, d.observation_week FROM mart_store_weekly p LEFT JOIN dim_week d ON d.week_number = p.week_number
"""
BODIES["measures_core_by_dim_week"] = union(
    [long(_WEEKLY, "panel_with_week", "observation_week"), long(_STORE, "store_with_week", "observation_week")]
)
BODIES["measures_supplement"] = union(
    [
        long(
            {"Dynamic Category Buying Households": "count(DISTINCT household_key)"},
            "mart_category_household_weekly",
        ),
        long(_STORE, "mart_store_weekly"),
        long(
            {
                "Campaign-Household Exposures": "count(*)",
                "Redeeming Exposures": "count(*) FILTER (redeemed_coupon_flag)",
                "Exposure Redemption Rate": div(
                    "count(*) FILTER (redeemed_coupon_flag)", "count(*)"
                ),
            },
            "mart_campaign_household",
        ),
        long(
            {
                "Root Cause Spend Contribution": "sum(spend_change_contribution)",
                "Root Cause Contribution Share": "sum(contribution_share)",
            },
            "root_cause_drivers",
        ),
    ]
)
BODIES["measures_store_by_week"] = long(_STORE, "mart_store_weekly", "week_number")
BODIES["measures_dynamic_penetration"] = f"""
SELECT category_key, n AS dynamic_category_buying_households, act AS active_panel_households,
       {div("n", "act")} AS dynamic_category_household_penetration
FROM (SELECT category_key, count(DISTINCT household_key) AS n
      FROM mart_category_household_weekly, week_cuts WHERE week_number >= last_start GROUP BY 1),
     (SELECT count(DISTINCT household_key) AS act FROM mart_basket, week_cuts
      WHERE week_number >= last_start)
"""


def windows(by=""):
    keys = f"{by}, " if by else ""
    sides = []
    for side, cond in (("first_13w", "week_number <= first_end"), ("last_13w", "week_number >= last_start")):
        s = f"CAST(sum(basket_net_spend) FILTER ({cond}) AS DOUBLE)"
        h = f"count(DISTINCT household_key) FILTER ({cond})"
        b = f"count(*) FILTER ({cond})"
        sides += [
            f"{s} AS {side}_panel_spend",
            f"CAST(NULLIF({h}, 0) AS DOUBLE) AS {side}_active_households",
            f"CAST(NULLIF({b}, 0) AS DOUBLE) AS {side}_baskets",
            f"{div(s, b)} AS {side}_spend_per_basket",
            f"{div(b, h)} AS {side}_trips_per_household",
            f"{div(s, h)} AS {side}_spend_per_active_household",
        ]
    names = (
        "panel_spend",
        "active_households",
        "baskets",
        "spend_per_basket",
        "trips_per_household",
        "spend_per_active_household",
    )
    changes = ", ".join(
        f"{div(f'last_13w_{c} - first_13w_{c}', f'first_13w_{c}')} AS {c}_change_pct".replace(
            f"CAST(last_13w_{c} - first_13w_{c} AS DOUBLE)", f"(last_13w_{c} - first_13w_{c})"
        )
        for c in names
    )
    group = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT *, {changes} FROM (SELECT {keys}{', '.join(sides)} "
        f"FROM mart_basket, week_cuts{group})"
    )


BODIES["measures_window_13w"] = windows()
BODIES["measures_window_13w_by_segment"] = windows("segment")
BODIES["measures_category_13w"] = f"""
SELECT *, {div("last_13w_category_spend - first_13w_category_spend", "first_13w_category_spend")}
              AS category_spend_change_pct
FROM (SELECT category_key,
             CAST(sum(panel_net_spend) FILTER (week_number <= first_end) AS DOUBLE)
                 AS first_13w_category_spend,
             CAST(sum(panel_net_spend) FILTER (week_number >= last_start) AS DOUBLE)
                 AS last_13w_category_spend
      FROM mart_category_weekly, week_cuts GROUP BY category_key)
"""
BODIES["segment_share_of_total"] = f"""
SELECT segment, count(DISTINCT household_key) AS segment_households,
       sum(basket_net_spend) AS segment_spend,
       {div("sum(basket_net_spend)", "sum(sum(basket_net_spend)) OVER ()")} AS segment_spend_share,
       {div("sum(basket_net_spend)", "count(*)")} AS segment_avg_basket
FROM mart_basket GROUP BY segment
"""
BODIES["measures_promotion"] = long(_PROMO, "mart_promotion_category_week")
BODIES["measures_promotion_by_department"] = long(
    _PROMO, "mart_promotion_category_week", "department"
)
BODIES["measures_campaign"] = long(
    {
        "Summed Campaign Recipients": "sum(campaign_recipients)",
        "Summed Campaign Redeemers": "sum(campaign_redeemers)",
        "Summed Campaign Redemption Rate": div("sum(campaign_redeemers)", "sum(campaign_recipients)"),
        "Avg Pre 28d Spend": _mean("avg_pre_28d_spend"),
        "Avg During Spend": _mean("avg_during_spend"),
        "Avg Post 28d Spend": _mean("avg_post_28d_spend"),
    },
    "mart_campaign_summary",
)
BODIES["measures_campaign_slices"] = f"""
SELECT campaign_id, avg_pre_28d_spend AS pre_spend, avg_during_spend AS during_spend,
       avg_post_28d_spend AS post_spend,
       {div("campaign_redeemers", "campaign_recipients")} AS redemption_rate,
       (avg_during_spend - avg_pre_28d_spend) / NULLIF(avg_pre_28d_spend, 0) AS during_vs_pre_change
FROM mart_campaign_summary
"""
BODIES["measures_category"] = union(
    [
        long(
            {
                "Category Spend": "sum(panel_net_spend)",
                "Category Baskets": "sum(category_baskets)",
                "Category Buyers": "sum(buying_households)",
                "Category Penetration": div(
                    "sum(buying_households)", "sum(active_panel_households)"
                ),
                "Spend per Category Basket": div("sum(panel_net_spend)", "sum(category_baskets)"),
            },
            "mart_category_weekly",
            "department",
        ),
        long(
            {
                "Brand Private Label Spend": "COALESCE(sum(panel_net_spend) FILTER "
                "(brand_type = 'PRIVATE'), 0)",
                "Brand Private Label Share": div(
                    "COALESCE(sum(panel_net_spend) FILTER (brand_type = 'PRIVATE'), 0)",
                    "sum(panel_net_spend)",
                ),
            },
            "mart_brand_category",
            "department",
        ),
    ]
)
_SEGMENTS = ", ".join(
    f"('{s}')"
    for s in (
        "High-Value Declining",
        "High-Value Engaged",
        "Frequent Core",
        "Promotion-Responsive",
        "Private-Label Loyal",
        "Occasional",
        "Low-Engagement",
    )
)
BODIES["segment_names"] = f"SELECT * FROM (VALUES {_SEGMENTS}) AS t(segment)"
BODIES["star_relationships"] = union(
    f"SELECT '{dim}' AS from_table, '{fact}' AS to_table, '{key}' AS key_column, "
    f"(SELECT count(*) - count(DISTINCT {key}) FROM {'segment_names' if dim == 'dim_segment' else dim})"
    f" AS duplicate_dimension_keys, count(*) FILTER (d.k IS NULL) AS orphan_rows, "
    f"CASE WHEN count(*) FILTER (d.k IS NULL) = 0 AND "
    f"(SELECT count(*) - count(DISTINCT {key}) FROM {'segment_names' if dim == 'dim_segment' else dim}) = 0 "
    f"THEN 'PASS' ELSE 'REVIEW' END AS status "
    f"FROM {fact} f LEFT JOIN (SELECT DISTINCT {key} AS k FROM "
    f"{'segment_names' if dim == 'dim_segment' else dim}) d ON d.k = f.{key}"
    for (dim, key), facts in RELATIONSHIPS.items()
    for fact in facts
)

# ----------------------------------------------------------------- exports
_HEAD = {
    "Panel Net Spend": ("mart_basket", "sum(basket_net_spend)"),
    "Baskets": ("mart_basket", "count(*)"),
    "Active Panel Households": ("mart_basket", "count(DISTINCT household_key)"),
    "Spend per Basket": ("mart_basket", div("sum(basket_net_spend)", "count(*)")),
    "Private Label Share": (
        "mart_panel_weekly",
        div("sum(private_label_spend)", "sum(panel_net_spend)"),
    ),
    "Campaign Recipients": ("mart_campaign_household", "count(DISTINCT household_key)"),
    "Campaign Redeemers": (
        "mart_campaign_household",
        "count(DISTINCT household_key) FILTER (redeemed_coupon_flag)",
    ),
    "Redemption Rate": (
        "mart_campaign_household",
        div(
            "count(DISTINCT household_key) FILTER (redeemed_coupon_flag)",
            "count(DISTINCT household_key)",
        ),
    ),
}
for _name, _value in (("export_metric_reconciliation", "sql_value"), ("metric_totals", "value")):
    BODIES[_name] = union(
        f"SELECT '{m}' AS metric, CAST({e} AS DOUBLE) AS {_value} FROM {t}"
        for m, (t, e) in _HEAD.items()
    )
BODIES["metric_reconcile"] = """
SELECT metric, sql_value, value AS export_value, abs(sql_value - value) AS difference,
       CAST(0.000001 AS DOUBLE) AS tolerance,
       CASE WHEN abs(sql_value - value) <= 0.000001 THEN 'pass' ELSE 'fail' END AS status,
       'curated_export_snapshot' AS comparison_scope
FROM export_metric_reconciliation FULL JOIN metric_totals USING (metric)
"""
BODIES["export_decision_alerts"] = "SELECT * FROM mart_decision_alerts WHERE severity <> 'normal'"


def _rows(name):
    source = {"dim_segment": "segment_names", "fct_coupon_redemption": "stg_coupon_redemption"}
    return source.get(name, name)


BODIES["export_curated"] = union(
    f"SELECT '{t}' AS table_name, "
    f"'{'_'.join('LMDI' if p == 'lmdi' else p.capitalize() for p in t.split('_'))}' AS export_name, "
    f"'manual' AS pipeline_run_id, count(*) AS rows_written, 'success' AS status, '' AS error "
    f"FROM {_rows(t)}"
    for t in EXPORTS
)
#: Per model, the sources and tables it reads.
INPUTS = {
    "dim_day": "stg_transaction",
    "dim_week": "stg_transaction",
    "dim_household": "stg_household_demographic stg_transaction",
    "dim_product": "src_product",
    "dim_store": "stg_transaction",
    "dim_campaign": "stg_campaign",
    "dim_coupon": "stg_coupon_product stg_coupon_redemption",
    "dim_category": "dim_product",
    "dim_segment": "",
    "fct_transaction_line": "stg_transaction",
    "fct_basket": "dim_product stg_transaction",
    "fct_promotion_product_store_week": "stg_promotion_state",
    "fct_campaign_exposure": "dim_campaign stg_campaign_exposure stg_transaction",
    "fct_coupon_redemption": "stg_coupon_redemption",
    "bridge_coupon_product_campaign": "stg_coupon_product",
    "mart_panel_weekly": "dim_category dim_product fct_basket stg_transaction",
    "mart_household_weekly": "dim_category dim_product stg_transaction",
    "mart_household_summary": "fct_basket mart_household_weekly stg_household_demographic stg_transaction",
    "mart_customer_segment": "mart_household_summary",
    "mart_basket": "dim_category dim_product fct_basket stg_household_demographic stg_transaction",
    "mart_category_weekly": "dim_category dim_product fct_basket stg_transaction",
    "mart_brand_category": "dim_category dim_product stg_transaction",
    "mart_promotion_category_week": "dim_category dim_product fct_promotion_product_store_week stg_transaction",
    "mart_campaign_household": "dim_category dim_product fct_basket fct_campaign_exposure stg_coupon_redemption "
    "stg_household_demographic stg_transaction",
    "mart_campaign_summary": "mart_campaign_household",
    "mart_coupon_summary": "bridge_coupon_product_campaign stg_coupon_redemption",
    "mart_cross_category_pair": "dim_product stg_transaction",
    "mart_decision_alerts": "mart_panel_weekly",
    "mart_category_household": "dim_category dim_product stg_transaction",
    "mart_category_household_weekly": "dim_product stg_transaction",
    "mart_store_weekly": "stg_transaction",
}
BODIES["run_row_metrics"] = union(
    f"SELECT 'manual' AS run_id, '{t}' AS table_name, "
    f"CAST({' + '.join(f'(SELECT count(*) FROM {_rows(i)})' for i in inputs.split()) or '0'} AS BIGINT) AS rows_read, "
    f"count(*) AS rows_written, 'success' AS status, '' AS error FROM {_rows(t)}"
    for t, inputs in INPUTS.items()
)

# --------------------------------------------------------------- snapshots
BODIES["snapshot_top_commodities"] = """
SELECT department, commodity, panel_net_spend AS spend, buying_households,
       household_penetration AS penetration, category_baskets AS baskets,
       spend_per_category_basket AS spend_per_basket, private_label_share
FROM analysis_category_penetration ORDER BY panel_net_spend DESC, department, commodity LIMIT 10
"""
BODIES["snapshot_segments"] = f"""
SELECT segment, count(*) AS households, sum(observed_lifetime_spend) AS spend,
       sum(frequency_baskets) AS trips,
       {div("sum(observed_lifetime_spend)", "sum(frequency_baskets)")} AS spend_per_basket,
       {div("sum(frequency_baskets)", "count(*)")} AS avg_trips_per_household,
       count(*) FILTER (trajectory = 'Declining') AS declining_households
FROM mart_customer_segment GROUP BY segment
"""
BODIES["snapshot_promo_states"] = f"""
SELECT promo_state_group, sum(product_store_weeks) AS product_store_weeks,
       sum(panel_sales) AS panel_sales, sum(panel_baskets) AS panel_baskets,
       {div("sum(panel_sales)", "sum(product_store_weeks)")} AS sales_per_product_store_week
FROM mart_promotion_category_week GROUP BY 1
"""
BODIES["snapshot_promotion_weekly"] = """
SELECT week_number, promo_state_group, sum(product_store_weeks) AS product_store_weeks,
       sum(panel_sales) AS panel_sales
FROM mart_promotion_category_week GROUP BY 1, 2
"""
BODIES["snapshot_trajectories"] = """
SELECT segment, trajectory, count(*) AS households FROM mart_customer_segment GROUP BY 1, 2
"""
BODIES["snapshot_declining_households"] = """
SELECT household_key, observed_lifetime_spend, absolute_change, early_avg_weekly_spend,
       late_avg_weekly_spend, trajectory
FROM mart_household_summary WHERE trajectory = 'Declining'
ORDER BY absolute_change, household_key LIMIT 12
"""
BODIES["snapshot_brand_mix"] = """
SELECT brand_type, sum(panel_net_spend) AS spend, sum(buying_households) AS households,
       sum(baskets) AS baskets FROM mart_brand_category GROUP BY 1
"""
BODIES["snapshot_department_brand"] = """
SELECT department, sum(panel_net_spend) FILTER (brand_type = 'NATIONAL') AS "NATIONAL",
       sum(panel_net_spend) FILTER (brand_type = 'PRIVATE') AS "PRIVATE",
       sum(panel_net_spend) AS total_spend
FROM mart_brand_category GROUP BY 1 ORDER BY total_spend DESC, department LIMIT 12
"""
BODIES["snapshot_campaign_types"] = f"""
SELECT campaign_type, sum(campaign_recipients) AS recipients, sum(campaign_redeemers) AS redeemers,
       sum(post_28d_observable_rows) AS observable_rows,
       {div("sum(campaign_redeemers)", "sum(campaign_recipients)")} AS redemption_rate
FROM mart_campaign_summary GROUP BY 1
"""
BODIES["snapshot_campaign_segments"] = f"""
SELECT customer_segment AS segment, sum(recipient_households) AS recipients,
       sum(redeemer_households) AS redeemers, sum(post_28d_observable_rows) AS observable_rows,
       {div("sum(redeemer_households)", "sum(recipient_households)")} AS redemption_rate
FROM analysis_campaign_segment GROUP BY 1
"""
BODIES["funnel_totals"] = """
SELECT sum(campaign_recipients) AS a, sum(campaign_redeemers) AS u,
       sum(post_28d_observable_rows) AS s FROM mart_campaign_summary
"""
BODIES["snapshot_campaign_funnel"] = union(
    f"SELECT '{n}' AS stage, {c} AS value, {div(c, 'a')} AS rate FROM funnel_totals"
    for n, c in (
        ("Recipient households", "a"),
        ("Redeemer households", "u"),
        ("Post-28d observable rows", "s"),
    )
)
BODIES["top_buyers"] = """
SELECT DISTINCT household_key, commodity FROM tl WHERE household_key IS NOT NULL AND commodity IN (
    SELECT commodity FROM tl WHERE commodity IS NOT NULL GROUP BY 1
    ORDER BY sum(sales_value) DESC, commodity LIMIT 6)
"""
BODIES["snapshot_pair_affinity"] = f"""
SELECT s.commodity AS "left", t.commodity AS "right",
       CASE WHEN s.commodity <> t.commodity THEN
            {div("(SELECT count(*) FROM top_buyers a JOIN top_buyers b USING (household_key) "
                 "WHERE a.commodity = s.commodity AND b.commodity = t.commodity)", "s.n")} END AS attach_rate
FROM (SELECT commodity, count(*) AS n FROM top_buyers GROUP BY 1) s,
     (SELECT DISTINCT commodity FROM top_buyers) t
"""
BODIES["snapshot_week_bands"] = """
SELECT band, 'W' || min(week_number) || '–W' || max(week_number) AS label,
       sum(panel_net_spend) AS panel_net_spend, sum(baskets) AS baskets,
       max(active_households) AS active_households
FROM (SELECT *, (row_number() OVER (ORDER BY week_number) - 1)
                // greatest(1, CAST(ceil(count(*) OVER () / 12) AS BIGINT)) AS band
      FROM mart_panel_weekly)
GROUP BY band
"""
BODIES["snapshot_department_promo"] = f"""
SELECT COALESCE(department, 'Unknown') AS department, sum(product_store_weeks) AS total,
       COALESCE(sum(product_store_weeks) FILTER (promo_state_group <> 'none'), 0) AS promoted,
       {div("COALESCE(sum(product_store_weeks) FILTER (promo_state_group <> 'none'), 0)",
            "sum(product_store_weeks)")} AS observed_coverage
FROM mart_promotion_category_week GROUP BY 1
"""

# ----------------------------------------------------------------- sources
_SRC = {
    "transaction_data": "src_transaction",
    "causal_data": "src_causal",
    "coupon": "src_coupon",
    "coupon_redempt": "src_redemption",
    "campaign_table": "src_exposure",
    "campaign_desc": "src_campaign",
    "product": "src_product",
    "hh_demographic": "src_demographic",
}


def _quoted(c):
    return f'"{c}"'


for _name, _missing in (("read_source", "COALESCE(CAST({0} AS VARCHAR), '') = ''"), ("read_parquet", "{0} IS NULL")):
    BODIES[_name] = union(
        f"SELECT '{s}' AS source_name, count(*) AS row_count, {len(CONTRACTS[s].columns)} AS column_count, "
        + " + ".join(f"count(*) FILTER ({_missing.format(_quoted(c))})" for c in CONTRACTS[s].columns)
        + f" AS null_cells FROM {t}"
        for s, t in _SRC.items()
    )
BODIES["curate_parquet"] = union(
    f"SELECT '{s}' AS source_name, '{s}.csv' AS source_file, 'manual' AS pipeline_run_id, "
    f"'v1' AS schema_version, count(*) AS rows_read, count(*) AS rows_written FROM {t}"
    for s, t in _SRC.items()
)
BODIES["write_table"] = """
SELECT * REPLACE (NULLIF(department, '') AS department) FROM mart_category_weekly
"""
BODIES["schema_contract_check"] = union(
    f"SELECT '{s}' AS source_name, '{s}.csv' AS file_name, 'ok' AS status, '' AS missing_columns, "
    f"'' AS unexpected_columns, '' AS duplicate_columns, {len(CONTRACTS[s].columns)} "
    "AS observed_column_count"
    for s in _SRC
)
BODIES["source_inventory"] = union(
    f"SELECT '{s}' AS source_name, '{s}.csv' AS file_name, count(*) AS row_count, "
    f"{CONTRACTS[s].expected_rows} AS expected_row_count, "
    f"count(*) - {CONTRACTS[s].expected_rows} AS row_count_delta, "
    f"CASE WHEN count(*) = {CONTRACTS[s].expected_rows} THEN 'match' ELSE 'review' END "
    f"AS planning_expectation_status, {len(CONTRACTS[s].columns)} AS column_count, "
    f"sha256('{'|'.join(CONTRACTS[s].columns)}') AS column_names_hash, 'ok' AS load_status FROM {t}"
    for s, t in _SRC.items()
)
BODIES["source_profile_summary"] = union(
    f"SELECT '{s}' AS source_name, '{s}.csv' AS source_filename, count(*) AS row_count, "
    f"{len(CONTRACTS[s].columns)} AS column_count FROM {t}"
    for s, t in _SRC.items()
)
_BIG_KEYS = {("transaction_data", "BASKET_ID")}


def _kind(source, column):
    return "bigint" if (source, column) in _BIG_KEYS else CONTRACTS[source].columns[column].simpleString()


BODIES["profile_rows"] = union(
    f"SELECT '{s}' AS source_name, '{c}' AS column_name, '{_kind(s, c)}' AS column_type, "
    f"count(*) AS row_count, count(*) FILTER ({_quoted(c)} IS NULL OR "
    f"trim(CAST({_quoted(c)} AS VARCHAR)) = '') AS null_or_blank_count, "
    f"count(DISTINCT {_quoted(c)}) AS distinct_count, min(CAST({_quoted(c)} AS VARCHAR)) AS min_value, "
    f"max(CAST({_quoted(c)} AS VARCHAR)) AS max_value FROM {t}"
    for s, t in _SRC.items()
    for c in CONTRACTS[s].columns
)
BODIES["source_null_profile"] = f"""
SELECT source_name, column_name, column_type, row_count, null_or_blank_count,
       {div("null_or_blank_count", "row_count")} AS null_or_blank_pct, distinct_count, min_value,
       max_value
FROM profile_rows
"""
BODIES["source_cardinality"] = f"""
SELECT source_name, source_name || '.csv' AS source_filename, column_name, row_count,
       distinct_count, {div("distinct_count", "row_count")} AS cardinality_ratio
FROM profile_rows
"""
