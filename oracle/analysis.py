"""Analyses and data-driven findings."""

from oracle.layers import div, segments, unknown, window_averages
from panelspark import fixed_text as text

BODIES = {}


def q(s):
    return "'" + s.replace("'", "''") + "'"


def within_tolerance(c):
    return f"abs({c}) <= CAST(0.01 AS DOUBLE)"


def wilson(k, n, sign):
    p = f"({div(k, n)})"
    zz = "(CAST(1.96 AS DOUBLE) * CAST(1.96 AS DOUBLE))"
    return (
        f"CASE WHEN {n} > 0 THEN ({p} + {zz} / ({n} * 2.0::DOUBLE) {sign} CAST(1.96 AS DOUBLE) * "
        f"sqrt(({p} * (1 - {p}) + {zz} / ({n} * 4.0::DOUBLE)) / {n})) / (1 + {zz} / {n}) END"
    )


# -------------------------------------------------------- spend movement
BODIES["window_rows"] = """
SELECT *, CASE WHEN week_number <= first_end THEN 'e' WHEN week_number >= last_start THEN 'l' END AS side
FROM fct_basket, week_cuts
"""
BODIES["weekly_sides"] = """
SELECT max(s) FILTER (side = 'e') AS es, max(s) FILTER (side = 'l') AS ls,
       max(h) FILTER (side = 'e') AS eh, max(h) FILTER (side = 'l') AS lh,
       max(b) FILTER (side = 'e') AS eb, max(b) FILTER (side = 'l') AS lb
FROM (SELECT CASE WHEN week_number <= first_end THEN 'e' ELSE 'l' END AS side,
             CAST(sum(panel_net_spend) AS DOUBLE) AS s, CAST(sum(active_households) AS DOUBLE) AS h,
             CAST(sum(baskets) AS DOUBLE) AS b
      FROM mart_panel_weekly, week_cuts
      WHERE week_number <= first_end OR week_number >= last_start GROUP BY 1)
"""
BODIES["distinct_sides"] = """
SELECT max(s) FILTER (side = 'e') AS es, max(s) FILTER (side = 'l') AS ls,
       max(h) FILTER (side = 'e') AS eh, max(h) FILTER (side = 'l') AS lh,
       max(b) FILTER (side = 'e') AS eb, max(b) FILTER (side = 'l') AS lb
FROM (SELECT side, CAST(sum(basket_net_spend) AS DOUBLE) AS s,
             CAST(count(DISTINCT household_key) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS b
      FROM window_rows WHERE side IS NOT NULL GROUP BY side)
"""


def split(sides):
    return f"""
SELECT name AS driver, ev AS early_value, lv AS late_value,
       CASE WHEN es > 0 AND ls > 0 THEN
            CASE WHEN es = ls THEN ls ELSE (ls - es) / ln(ls / es) END END
       * CASE WHEN lv / ev > 0 THEN ln(lv / ev) END AS contribution,
       ls - es AS change, pos
FROM {sides},
     LATERAL (SELECT 1 AS pos, 'active_households' AS name, eh AS ev, lh AS lv
              UNION ALL SELECT 2, 'trips_per_active_household', eb / eh, lb / lh
              UNION ALL SELECT 3, 'spend_per_basket', es / eb, ls / lb)
"""


BODIES["split_weekly"] = split("weekly_sides")
BODIES["split_distinct"] = split("distinct_sides")
BODIES["split_sum"] = """
SELECT any_value(contribution) FILTER (pos = 1) + any_value(contribution) FILTER (pos = 2)
       + any_value(contribution) FILTER (pos = 3) AS total FROM split_weekly
"""
BODIES["analysis_root_cause_lmdi"] = f"""
SELECT 'D01' AS decision_id, 'Panel Spend Movement' AS case_name, driver, early_value, late_value,
       late_value / NULLIF(early_value, 0) - 1 AS relative_change, contribution,
       change AS total_spend_change, total AS summed_driver_contribution,
       total - change AS reconciliation_delta,
       CASE WHEN {within_tolerance("total - change")} THEN 'PASS' ELSE 'REVIEW' END AS reconciliation_status,
       {q(text.ROOT_CAUSE)} AS limitation
FROM split_weekly, split_sum
"""
BODIES["root_cause_periods"] = """
SELECT CASE side WHEN 'e' THEN 'First 13 weeks' ELSE 'Last 13 weeks' END AS period,
       sum(basket_net_spend) AS panel_net_spend, count(DISTINCT household_key) AS active_households,
       count(*) AS baskets, count(*) / count(DISTINCT household_key) AS trips_per_household,
       CAST(sum(basket_net_spend) AS DOUBLE) / count(*) AS spend_per_basket
FROM window_rows WHERE side IS NOT NULL GROUP BY side
"""
BODIES["root_cause_drivers"] = """
SELECT driver, early_value, late_value, late_value / NULLIF(early_value, 0) - 1 AS relative_change,
       contribution AS spend_change_contribution,
       contribution / (SELECT any_value(contribution) FILTER (pos = 1)
                            + any_value(contribution) FILTER (pos = 2)
                            + any_value(contribution) FILTER (pos = 3) FROM split_distinct)
           AS contribution_share
FROM split_distinct
"""

# ------------------------------------------------------------- campaigns
BODIES["analysis_campaign_denominators"] = f"""
SELECT campaign_id, campaign_type, n AS campaign_household_exposures,
       h AS unique_exposed_households, k AS redeeming_exposures, u AS unique_redeeming_households,
       {div("k", "n")} AS exposure_redemption_rate,
       {div("u", "h")} AS unique_household_redemption_rate,
       {wilson("k", "n", "-")} AS exposure_rate_ci_low,
       {wilson("k", "n", "+")} AS exposure_rate_ci_high,
       {wilson("u", "h", "-")} AS unique_rate_ci_low, {wilson("u", "h", "+")} AS unique_rate_ci_high,
       {q(text.DENOMINATORS)} AS interpretation_boundary
FROM (SELECT campaign_id, campaign_type, count(*) AS n, count(DISTINCT household_key) AS h,
             count(*) FILTER (redeemed_coupon_flag) AS k,
             count(DISTINCT CASE WHEN redeemed_coupon_flag THEN household_key END) AS u
      FROM mart_campaign_household GROUP BY ALL)
"""
BODIES["state_totals"] = """
SELECT count(*) AS total_rows, count(*) FILTER (promo_state_group = 'none') AS none_rows,
       count(*) FILTER (promo_state_group = 'display_only') AS display_only_rows,
       count(*) FILTER (promo_state_group = 'mailer_only') AS mailer_only_rows,
       count(*) FILTER (promo_state_group = 'display_and_mailer') AS display_and_mailer_rows,
       count(DISTINCT product_id) AS products, count(DISTINCT store_id) AS stores,
       count(DISTINCT week_number) AS weeks
FROM fct_promotion_product_store_week
"""
BODIES["analysis_promotion_universe_audit"] = f"""
SELECT *, CASE WHEN none_rows > 0 THEN 'RECOVERED' ELSE 'NOT_OBSERVED' END AS none_state_status,
       CASE WHEN none_rows > 0 THEN {q(text.NONE_OBSERVED)} ELSE {q(text.NONE_MISSING)} END
           AS interpretation_boundary
FROM state_totals
"""
BODIES["analysis_basket_category"] = f"""
SELECT commodity, sum(panel_net_spend) AS panel_net_spend,
       sum(buying_households) AS buying_household_week_records,
       sum(category_baskets) AS category_baskets,
       avg(private_label_share) AS avg_private_label_share, avg(discount_rate) AS avg_discount_rate
FROM mart_category_weekly GROUP BY commodity
"""
BODIES["analysis_campaign_funnel"] = """
SELECT campaign_id, campaign_type, campaign_recipients, campaign_redeemers,
       campaign_redemption_rate, avg_pre_28d_spend, avg_during_spend, avg_post_28d_spend,
       post_28d_observable_rows, avg_during_spend - avg_pre_28d_spend AS avg_spend_change_during,
       avg_post_28d_spend - avg_pre_28d_spend AS avg_spend_change_post
FROM mart_campaign_summary
"""
BODIES["analysis_campaign_segment"] = f"""
SELECT campaign_id, COALESCE(campaign_type, 'Unknown') AS campaign_type,
       COALESCE(segment, 'Unknown') AS customer_segment,
       count(DISTINCT household_key) AS recipient_households,
       count(DISTINCT household_key) FILTER (redeemed_coupon_flag) AS redeemer_households,
       {div("redeemer_households", "recipient_households")} AS redemption_rate,
       {window_averages()},
       count(*) FILTER (post_14d_observable) AS post_14d_observable_rows,
       count(DISTINCT household_key) FILTER (has_demographics) AS demographic_households,
       {q(text.CAMPAIGN_SEGMENT)} AS interpretation_boundary
FROM mart_campaign_household GROUP BY 1, 2, 3
"""
BODIES["campaign_kpi_scope"] = f"""
SELECT count(*) AS campaign_household_exposures,
       count(*) FILTER (redeemed_coupon_flag) AS redeeming_exposures,
       count(DISTINCT household_key) AS unique_exposed_households,
       count(DISTINCT household_key) FILTER (redeemed_coupon_flag) AS unique_redeeming_households,
       {div("redeeming_exposures", "campaign_household_exposures")} AS exposure_redemption_rate,
       {div("unique_redeeming_households", "unique_exposed_households")}
           AS unique_household_redemption_rate
FROM mart_campaign_household
"""

# ------------------------------------------------------------- categories
BODIES["analysis_category_penetration"] = f"""
SELECT department, commodity, count(DISTINCT household_key) AS buying_households,
       sum(panel_net_spend) AS panel_net_spend, sum(category_baskets) AS category_baskets,
       sum(active_weeks) AS household_category_active_weeks,
       {div("sum(panel_net_spend)", "sum(category_baskets)")} AS spend_per_category_basket,
       {div("sum(panel_net_spend)", "buying_households")} AS spend_per_buying_household,
       {div("sum(category_baskets)", "buying_households")} AS purchase_frequency_per_buying_household,
       {div("sum(discount_value)", "sum(panel_net_spend + discount_value)")} AS discount_rate,
       {div("sum(coupon_baskets)", "sum(category_baskets)")} AS coupon_basket_rate,
       {div("sum(private_label_spend)", "sum(panel_net_spend)")} AS private_label_share,
       (SELECT count(*) FROM dim_household) AS panel_households,
       {div("count(DISTINCT household_key)", "(SELECT count(*) FROM dim_household)")}
           AS household_penetration
FROM mart_category_household GROUP BY department, commodity
"""
BODIES["category_sides"] = """
SELECT department, commodity, CASE WHEN week_number <= first_end THEN 'e' ELSE 'l' END AS side,
       sum(sales_value) AS s, count(DISTINCT household_key) AS h, count(DISTINCT basket_id) AS b
FROM tl, week_cuts WHERE week_number <= first_end OR week_number >= last_start GROUP BY ALL
"""
BODIES["analysis_category_decomposition"] = f"""
SELECT COALESCE(e.department, l.department) AS department,
       COALESCE(e.commodity, l.commodity) AS commodity, e.s AS early_spend, l.s AS late_spend,
       l.s - e.s AS spend_change, e.h AS early_buying_households, l.h AS late_buying_households,
       l.h - e.h AS buying_household_change, e.b AS early_category_baskets,
       l.b AS late_category_baskets, l.b - e.b AS basket_change,
       {div("e.b", "e.h")} AS early_baskets_per_buying_household,
       {div("l.b", "l.h")} AS late_baskets_per_buying_household,
       {div("e.s", "e.b")} AS early_spend_per_category_basket,
       {div("l.s", "l.b")} AS late_spend_per_category_basket,
       CASE WHEN e.s = 0 AND l.s > 0 THEN 'Emerging'
            WHEN l.s::DOUBLE >= e.s::DOUBLE * CAST(1.1 AS DOUBLE) THEN 'Growing'
            WHEN l.s::DOUBLE <= e.s::DOUBLE * CAST(0.9 AS DOUBLE) THEN 'Declining'
            WHEN l.s IS NULL OR e.s IS NULL THEN 'Insufficient History'
            ELSE 'Stable' END AS category_trajectory
FROM (SELECT * FROM category_sides WHERE side = 'e') e
FULL JOIN (SELECT * FROM category_sides WHERE side = 'l') l
     ON l.department IS NOT DISTINCT FROM e.department
    AND l.commodity IS NOT DISTINCT FROM e.commodity
"""
BODIES["losses"] = f"""
SELECT *, late_spend - early_spend AS spend_change,
       late_buying_households - early_buying_households AS buying_household_change,
       late_category_baskets - early_category_baskets AS basket_change,
       {div("early_buying_households", "ea")} AS early_penetration,
       {div("late_buying_households", "la")} AS late_penetration,
       {div("early_category_baskets", "early_buying_households")} AS early_baskets_per_buying_household,
       {div("late_category_baskets", "late_buying_households")} AS late_baskets_per_buying_household,
       {div("early_spend", "early_category_baskets")} AS early_spend_per_category_basket,
       {div("late_spend", "late_category_baskets")} AS late_spend_per_category_basket,
       greatest(0, CAST(early_spend - late_spend AS DOUBLE)) AS spend_loss,
       greatest(0, CAST(early_buying_households - late_buying_households AS DOUBLE))
           AS buying_household_loss,
       greatest(0, early_penetration - late_penetration) AS penetration_loss,
       greatest(0, early_baskets_per_buying_household - late_baskets_per_buying_household)
           AS frequency_loss,
       greatest(0, early_spend_per_category_basket - late_spend_per_category_basket)
           AS basket_value_loss
FROM (SELECT category_key, department, commodity,
             COALESCE(sum(panel_net_spend) FILTER (week_number <= first_end), 0) AS early_spend,
             COALESCE(sum(panel_net_spend) FILTER (week_number >= last_start), 0) AS late_spend,
             count(DISTINCT household_key) FILTER (week_number <= first_end)
                 AS early_buying_households,
             count(DISTINCT household_key) FILTER (week_number >= last_start)
                 AS late_buying_households,
             COALESCE(sum(category_baskets) FILTER (week_number <= first_end), 0)
                 AS early_category_baskets,
             COALESCE(sum(category_baskets) FILTER (week_number >= last_start), 0)
                 AS late_category_baskets
      FROM mart_category_household_weekly, week_cuts
      WHERE week_number <= first_end OR week_number >= last_start
      GROUP BY category_key, department, commodity),
     (SELECT count(DISTINCT household_key) FILTER (week_number <= first_end) AS ea,
             count(DISTINCT household_key) FILTER (week_number >= last_start) AS la
      FROM stg_transaction, week_cuts)
"""
_LOSS = {
    "spend_loss": ("0.5", 6),
    "buying_household_loss": ("0.2", 0),
    "penetration_loss": ("0.15", 12),
    "frequency_loss": ("0.1", 12),
    "basket_value_loss": ("0.05", 6),
}


def _share(c, places):
    total = f"CAST(sum(CAST({c} AS DECIMAL(38,{places}))) OVER () AS DOUBLE)"
    return f"{c} / NULLIF({total}, 0) AS {c}_share"


BODIES["loss_shares"] = (
    "SELECT * EXCLUDE (ea, la), "
    + ", ".join(_share(c, p) for c, (_, p) in _LOSS.items())
    + " FROM losses"
)
BODIES["loss_scores"] = (
    "SELECT *, "
    + " + ".join(f"CAST({x} AS DOUBLE) * COALESCE({c}_share, 0)" for c, (x, _) in _LOSS.items())
    + " AS commercial_materiality_score FROM loss_shares"
)
BODIES["analysis_category_materiality"] = f"""
SELECT *, rank() OVER (ORDER BY commercial_materiality_score DESC, abs(spend_change) DESC)
              AS commercial_materiality_rank,
       {q(text.MATERIALITY)} AS interpretation_boundary
FROM loss_scores
"""
_PARTS = ("buying_households", "frequency", "basket_value")
BODIES["lmdi_input"] = """
SELECT category_key, department, commodity, early_spend::DOUBLE AS es, late_spend::DOUBLE AS ls,
       spend_change::DOUBLE AS chg, early_buying_households AS eh, late_buying_households AS lh,
       early_baskets_per_buying_household AS ef, late_baskets_per_buying_household AS lf,
       early_spend_per_category_basket AS ev, late_spend_per_category_basket AS lv,
       es > 0 AND ls > 0 AND eh > 0 AND lh > 0 AND ef > 0 AND lf > 0 AND ev > 0 AND lv > 0 AS ok,
       CASE WHEN ok THEN CASE WHEN es = ls THEN es ELSE (ls - es) / NULLIF(ln(ls) - ln(es), 0) END
            END AS wgt
FROM losses
"""
BODIES["lmdi_parts"] = """
SELECT *, CASE WHEN ok THEN wgt * ln(lh / eh) END AS a, CASE WHEN ok THEN wgt * ln(lf / ef) END AS b,
       CASE WHEN ok THEN wgt * ln(lv / ev) END AS c
FROM lmdi_input WHERE ok IS NOT NULL
"""
BODIES["analysis_category_lmdi"] = f"""
SELECT category_key, department, commodity, es AS early_spend, ls AS late_spend,
       chg AS spend_change, a AS buying_households_contribution, b AS frequency_contribution,
       c AS basket_value_contribution, a + b + c AS contribution_sum,
       chg - (a + b + c) AS reconciliation_delta,
       CASE WHEN NOT ok THEN 'NOT_APPLICABLE' WHEN abs(chg - (a + b + c)) < 0.01 THEN 'PASS'
            ELSE 'REVIEW' END AS reconciliation_status,
       CASE WHEN ok THEN {q(text.CATEGORY_LMDI)} ELSE {q(text.CATEGORY_LMDI_WITHHELD)} END
           AS interpretation_boundary
FROM lmdi_parts
"""
BODIES["analysis_private_label"] = f"""
SELECT department, commodity,
       COALESCE(sum(panel_net_spend) FILTER (brand_type = 'PRIVATE'), 0) AS private_label_spend,
       sum(panel_net_spend) AS category_spend,
       {div("private_label_spend", "category_spend")} AS private_label_share,
       COALESCE(sum(buying_households) FILTER (brand_type = 'PRIVATE'), 0)
           AS private_label_buying_households
FROM mart_brand_category GROUP BY department, commodity
"""
BODIES["analysis_private_label_anomalies"] = f"""
SELECT department, commodity, private_label_spend, category_spend, private_label_share,
       CASE WHEN private_label_share < 0 THEN 'share_below_zero'
            WHEN private_label_share > 1 THEN 'share_above_one' ELSE 'non_positive_denominator' END
           AS anomaly_type, {q(text.PRIVATE_LABEL_ANOMALY)} AS limitation
FROM analysis_private_label
WHERE private_label_share NOT BETWEEN 0 AND 1 OR category_spend <= 0
"""
BODIES["private_label_category_audit"] = f"""
SELECT category_key, sum(own) AS private_label_spend, sum(sales_value) AS category_spend,
       {div("sum(own)", "sum(sales_value)")} AS private_label_share,
       CASE WHEN {div("sum(own)", "sum(sales_value)")} BETWEEN 0 AND 1 THEN 'PASS' ELSE 'REVIEW' END
           AS audit_status
FROM tl GROUP BY category_key
"""

# ---------------------------------------------------------------- coupons
BODIES["analysis_coupon_campaign"] = f"""
SELECT campaign_id, campaign_type, n AS recipient_households,
       COALESCE(ev, 0) AS redemption_events, COALESCE(rh, 0) AS redeemer_households,
       {div("COALESCE(rh, 0)", "n")} AS redemption_rate, COALESCE(lc, 0) AS linked_coupons,
       COALESCE(lp, 0) AS linked_products, {q(text.COUPON_CAMPAIGN)} AS interpretation_boundary
FROM (SELECT campaign_id, max(campaign_type) AS campaign_type, count(DISTINCT household_key) AS n
      FROM fct_campaign_exposure GROUP BY 1)
LEFT JOIN (SELECT campaign_id, count(*) AS ev, count(DISTINCT household_key) AS rh
           FROM stg_coupon_redemption GROUP BY 1) USING (campaign_id)
LEFT JOIN (SELECT campaign_id, count(DISTINCT coupon_upc) AS lc, count(DISTINCT product_id) AS lp
           FROM stg_coupon_product GROUP BY 1) USING (campaign_id)
"""
BODIES["analysis_coupon_segment"] = f"""
SELECT campaign_id, campaign_type, seg AS customer_segment, n AS recipient_households,
       COALESCE(rh, 0) AS redeemer_households, COALESCE(ev, 0) AS redemption_events,
       {div("COALESCE(rh, 0)", "n")} AS redemption_rate,
       {q(text.COUPON_SEGMENT)} AS interpretation_boundary
FROM (SELECT campaign_id, COALESCE(segment, 'Unknown') AS seg, max(campaign_type) AS campaign_type,
             count(DISTINCT household_key) AS n
      FROM fct_campaign_exposure LEFT JOIN mart_customer_segment USING (household_key) GROUP BY 1, 2)
LEFT JOIN (SELECT campaign_id, COALESCE(segment, 'Unknown') AS seg, count(*) AS ev,
                  count(DISTINCT household_key) AS rh
           FROM stg_coupon_redemption LEFT JOIN mart_customer_segment USING (household_key)
           GROUP BY 1, 2) USING (campaign_id, seg)
"""
BODIES["numbered_redemptions"] = "SELECT *, row_number() OVER () AS ev FROM stg_coupon_redemption"
BODIES["analysis_coupon_category"] = f"""
SELECT b.campaign_id, {unknown("p.department")} AS department, {unknown("p.commodity")} AS commodity,
       count(DISTINCT b.coupon_upc) AS linked_coupons, count(DISTINCT b.product_id) AS linked_products,
       count(DISTINCT ev) AS mapped_redemption_events,
       count(DISTINCT r.household_key) AS mapped_redeemer_households,
       {q(text.COUPON_CATEGORY)} AS interpretation_boundary
FROM stg_coupon_product b LEFT JOIN dim_product p ON p.product_id = b.product_id
LEFT JOIN numbered_redemptions r ON r.coupon_upc = b.coupon_upc AND r.campaign_id = b.campaign_id
GROUP BY 1, 2, 3
"""
BODIES["analysis_coupon_basket"] = f"""
SELECT COALESCE(segment, 'Unknown') AS customer_segment,
       CASE WHEN has_coupon_discount THEN 'Coupon-discounted' ELSE 'No-coupon-discount' END
           AS basket_type,
       count(*) AS basket_count, count(DISTINCT household_key) AS households,
       {div("sum(basket_net_spend)", "count(basket_net_spend)")} AS avg_basket_net_spend,
       median(CAST(basket_net_spend AS DOUBLE)) AS median_basket_net_spend,
       {div("sum(basket_distinct_products)", "count(*)")} AS avg_distinct_products,
       {div("sum(basket_line_count)", "count(*)")} AS avg_line_count,
       {div("sum(basket_coupon_discount)", "count(basket_coupon_discount)")} AS avg_coupon_discount,
       {q(text.COUPON_BASKET)} AS interpretation_boundary
FROM mart_basket GROUP BY 1, 2
"""
BODIES["analysis_coupon_repeat_category"] = f"""
SELECT comm AS commodity, count(*) AS first_observed_coupon_households,
       count(*) FILTER (later) AS later_observed_repeat_households,
       {div("count(*) FILTER (later)", "count(*)")} AS observed_repeat_rate,
       {q(text.COUPON_REPEAT)} AS interpretation_boundary
FROM (SELECT f.household_key, f.comm, EXISTS (
             SELECT 1 FROM tl x WHERE x.household_key = f.household_key AND x.day_key > f.d
             AND {unknown("x.commodity")} = f.comm) AS later
      FROM (SELECT household_key, {unknown("commodity")} AS comm, min(day_key) AS d
            FROM tl WHERE cpn > 0 GROUP BY 1, 2) f)
GROUP BY 1
"""

# --------------------------------------------------------------- households
BODIES["analysis_customer_engagement"] = """
SELECT household_key, segment, trajectory, observed_lifetime_spend, frequency_baskets,
       avg_basket_value, early_avg_weekly_spend, late_avg_weekly_spend, absolute_change,
       discount_share, coupon_basket_rate, private_label_share
FROM mart_customer_segment WHERE trajectory <> 'Insufficient History'
"""
BODIES["analysis_panel_driver_tree"] = f"""
SELECT week_number, panel_net_spend, active_households, trips_per_household, spend_per_basket,
       {div("sum(panel_net_spend) OVER near", "count(panel_net_spend) OVER near")}
           AS rolling_4w_panel_spend,
       sum(panel_net_spend) OVER sofar AS cumulative_panel_spend,
       lag(panel_net_spend) OVER ord AS prior_panel_net_spend,
       lag(active_households) OVER ord AS prior_active_households,
       lag(trips_per_household) OVER ord AS prior_trips_per_household,
       lag(spend_per_basket) OVER ord AS prior_spend_per_basket,
       active_households * trips_per_household * spend_per_basket AS reconstructed_panel_net_spend,
       CAST(panel_net_spend AS DOUBLE) - reconstructed_panel_net_spend AS driver_identity_delta,
       {div("panel_net_spend", "prior_panel_net_spend")} - 1 AS panel_spend_change_pct,
       {div("active_households", "prior_active_households")} - 1 AS active_household_change_pct,
       {div("trips_per_household", "prior_trips_per_household")} - 1 AS trip_frequency_change_pct,
       {div("spend_per_basket", "prior_spend_per_basket")} - 1 AS basket_value_change_pct
FROM mart_panel_weekly
WINDOW ord AS (ORDER BY week_number), near AS (ORDER BY week_number ROWS 3 PRECEDING),
       sofar AS (ORDER BY week_number ROWS UNBOUNDED PRECEDING)
"""
BODIES["analysis_household_engagement_sequence"] = """
SELECT household_key, week_number, net_spend, baskets, lag(net_spend) OVER hh AS prior_week_spend,
       lead(net_spend) OVER hh AS next_week_spend,
       sum(net_spend) OVER (hh ROWS UNBOUNDED PRECEDING) AS cumulative_household_spend,
       rank() OVER (PARTITION BY week_number ORDER BY net_spend DESC) AS weekly_spend_rank,
       dense_rank() OVER (PARTITION BY week_number ORDER BY baskets DESC) AS weekly_frequency_rank
FROM mart_household_weekly WINDOW hh AS (PARTITION BY household_key ORDER BY week_number)
"""
_ATTRS = (
    "age_desc",
    "marital_status_code",
    "income_desc",
    "homeowner_desc",
    "hh_comp_desc",
    "household_size_desc",
    "kid_category_desc",
)
BODIES["analysis_demographic_summary"] = (
    f"""
SELECT attribute_name, attribute_value, count(DISTINCT household_key) AS households,
       sum(spend) AS observed_lifetime_spend,
       {div("count(DISTINCT household_key)", "(SELECT count(*) FROM dim_household)")}
           AS household_coverage,
       {q(text.DEMOGRAPHICS)} AS interpretation_boundary
FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{a}' AS attribute_name, COALESCE({a}, 'Unknown') AS attribute_value, "
        "h.household_key, s.observed_lifetime_spend AS spend FROM dim_household h "
        "LEFT JOIN mart_household_summary s ON s.household_key = h.household_key"
        for a in _ATTRS
    )
    + ") GROUP BY 1, 2"
)
BODIES["analysis_first_observed_cohort"] = f"""
SELECT fw AS first_observed_week, count(*) AS first_observed_households,
       count(*) FILTER (seen) AS households_with_observable_follow_up,
       count(*) FILTER (seen AND again) AS repeat_households_within_13_weeks,
       {div("count(*) FILTER (seen AND again)", "count(*) FILTER (seen)")}
           AS observed_repeat_rate_within_13_weeks,
       {div("sum(spend)", "count(spend)")} AS avg_observed_lifetime_spend,
       {div("sum(trips)", "count(*)")} AS avg_observed_lifetime_baskets,
       {q(text.COHORT)} AS interpretation_boundary
FROM (SELECT s.first_observed_week AS fw, s.observed_lifetime_spend AS spend,
             s.lifetime_baskets AS trips, s.first_observed_week + 13 <= (SELECT top FROM week_cuts) AS seen,
             EXISTS (SELECT 1 FROM mart_household_weekly h WHERE h.household_key = s.household_key
                     AND h.week_number BETWEEN s.first_observed_week + 1 AND s.first_observed_week + 13)
                 AS again
      FROM mart_household_summary s)
GROUP BY fw
"""
BODIES["trimmed"] = f"""
SELECT household_key, {segments("l <= e * CAST(0.9 AS DOUBLE)", "l >= e * CAST(1.1 AS DOUBLE)")} AS seg2
FROM (SELECT *, ntile(5) OVER (ORDER BY spend NULLS LAST, household_key) AS monetary_quintile,
             ntile(5) OVER (ORDER BY trips NULLS LAST, household_key) AS frequency_quintile
      FROM (SELECT h.household_key, sum(net_spend) AS spend, sum(baskets) AS trips,
                   count(*) AS active_weeks,
                   {div("sum(discount_value)", "sum(net_spend) + sum(discount_value)")} AS discount_share,
                   {div("sum(private_label_spend)", "sum(net_spend)")} AS private_label_share,
                   {div("sum(net_spend) FILTER (week_number <= first_end)",
                        "count(*) FILTER (week_number <= first_end)")} AS e,
                   {div("sum(net_spend) FILTER (week_number > top - 26)",
                        "count(*) FILTER (week_number > top - 26)")} AS l,
                   COALESCE(any_value(rate), 0) AS coupon_basket_rate
            FROM mart_household_weekly h CROSS JOIN week_cuts
            LEFT JOIN (SELECT household_key, {div("count(*) FILTER (has_coupon_discount)", "count(*)")}
                              AS rate
                       FROM fct_basket, week_cuts WHERE week_number <= top - 13 GROUP BY 1) c
                   ON c.household_key = h.household_key
            WHERE week_number <= top - 13 GROUP BY h.household_key))
"""
BODIES["moves"] = f"""
SELECT s.segment, COALESCE(seg2, {q(text.NOT_IN_TRIMMED)}) AS seg2
FROM mart_customer_segment s LEFT JOIN trimmed USING (household_key)
"""
BODIES["analysis_segment_stability"] = f"""
SELECT 'full_vs_excluding_last_13_weeks' AS comparison_name, 'overall' AS row_type,
       CAST(NULL AS VARCHAR) AS full_segment, CAST(NULL AS VARCHAR) AS trimmed_segment,
       count(*) AS household_count, CAST(1 AS DOUBLE) AS pct_of_households,
       {div("count(*) FILTER (segment = seg2)", "count(*)")} AS unchanged_pct,
       {div("count(*) FILTER (segment <> seg2)", "count(*)")} AS moved_pct,
       {q(text.STABILITY)} AS interpretation_boundary
FROM moves
UNION ALL
SELECT 'full_vs_excluding_last_13_weeks', 'transition', segment, seg2, count(*),
       {div("count(*)", "(SELECT count(*) FROM moves)")}, NULL, NULL, {q(text.STABILITY)}
FROM moves GROUP BY segment, seg2
"""

# --------------------------------------------------------------- promotion
BODIES["analysis_promotion_association"] = f"""
SELECT department, commodity, promo_state_group, sum(product_store_weeks) AS product_store_weeks,
       sum(panel_sales) AS panel_sales, sum(panel_units) AS panel_units,
       sum(panel_buying_households) AS panel_buying_households, sum(panel_baskets) AS panel_baskets,
       {div("sum(panel_sales)", "sum(product_store_weeks)")} AS avg_panel_sales_per_product_store_week,
       {div("sum(panel_baskets)", "sum(product_store_weeks)")}
           AS avg_panel_baskets_per_product_store_week
FROM mart_promotion_category_week GROUP BY ALL
"""
BODIES["analysis_promotion_dependency"] = f"""
SELECT department, commodity, sum(panel_sales) AS total_panel_sales,
       COALESCE(sum(panel_sales) FILTER (promo_state_group <> 'none'), 0) AS promoted_panel_sales,
       sum(product_store_weeks) AS total_product_store_weeks,
       COALESCE(sum(product_store_weeks) FILTER (promo_state_group <> 'none'), 0)
           AS promoted_product_store_weeks,
       {div("promoted_panel_sales", "total_panel_sales")}
           AS share_of_observed_sales_during_promoted_states,
       {div("promoted_product_store_weeks", "total_product_store_weeks")}
           AS share_of_product_store_weeks_promoted,
       {q(text.PROMOTION_DEPENDENCY)} AS interpretation_boundary
FROM mart_promotion_category_week GROUP BY department, commodity
"""
