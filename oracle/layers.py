"""Sources, staging, dimensions, facts and marts."""


def div(a, b):
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


def unknown(c):
    return f"COALESCE(NULLIF(TRIM({c}), ''), 'Unknown')"


OFF = "(retail_discount_value + coupon_discount_value + coupon_match_discount_value)"
CPN = "(coupon_discount_value + coupon_match_discount_value)"
MONEY = "DECIMAL(18,4)"
KINDS = "CASE i % 3 WHEN 0 THEN 'TypeA' WHEN 1 THEN 'TypeB' ELSE 'TypeC' END"

BODIES = {}

# ------------------------------------------------------------------ sources
BODIES["src_trip"] = """
SELECT o_orderkey AS bid, CASE WHEN o_orderkey % 997 <> 0 THEN o_custkey END AS hh,
       o_custkey % 25 AS store,
       1 + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 711 AS d
FROM orders
"""
BODIES["src_transaction"] = f"""
SELECT hh AS household_key, bid AS "BASKET_ID", CAST(d AS INTEGER) AS "DAY",
       CASE WHEN (bid + l_linenumber) % 1009 <> 0 THEN l_partkey END AS "PRODUCT_ID",
       CASE WHEN bid % 501 = 0 THEN 0.0 WHEN bid % 211 = 0 THEN l_quantity * 10
            ELSE l_quantity END AS "QUANTITY",
       CASE WHEN bid % 701 = 0 THEN NULL WHEN bid % 401 = 0 THEN CAST(0 AS {MONEY})
            WHEN bid % 601 = 0 THEN CAST(-(price * (CAST(1 AS DECIMAL(4,2)) - off)) AS {MONEY})
            ELSE CAST(price * (CAST(1 AS DECIMAL(4,2)) - off) AS {MONEY}) END AS "SALES_VALUE",
       store AS "STORE_ID",
       CAST(-(price * off) AS {MONEY}) AS "RETAIL_DISC",
       CASE WHEN bid % 4 = 0 AND l_returnflag = 'R' THEN CAST(-(price * tax) AS {MONEY})
            ELSE CAST(0 AS {MONEY}) END AS "COUPON_DISC",
       CAST(0 AS {MONEY}) AS "COUPON_MATCH_DISC",
       CAST((bid % 24) * 100 + bid % 60 AS INTEGER) AS "TRANS_TIME",
       CAST(1 + (d - 1) // 7 AS INTEGER) AS "WEEK_NO"
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
             CAST(l_discount AS DECIMAL(4,2)) AS off, CAST(l_tax AS DECIMAL(4,2)) AS tax
      FROM lineitem JOIN src_trip ON l_orderkey = bid
           JOIN (VALUES (1), (2)) AS t(turn) ON turn = 1 OR (l_orderkey % 307 = 0 AND l_linenumber = 1))
"""
BODIES["src_product"] = """
SELECT p_partkey AS "PRODUCT_ID", no AS "MANUFACTURER",
       CASE WHEN p_partkey % 50 = 0 THEN '' WHEN p_partkey % 51 <> 0 THEN p_type END AS "DEPARTMENT",
       CASE WHEN no % 2 = 0 THEN 'Private' ELSE 'National' END AS "BRAND",
       split_part(p_name, ' ', 2) AS "COMMODITY_DESC", p_name AS "SUB_COMMODITY_DESC",
       CAST(p_size AS VARCHAR) AS "CURR_SIZE_OF_PRODUCT"
FROM (SELECT *, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS no FROM part)
"""
BODIES["src_demographic"] = """
SELECT CASE WHEN c_acctbal < 2000 THEN '19-24' WHEN c_acctbal < 4000 THEN '25-34'
            WHEN c_acctbal < 6000 THEN '35-44' ELSE '45-54' END AS classification_1,
       CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN ' ' ELSE 'U' END
           AS classification_2,
       c_mktsegment AS classification_3,
       CASE WHEN c_nationkey % 2 = 0 THEN 'Homeowner' ELSE 'Renter' END AS "HOMEOWNER_DESC",
       'Group ' || (c_nationkey % 5) AS classification_5,
       CAST(c_custkey % 5 + 1 AS VARCHAR) AS classification_4,
       CASE WHEN c_custkey % 7 <> 0 THEN 'Kids ' || (c_nationkey % 3) END AS "KID_CATEGORY_DESC",
       c_custkey AS household_key
FROM customer WHERE c_custkey % 3 = 0
"""
BODIES["src_causal"] = """
SELECT p AS "PRODUCT_ID", s AS "STORE_ID", w AS "WEEK_NO",
       CASE (p + w) % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '5' ELSE 'A' END AS display,
       CASE WHEN (p + s) % 41 = 0 THEN 'Q' WHEN (p + s) % 3 = 0 THEN '0' WHEN (p + s) % 3 = 1 THEN 'A'
            ELSE 'D' END AS mailer
FROM causal_keys
UNION ALL
SELECT p, s, w, '2', '0' FROM causal_keys WHERE (p + s + w) % 7 = 0
"""
BODIES["causal_keys"] = """
SELECT "PRODUCT_ID" AS p, "STORE_ID" AS s, "WEEK_NO" AS w FROM src_transaction
WHERE ("PRODUCT_ID" + "STORE_ID" + "WEEK_NO") % 3 = 0
UNION
SELECT "PRODUCT_ID", "STORE_ID", 1 + "WEEK_NO" % 102 FROM src_transaction
WHERE ("PRODUCT_ID" * 7 + "WEEK_NO") % 5 = 0
"""
BODIES["src_campaign"] = f"""
SELECT {KINDS} AS "DESCRIPTION", CAST(i AS INTEGER) AS "CAMPAIGN",
       CAST(1 + (i * 23) % 700 AS INTEGER) AS "START_DAY",
       CAST(1 + (i * 23) % 700 + 20 + n % 20 AS INTEGER) AS "END_DAY"
FROM (SELECT 1 + o_custkey % 30 AS i, COUNT(*) AS n FROM orders GROUP BY ALL)
"""
BODIES["src_exposure"] = f"""
SELECT c_custkey AS household_key, CAST(i AS INTEGER) AS "CAMPAIGN", {KINDS} AS "DESCRIPTION"
FROM customer, range(1, 31) r(i) WHERE (c_custkey * 7 + i * 13) % 10 < 2
"""
BODIES["src_coupon"] = """
SELECT 10000000 + i * 1000 + p_partkey % 50 AS "COUPON_UPC", p_partkey AS "PRODUCT_ID",
       CAST(i AS INTEGER) AS "CAMPAIGN"
FROM part, range(1, 31) r(i) WHERE (p_partkey + i * 17) % 97 = 0
"""
BODIES["src_redemption"] = """
SELECT e.household_key,
       CAST(d."START_DAY" + e.household_key % (d."END_DAY" - d."START_DAY" + 1) AS INTEGER) AS "DAY",
       CASE WHEN e.household_key % 13 = 0 THEN 99 ELSE
         (SELECT MIN("COUPON_UPC") FROM src_coupon c WHERE c."CAMPAIGN" = e."CAMPAIGN") END AS "COUPON_UPC",
       e."CAMPAIGN"
FROM src_exposure e JOIN src_campaign d ON d."CAMPAIGN" = e."CAMPAIGN"
     JOIN (VALUES (1), (2)) AS t(turn) ON turn = 1 OR e.household_key % 11 = 0
WHERE (e.household_key * 31 + e."CAMPAIGN" * 7) % 8 = 0
  AND e."CAMPAIGN" IN (SELECT "CAMPAIGN" FROM src_coupon)
"""

# ------------------------------------------------------------------ staging
BODIES["stg_transaction"] = """
SELECT household_key, "BASKET_ID" AS basket_id, "DAY" AS day_key, "PRODUCT_ID" AS product_id,
       "QUANTITY" AS quantity_raw, "SALES_VALUE" AS sales_value, "STORE_ID" AS store_id,
       "RETAIL_DISC" AS retail_disc_raw, "COUPON_DISC" AS coupon_disc_raw,
       "COUPON_MATCH_DISC" AS coupon_match_disc_raw,
       abs("RETAIL_DISC") AS retail_discount_value, abs("COUPON_DISC") AS coupon_discount_value,
       abs("COUPON_MATCH_DISC") AS coupon_match_discount_value,
       "TRANS_TIME" AS trans_time, "TRANS_TIME" // 100 AS transaction_hour,
       "WEEK_NO" AS week_number
FROM src_transaction
"""
BODIES["stg_product"] = """
SELECT "PRODUCT_ID" AS product_id, CAST("MANUFACTURER" AS VARCHAR) AS manufacturer_id,
       "DEPARTMENT" AS department,
       CASE WHEN b IN ('PRIVATE', 'NATIONAL') THEN b
            WHEN b IS NULL OR b = '' THEN 'Unknown' ELSE TRIM("BRAND") END AS brand_type,
       "COMMODITY_DESC" AS commodity, "SUB_COMMODITY_DESC" AS sub_commodity,
       "CURR_SIZE_OF_PRODUCT" AS product_size
FROM (SELECT *, upper(trim("BRAND")) AS b FROM src_product)
GROUP BY ALL
"""
BODIES["stg_household_demographic"] = """
SELECT household_key, nullif(trim(classification_1), '') AS age_desc,
       nullif(trim(classification_2), '') AS marital_status_code,
       nullif(trim(classification_3), '') AS income_desc,
       nullif(trim("HOMEOWNER_DESC"), '') AS homeowner_desc,
       nullif(trim(classification_5), '') AS hh_comp_desc,
       nullif(trim(classification_4), '') AS household_size_desc,
       nullif(trim("KID_CATEGORY_DESC"), '') AS kid_category_desc
FROM src_demographic
"""
BODIES["stg_campaign"] = """
SELECT "CAMPAIGN" AS campaign_id, "DESCRIPTION" AS campaign_type, "START_DAY" AS start_day,
       "END_DAY" AS end_day
FROM src_campaign GROUP BY ALL
"""
BODIES["stg_campaign_exposure"] = """
SELECT household_key, "CAMPAIGN" AS campaign_id FROM src_exposure GROUP BY ALL
"""
BODIES["stg_coupon_product"] = """
SELECT "COUPON_UPC" AS coupon_upc, "PRODUCT_ID" AS product_id, "CAMPAIGN" AS campaign_id
FROM src_coupon GROUP BY ALL
"""
BODIES["stg_coupon_redemption"] = """
SELECT household_key, "DAY" AS day_key, "COUPON_UPC" AS coupon_upc, "CAMPAIGN" AS campaign_id
FROM src_redemption
"""
BODIES["stg_promotion_state"] = """
SELECT "PRODUCT_ID" AS product_id, "STORE_ID" AS store_id, "WEEK_NO" AS week_number,
       display AS display_code, mailer AS mailer_code,
       COALESCE(display <> '0', FALSE) AS is_on_display,
       COALESCE(mailer <> '0', FALSE) AS is_in_mailer,
       CASE WHEN display = '0' AND mailer = '0' THEN 'none'
            WHEN mailer = '0' AND display IS NOT NULL THEN 'display_only'
            WHEN display = '0' AND mailer IS NOT NULL THEN 'mailer_only'
            ELSE 'display_and_mailer' END AS promo_state_group
FROM src_causal
"""

# --------------------------------------------------------------- dimensions
BODIES["dim_day"] = """
SELECT i AS day_key, 'Observation Day ' || i AS observation_day,
       CAST(DATE '2019-12-31' + CAST(i AS INTEGER) AS DATE) AS synthetic_date
FROM (SELECT unnest(range(MIN(day_key), MAX(day_key) + 1)) AS i FROM stg_transaction)
"""
BODIES["dim_week"] = """
SELECT i AS week_number, 'Observation Week ' || i AS observation_week,
       CAST(DATE '2020-01-01' + CAST(7 * (i - 1) AS INTEGER) AS DATE) AS synthetic_week_start
FROM (SELECT unnest(range(MIN(week_number), MAX(week_number) + 1)) AS i FROM stg_transaction)
"""
BODIES["dim_household"] = """
SELECT h.household_key, d.* EXCLUDE (household_key), d.household_key IS NOT NULL AS has_demographics
FROM (SELECT household_key FROM stg_transaction WHERE household_key IS NOT NULL GROUP BY ALL) h
LEFT JOIN stg_household_demographic d ON d.household_key = h.household_key
"""
BODIES["dim_product"] = """
SELECT product_id, max(manufacturer_id) AS manufacturer_id, max(department) AS department,
       max(brand_type) AS brand_type, max(commodity) AS commodity,
       max(sub_commodity) AS sub_commodity, max(product_size) AS product_size
FROM stg_product GROUP BY ALL
"""
BODIES["dim_store"] = "SELECT store_id FROM stg_transaction WHERE store_id IS NOT NULL GROUP BY ALL"
BODIES["dim_campaign"] = "SELECT campaign_id, campaign_type, start_day, end_day FROM stg_campaign"
BODIES["dim_coupon"] = """
SELECT coupon_upc FROM stg_coupon_product UNION SELECT coupon_upc FROM stg_coupon_redemption
"""
BODIES["dim_category"] = f"""
SELECT dept || '|' || comm AS category_key, dept AS department, comm AS commodity,
       dept || ' / ' || comm AS category_label, 'category_v1_department_commodity' AS rule_version
FROM (SELECT {unknown("department")} AS dept, {unknown("commodity")} AS comm
      FROM dim_product GROUP BY ALL)
"""

# -------------------------------------------------------------------- facts
BODIES["fct_transaction_line"] = f"""
SELECT s.*, sales_value + {OFF} AS gross_spend_before_recorded_discounts,
       COALESCE(quantity_raw <= 0 OR quantity_raw >
                (SELECT quantile_cont(quantity_raw, 0.99) FROM stg_transaction), FALSE)
           AS quantity_outlier_flag
FROM stg_transaction s
"""
# one wide line table for everything below
BODIES["tl"] = f"""
SELECT f.*, {OFF} AS off, {CPN} AS cpn, p.department, p.commodity, p.brand_type,
       c.category_key, c.department AS dept_name, c.commodity AS comm_name,
       CASE WHEN p.brand_type = 'PRIVATE' THEN sales_value ELSE 0 END AS own
FROM fct_transaction_line f
LEFT JOIN dim_product p ON p.product_id = f.product_id
LEFT JOIN dim_category c
       ON c.category_key = {unknown("p.department")} || '|' || {unknown("p.commodity")}
"""
BODIES["fct_basket"] = """
SELECT basket_id, max(household_key) AS household_key, max(day_key) AS day_key,
       max(week_number) AS week_number, max(store_id) AS store_id,
       sum(sales_value) AS basket_net_spend,
       sum(gross_spend_before_recorded_discounts) AS basket_gross_spend,
       sum(off) AS basket_discount_value, sum(cpn) AS basket_coupon_discount,
       count(*) AS basket_line_count, count(DISTINCT product_id) AS basket_distinct_products,
       sum(quantity_raw) AS basket_quantity_raw,
       count(DISTINCT department) AS basket_distinct_departments,
       count(DISTINCT commodity) AS basket_distinct_commodities,
       bool_or(cpn > 0) AS has_coupon_discount, max(transaction_hour) AS transaction_hour
FROM tl GROUP BY basket_id
"""
BODIES["fct_promotion_product_store_week"] = """
SELECT product_id, store_id, week_number,
       COALESCE(max(display_code) FILTER (is_on_display), '0') AS display_code,
       COALESCE(max(mailer_code) FILTER (is_in_mailer), '0') AS mailer_code,
       bool_or(is_on_display) AS is_on_display, bool_or(is_in_mailer) AS is_in_mailer,
       CASE WHEN bool_or(is_on_display) AND bool_or(is_in_mailer) THEN 'display_and_mailer'
            WHEN bool_or(is_on_display) THEN 'display_only'
            WHEN bool_or(is_in_mailer) THEN 'mailer_only' ELSE 'none' END AS promo_state_group
FROM stg_promotion_state GROUP BY product_id, store_id, week_number
"""
BODIES["fct_campaign_exposure"] = """
SELECT household_key, campaign_id, campaign_type, start_day, end_day,
       start_day >= lo + 28 AS pre_28d_observable,
       start_day >= lo AND end_day <= hi AS during_observable,
       end_day <= hi - 14 AS post_14d_observable, end_day <= hi - 28 AS post_28d_observable
FROM stg_campaign_exposure LEFT JOIN dim_campaign USING (campaign_id),
     (SELECT min(day_key) AS lo, max(day_key) AS hi FROM stg_transaction)
"""
BODIES["bridge_coupon_product_campaign"] = """
SELECT coupon_upc, product_id, campaign_id FROM stg_coupon_product
"""

# -------------------------------------------------------------------- marts
BODIES["mart_panel_weekly"] = f"""
SELECT week_number, net AS panel_net_spend, gross AS panel_gross_spend, n AS baskets,
       hh AS active_households, {div("net", "n")} AS spend_per_basket,
       {div("n", "hh")} AS trips_per_household, {div("net", "hh")} AS spend_per_household,
       off_sum AS discount_value, {div("off_sum", "gross")} AS discount_rate,
       {div("cn", "n")} AS coupon_basket_rate, own_sum AS private_label_spend,
       {div("own_sum", "net")} AS private_label_share
FROM (SELECT week_number, sum(basket_net_spend) AS net, sum(basket_gross_spend) AS gross,
             count(*) AS n, count(DISTINCT household_key) AS hh,
             sum(basket_discount_value) AS off_sum, count(*) FILTER (has_coupon_discount) AS cn
      FROM fct_basket GROUP BY week_number)
LEFT JOIN (SELECT week_number, sum(own) AS own_sum FROM tl GROUP BY week_number) USING (week_number)
"""
BODIES["mart_household_weekly"] = """
SELECT household_key, week_number, sum(sales_value) AS net_spend,
       count(DISTINCT basket_id) AS baskets, count(DISTINCT product_id) AS distinct_products,
       count(DISTINCT department) AS distinct_departments,
       count(DISTINCT commodity) AS distinct_commodities, sum(off) AS discount_value,
       sum(cpn) AS coupon_discount, sum(own) AS private_label_spend
FROM tl GROUP BY household_key, week_number
"""
BODIES["week_cuts"] = """
SELECT min(week_number) + 12 AS first_end, max(week_number) - 12 AS last_start,
       max(week_number) AS top FROM stg_transaction
"""
BODIES["mart_household_summary"] = f"""
SELECT h.household_key, min(week_number) AS first_observed_week,
       max(week_number) AS last_observed_week, count(DISTINCT week_number) AS active_weeks,
       sum(net_spend) AS observed_lifetime_spend, sum(baskets) AS lifetime_baskets,
       avg({div("net_spend", "baskets")}) AS avg_basket_value,
       {div("sum(net_spend)", "count(net_spend)")} AS avg_weekly_spend,
       median(CAST(net_spend AS DOUBLE)) AS median_weekly_spend,
       {div("sum(discount_value)", "sum(net_spend + discount_value)")} AS discount_share,
       COALESCE(any_value(c.rate), 0.0) AS coupon_basket_rate,
       {div("sum(private_label_spend)", "sum(net_spend)")} AS private_label_share,
       max(distinct_departments) AS distinct_departments,
       max(distinct_commodities) AS distinct_commodities, sum(baskets) AS frequency_baskets,
       {div("sum(net_spend) FILTER (week_number <= first_end)",
            "count(net_spend) FILTER (week_number <= first_end)")} AS early_avg_weekly_spend,
       {div("sum(net_spend) FILTER (week_number >= last_start)",
            "count(net_spend) FILTER (week_number >= last_start)")} AS late_avg_weekly_spend,
       late_avg_weekly_spend - early_avg_weekly_spend AS absolute_change,
       CASE WHEN absolute_change IS NULL THEN 'Insufficient History'
            WHEN late_avg_weekly_spend >= early_avg_weekly_spend * CAST(1.1 AS DOUBLE) THEN 'Growing'
            WHEN late_avg_weekly_spend <= early_avg_weekly_spend * CAST(0.9 AS DOUBLE) THEN 'Declining'
            ELSE 'Stable' END AS trajectory,
       any_value(d.has_demographics) AS has_demographics
FROM mart_household_weekly h CROSS JOIN week_cuts
LEFT JOIN (SELECT household_key, {div("count(*) FILTER (has_coupon_discount)", "count(*)")} AS rate
           FROM fct_basket GROUP BY 1) c ON c.household_key = h.household_key
LEFT JOIN dim_household d ON d.household_key = h.household_key
GROUP BY h.household_key
"""


def segments(declining, engaged):
    return f"""
CASE WHEN monetary_quintile >= 4 AND {declining} THEN 'High-Value Declining'
     WHEN monetary_quintile >= 4 AND {engaged} THEN 'High-Value Engaged'
     WHEN frequency_quintile >= 4 AND monetary_quintile < 4 THEN 'Frequent Core'
     WHEN coupon_basket_rate >= CAST(0.3 AS DOUBLE) OR discount_share >= CAST(0.2 AS DOUBLE)
          THEN 'Promotion-Responsive'
     WHEN private_label_share >= CAST(0.6 AS DOUBLE) THEN 'Private-Label Loyal'
     WHEN frequency_quintile <= 2 AND active_weeks <= 8 THEN 'Occasional'
     ELSE 'Low-Engagement' END"""


BODIES["mart_customer_segment"] = f"""
SELECT *, {segments("trajectory = 'Declining'", "trajectory IN ('Stable', 'Growing')")} AS segment
FROM (SELECT *, observed_lifetime_spend AS monetary_spend,
             ntile(5) OVER (ORDER BY observed_lifetime_spend NULLS LAST, household_key)
                 AS monetary_quintile,
             ntile(5) OVER (ORDER BY frequency_baskets NULLS LAST, household_key)
                 AS frequency_quintile
      FROM mart_household_summary)
"""
BODIES["mart_basket"] = """
SELECT b.*, s.segment FROM fct_basket b
LEFT JOIN mart_customer_segment s ON s.household_key = b.household_key
"""
BODIES["mart_category_weekly"] = f"""
SELECT week_number, category_key, department, commodity, net AS panel_net_spend,
       hh AS buying_households, active AS active_panel_households,
       {div("hh", "active")} AS category_penetration, n AS category_baskets,
       {div("net", "hh")} AS spend_per_buying_household, {div("o", "g")} AS discount_rate,
       {div("pl", "net")} AS private_label_share
FROM (SELECT week_number, category_key, department, commodity, sum(sales_value) AS net,
             count(DISTINCT household_key) AS hh, count(DISTINCT basket_id) AS n, sum(off) AS o,
             sum(gross_spend_before_recorded_discounts) AS g, sum(own) AS pl
      FROM tl GROUP BY ALL)
LEFT JOIN (SELECT week_number, count(DISTINCT household_key) AS active FROM fct_basket GROUP BY 1)
    USING (week_number)
"""
BODIES["mart_brand_category"] = f"""
SELECT category_key, department, commodity, brand_type, sum(sales_value) AS panel_net_spend,
       count(DISTINCT household_key) AS buying_households, count(DISTINCT basket_id) AS baskets,
       {div("sum(sales_value)", "count(DISTINCT household_key)")} AS spend_per_buying_household,
       {div("sum(off)", "sum(gross_spend_before_recorded_discounts)")} AS discount_rate
FROM tl GROUP BY category_key, department, commodity, brand_type
"""
BODIES["mart_promotion_category_week"] = f"""
SELECT c.category_key, p.commodity, p.department, week_number, promo_state_group,
       count(*) AS product_store_weeks, COALESCE(sum(x.net), 0) AS panel_sales,
       COALESCE(sum(x.units), 0) AS panel_units, COALESCE(sum(x.hh), 0) AS panel_buying_households,
       COALESCE(sum(x.n), 0) AS panel_baskets
FROM fct_promotion_product_store_week f
LEFT JOIN (SELECT product_id, store_id, week_number, sum(sales_value) AS net,
                  sum(quantity_raw) AS units, count(DISTINCT household_key) AS hh,
                  count(DISTINCT basket_id) AS n
           FROM stg_transaction GROUP BY ALL) x USING (product_id, store_id, week_number)
LEFT JOIN dim_product p ON p.product_id = f.product_id
LEFT JOIN dim_category c
       ON c.category_key = {unknown("p.department")} || '|' || {unknown("p.commodity")}
GROUP BY ALL
"""
_PHASES = {
    "pre_28d": "day_key >= start_day - 28 AND day_key < start_day",
    "during": "day_key >= start_day AND day_key <= end_day",
    "post_28d": "day_key > end_day AND day_key <= end_day + 28",
}
BODIES["phase_totals"] = "SELECT e.household_key, e.campaign_id, " + ", ".join(
    f"sum(sales_value) FILTER ({cond}) AS {p}_s, "
    f"count(DISTINCT basket_id) FILTER ({cond}) AS {p}_b"
    for p, cond in _PHASES.items()
) + """
FROM fct_campaign_exposure e JOIN stg_transaction t ON t.household_key = e.household_key
GROUP BY e.household_key, e.campaign_id
"""
BODIES["mart_campaign_household"] = """
SELECT e.*, """ + ", ".join(
    f"CASE WHEN {p}_observable THEN COALESCE({p}_s, 0) END AS {p}_spend, "
    f"CASE WHEN {p}_observable THEN COALESCE({p}_b, 0) END AS {p}_baskets"
    for p in _PHASES
) + """,
       r.n IS NOT NULL AS redeemed_coupon_flag, COALESCE(r.n, 0) AS redemption_count,
       s.segment, h.has_demographics
FROM fct_campaign_exposure e
LEFT JOIN phase_totals USING (household_key, campaign_id)
LEFT JOIN (SELECT household_key, campaign_id, count(*) AS n FROM stg_coupon_redemption GROUP BY ALL) r
    USING (household_key, campaign_id)
LEFT JOIN mart_customer_segment s USING (household_key)
LEFT JOIN dim_household h USING (household_key)
"""


def window_averages():
    out = [
        div(f"sum({p}_spend)", f"count({p}_spend)") + f" AS avg_{p}_spend" for p in _PHASES
    ] + [f"count(*) FILTER ({p}_observable) AS {p}_observable_rows" for p in _PHASES]
    return ", ".join(out)


BODIES["mart_campaign_summary"] = f"""
SELECT campaign_id, max(campaign_type) AS campaign_type,
       count(DISTINCT household_key) AS campaign_recipients,
       count(DISTINCT household_key) FILTER (redeemed_coupon_flag) AS campaign_redeemers,
       {div("campaign_redeemers", "campaign_recipients")} AS campaign_redemption_rate,
       {window_averages()}
FROM mart_campaign_household GROUP BY campaign_id
"""
BODIES["mart_coupon_summary"] = """
SELECT r.campaign_id, count(*) AS redemption_events,
       count(DISTINCT r.household_key) AS redeemer_households,
       count(DISTINCT r.coupon_upc) AS redeemed_coupons,
       count(DISTINCT product_id) AS linked_products
FROM stg_coupon_redemption r
LEFT JOIN bridge_coupon_product_campaign USING (campaign_id, coupon_upc)
GROUP BY r.campaign_id
"""
BODIES["basket_items"] = """
SELECT basket_id, commodity FROM tl WHERE commodity IS NOT NULL GROUP BY ALL
"""
BODIES["mart_cross_category_pair"] = f"""
SELECT l.commodity AS commodity_a, r.commodity AS commodity_b, count(*) AS pair_baskets,
       {div("count(*)", "any_value(n)")} AS support,
       {div("count(*)", "any_value(ca.k)")} AS confidence_a_to_b,
       ({div("count(*)", "any_value(ca.k)")}) / ({div("any_value(cb.k)", "any_value(n)")})
           AS lift_a_to_b
FROM basket_items l JOIN basket_items r ON r.basket_id = l.basket_id AND r.commodity > l.commodity
JOIN (SELECT commodity, count(*) AS k FROM basket_items GROUP BY 1) ca ON ca.commodity = l.commodity
JOIN (SELECT commodity, count(*) AS k FROM basket_items GROUP BY 1) cb ON cb.commodity = r.commodity
CROSS JOIN (SELECT count(*) AS n FROM fct_basket)
GROUP BY l.commodity, r.commodity
HAVING count(*) >= 100 AND {div("count(*)", "any_value(n)")} >= CAST(0.01 AS DOUBLE)
"""
BODIES["mart_decision_alerts"] = """
SELECT metric, prev AS baseline, cur AS current, cur - prev AS variance,
       cur - prev AS absolute_variance, cur / NULLIF(prev, 0) - 1 AS relative_variance,
       CAST(-0.1 AS DOUBLE) AS threshold,
       CASE WHEN cur / NULLIF(prev, 0) - 1 < CAST(-0.1 AS DOUBLE) THEN lvl ELSE 'normal' END
           AS severity,
       'observation_week=' || week_number AS scope
FROM (SELECT *, lag(cur) OVER (PARTITION BY metric ORDER BY week_number) AS prev
      FROM (SELECT week_number, 'panel_net_spend_decline' AS metric, 'high' AS lvl,
                   CAST(panel_net_spend AS DOUBLE) AS cur FROM mart_panel_weekly
            UNION ALL SELECT week_number, 'active_households_decline', 'high',
                   CAST(active_households AS DOUBLE) FROM mart_panel_weekly
            UNION ALL SELECT week_number, 'trip_frequency_decline', 'medium',
                   trips_per_household FROM mart_panel_weekly))
WHERE prev IS NOT NULL
"""
BODIES["mart_category_household"] = """
SELECT household_key, category_key, department, commodity, min(day_key) AS first_observed_day,
       max(day_key) AS last_observed_day, min(week_number) AS first_observed_week,
       max(week_number) AS last_observed_week, count(DISTINCT week_number) AS active_weeks,
       count(DISTINCT day_key) AS active_days, sum(sales_value) AS panel_net_spend,
       count(DISTINCT basket_id) AS category_baskets,
       count(DISTINCT product_id) AS distinct_products, sum(off) AS discount_value,
       sum(cpn) AS coupon_discount, count(DISTINCT basket_id) FILTER (cpn > 0) AS coupon_baskets,
       sum(own) AS private_label_spend
FROM tl GROUP BY household_key, category_key, department, commodity
"""
BODIES["mart_category_household_weekly"] = """
SELECT household_key, week_number, category_key, dept_name AS department, comm_name AS commodity,
       sum(sales_value) AS panel_net_spend, count(DISTINCT basket_id) AS category_baskets,
       sum(quantity_raw) AS units, count(DISTINCT product_id) AS distinct_products,
       sum(off) AS discount_value
FROM tl GROUP BY ALL
"""
BODIES["mart_store_weekly"] = f"""
SELECT store_id, week_number, sum(sales_value) AS panel_net_spend,
       count(DISTINCT basket_id) AS baskets, count(DISTINCT household_key) AS active_households,
       count(DISTINCT product_id) AS distinct_products, count(*) AS transaction_lines,
       {div("sum(sales_value)", "count(DISTINCT basket_id)")} AS spend_per_basket
FROM stg_transaction GROUP BY store_id, week_number
"""

BODIES["fct_coupon_redemption"] = "SELECT * FROM stg_coupon_redemption"
