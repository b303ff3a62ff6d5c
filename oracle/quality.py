"""Quality audits."""

from oracle.analysis import q
from oracle.layers import div
from panelspark import fixed_text as text
from panelspark.operators.quality import ANOMALIES, CONTRACT_RULES, REQUIRED_ASSETS

BODIES = {}


def union(parts):
    return "\nUNION ALL ".join(parts)


_SOURCES = (
    ("transaction_data", "src_transaction", "household_key", ['"BASKET_ID"']),
    ("causal_data", "src_causal", None, ['"PRODUCT_ID"', '"STORE_ID"', '"WEEK_NO"']),
    ("coupon", "src_coupon", None, ['"COUPON_UPC"', '"PRODUCT_ID"', '"CAMPAIGN"']),
    (
        "coupon_redempt",
        "src_redemption",
        "household_key",
        ["household_key", '"DAY"', '"COUPON_UPC"', '"CAMPAIGN"'],
    ),
    ("campaign_table", "src_exposure", "household_key", ["household_key", '"CAMPAIGN"']),
    ("campaign_desc", "src_campaign", '"CAMPAIGN"', ['"CAMPAIGN"']),
    ("product", "src_product", '"PRODUCT_ID"', ['"PRODUCT_ID"']),
    ("hh_demographic", "src_demographic", "household_key", ["household_key"]),
)
BODIES["qa_source_reconciliation"] = union(
    f"SELECT '{s}' AS source_name, count(*) AS row_count, "
    f"{f'count(DISTINCT {h})' if h else '0'} AS households, "
    f"count(DISTINCT ({', '.join(k)})) AS baskets FROM {t}"
    for s, t, h, k in _SOURCES
)
BODIES["qa_key_audit"] = union(
    f"SELECT '{n}' AS model, count(*) - count(DISTINCT ({k})) AS duplicate_rows FROM {t}"
    for n, t, k in (
        ("product", "dim_product", "product_id"),
        ("household", "dim_household", "household_key"),
        (
            "promotion_product_store_week",
            "fct_promotion_product_store_week",
            "product_id, store_id, week_number",
        ),
        ("campaign_exposure", "fct_campaign_exposure", "household_key, campaign_id"),
        (
            "coupon_bridge",
            "bridge_coupon_product_campaign",
            "coupon_upc, product_id, campaign_id",
        ),
    )
)
BODIES["qa_grain_audit"] = union(
    f"SELECT 'basket_{n}_consistency' AS audit_name, count(*) AS violating_baskets FROM "
    f"(SELECT basket_id FROM fct_transaction_line GROUP BY 1 HAVING count(DISTINCT {c}) > 1)"
    for n, c in (("household", "household_key"), ("day", "day_key"), ("store", "store_id"))
)
BODIES["qa_discount_audit"] = (
    "SELECT count(*) AS transaction_lines, "
    + ", ".join(
        f"count(*) FILTER ({k}_disc_raw > 0) AS positive_{k}_disc_rows, "
        f"sum({k}_discount_value) AS {k}_discount_value"
        for k in ("retail", "coupon", "coupon_match")
    )
    + " FROM stg_transaction"
)
BODIES["qa_quantity_audit"] = """
SELECT count(*) AS transaction_lines,
       count(*) FILTER (quantity_raw <= 0) AS non_positive_quantity_rows,
       min(quantity_raw) AS min_quantity, max(quantity_raw) AS max_quantity,
       quantile_cont(quantity_raw, 0.5) AS p50_quantity,
       quantile_cont(quantity_raw, 0.95) AS p95_quantity,
       quantile_cont(quantity_raw, 0.99) AS p99_quantity,
       count(*) FILTER (quantity_outlier_flag) AS flagged_outlier_rows
FROM fct_transaction_line
"""
BODIES["qa_campaign_observability"] = (
    "SELECT campaign_id, count(*) AS recipient_rows, "
    + ", ".join(
        f"count(*) FILTER ({p}_observable) AS {p}_observable_rows"
        for p in ("pre_28d", "during", "post_14d", "post_28d")
    )
    + ", min(start_day) AS start_day, max(end_day) AS end_day"
    " FROM fct_campaign_exposure GROUP BY campaign_id"
)


def _avg(c, flag):
    return div(f"sum({c}) FILTER ({flag})", f"count({c}) FILTER ({flag})")


BODIES["qa_demographic_coverage"] = f"""
SELECT count(*) AS observed_households,
       count(*) FILTER (d.has_demographics) AS households_with_demographics,
       count(*) FILTER (NOT d.has_demographics) AS households_without_demographics,
       {div("count(*) FILTER (d.has_demographics)", "count(*)")} AS demographic_coverage_pct,
       {_avg("observed_lifetime_spend", "d.has_demographics")} AS avg_spend_covered,
       {_avg("observed_lifetime_spend", "NOT d.has_demographics")} AS avg_spend_uncovered,
       {_avg("frequency_baskets", "d.has_demographics")} AS avg_baskets_covered,
       {_avg("frequency_baskets", "NOT d.has_demographics")} AS avg_baskets_uncovered
FROM dim_household d LEFT JOIN mart_household_summary s ON s.household_key = d.household_key
"""
BODIES["qa_reference_coverage"] = union(
    f"SELECT '{n}' AS audit_name, count(*) AS violating_rows FROM {t} x "
    f"WHERE NOT EXISTS (SELECT 1 FROM {d} y WHERE y.{k} = x.{k})"
    for n, t, d, k in (
        ("transaction_product_unmatched", "fct_transaction_line", "dim_product", "product_id"),
        (
            "promotion_product_unmatched",
            "fct_promotion_product_store_week",
            "dim_product",
            "product_id",
        ),
        ("campaign_exposure_unmatched", "fct_campaign_exposure", "dim_campaign", "campaign_id"),
        ("coupon_redemption_unmatched", "stg_coupon_redemption", "dim_coupon", "coupon_upc"),
        ("campaign_household_unmatched", "fct_campaign_exposure", "dim_household", "household_key"),
        (
            "coupon_redemption_household_unmatched",
            "stg_coupon_redemption",
            "dim_household",
            "household_key",
        ),
        (
            "coupon_bridge_product_unmatched",
            "bridge_coupon_product_campaign",
            "dim_product",
            "product_id",
        ),
        (
            "coupon_redemption_campaign_unmatched",
            "stg_coupon_redemption",
            "dim_campaign",
            "campaign_id",
        ),
    )
)
_BROKEN = {
    "day_range": "day_key IS NULL OR day_key NOT BETWEEN 1 AND 711",
    "week_range": "week_number IS NULL OR week_number NOT BETWEEN 1 AND 102",
    "sales_negative": "sales_value < 0",
    "sales_zero": "sales_value = 0",
    "quantity_non_positive": "quantity_raw IS NULL OR quantity_raw <= 0",
    "quantity_outlier": "quantity_outlier_flag",
    "trans_time_invalid": "trans_time IS NULL OR trans_time NOT BETWEEN 0 AND 2359 "
    "OR trans_time % 100 > 59",
    "missing_product": "product_id IS NULL",
    "missing_household": "household_key IS NULL",
    "missing_basket": "basket_id IS NULL",
}


def _shown(f, c):
    if c is None:
        return "CAST(NULL AS VARCHAR)"
    v = f"{f}({c})"
    return f"CAST({f'CAST({v} AS DOUBLE)' if c == 'sales_value' else v} AS VARCHAR)"


BODIES["qa_transaction_anomalies"] = union(
    f"SELECT '{n}' AS audit_name, {_shown('min', c)} AS observed_min, "
    f"{_shown('max', c)} AS observed_max, count(*) FILTER ({_BROKEN[n]}) AS violating_rows, "
    f"{q(rule)} AS rule FROM fct_transaction_line"
    for n, c, rule in ANOMALIES
)


def _stats(t, h=None, b=None, s=None):
    return (
        f"SELECT count(*) AS n, {f'count(DISTINCT {h})' if h else 'CAST(NULL AS BIGINT)'} AS h, "
        f"{f'count(DISTINCT {b})' if b else 'CAST(NULL AS BIGINT)'} AS b, "
        f"CAST({f'sum({s})' if s else 'NULL'} AS DECIMAL(38,4)) AS s FROM {t}"
    )


_STG = ("stg_transaction", "household_key", "basket_id", "sales_value")
_FCT = ("fct_transaction_line", "household_key", "basket_id", "sales_value")
_LAYERS = (
    (
        "transaction_raw_vs_staging",
        "equal_rows_population_and_sales",
        ("src_transaction", "household_key", '"BASKET_ID"', '"SALES_VALUE"'),
        _STG,
    ),
    ("transaction_staging_vs_fact", "equal_rows_population_and_sales", _STG, _FCT),
    (
        "transaction_fact_vs_basket",
        "equal_population_and_sales_aggregation",
        _FCT,
        ("fct_basket", "household_key", "basket_id", "basket_net_spend"),
    ),
    (
        "causal_raw_vs_promotion_fact",
        "distinct_product_store_week_grain",
        ('(SELECT DISTINCT "PRODUCT_ID", "STORE_ID", "WEEK_NO" FROM src_causal)',),
        ("fct_promotion_product_store_week",),
    ),
    (
        "redemption_raw_vs_fact",
        "equal_rows",
        ("src_redemption", "household_key"),
        ("stg_coupon_redemption", "household_key"),
    ),
    (
        "campaign_exposure_raw_vs_fact",
        "equal_rows_and_population",
        ("src_exposure", "household_key"),
        ("fct_campaign_exposure", "household_key"),
    ),
    ("campaign_desc_raw_vs_dimension", "equal_rows", ("src_campaign",), ("dim_campaign",)),
    ("product_raw_vs_dimension", "deduplication_expected", ("src_product",), ("dim_product",)),
    (
        "coupon_raw_vs_bridge",
        "deduplication_expected",
        ("src_coupon",),
        ("bridge_coupon_product_campaign",),
    ),
)
BODIES["layer_stats"] = union(
    f"SELECT '{n}' AS audit_name, '{rule}' AS reconciliation_rule, u.n AS un, d.n AS dn, "
    f"u.h AS uh, d.h AS dh, u.b AS ub, d.b AS db, u.s AS us, d.s AS ds "
    f"FROM ({_stats(*up)}) u, ({_stats(*down)}) d"
    for n, rule, up, down in _LAYERS
)
BODIES["qa_layer_reconciliation"] = """
SELECT audit_name, reconciliation_rule, un AS upstream_rows, dn AS downstream_rows,
       dn - un AS row_difference, uh AS upstream_households, dh AS downstream_households,
       dh - uh AS household_difference, ub AS upstream_baskets, db AS downstream_baskets,
       db - ub AS basket_difference, us AS upstream_sales, ds AS downstream_sales,
       ds - us AS sales_difference,
       CASE WHEN CASE reconciliation_rule
            WHEN 'equal_rows_population_and_sales'
                 THEN un = dn AND uh = dh AND ub = db AND abs(ds - us) <= 0.01
            WHEN 'equal_population_and_sales_aggregation'
                 THEN uh = dh AND ub = db AND abs(ds - us) <= 0.01
            WHEN 'equal_rows_and_population' THEN un = dn AND uh = dh
            WHEN 'deduplication_expected' THEN dn <= un
            ELSE un = dn END THEN 'pass' ELSE 'review' END AS status
FROM layer_stats
"""
_EMPTY = "{0} IS NULL OR trim({0}) = ''"
_CONTRACT = {
    "required_household_key": ("src_transaction", "count(*) FILTER (household_key IS NULL)"),
    "required_basket_id": ("src_transaction", 'count(*) FILTER ("BASKET_ID" IS NULL)'),
    "required_product_id": ("src_transaction", 'count(*) FILTER ("PRODUCT_ID" IS NULL)'),
    "required_store_id": ("src_transaction", 'count(*) FILTER ("STORE_ID" IS NULL)'),
    "required_sales_value": ("src_transaction", 'count(*) FILTER ("SALES_VALUE" IS NULL)'),
    "required_observation_index": (
        "src_transaction",
        'count(*) FILTER (NOT COALESCE("DAY" >= 1 AND "WEEK_NO" >= 1, FALSE))',
    ),
    "duplicate_raw_rows": (
        "src_transaction",
        "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src_transaction))",
    ),
    "duplicate_product_id": ("src_product", 'count(*) - count(DISTINCT "PRODUCT_ID")'),
    "required_category_attributes": (
        "src_product",
        f"count(*) FILTER ({_EMPTY.format(chr(34) + 'DEPARTMENT' + chr(34))} OR "
        f"{_EMPTY.format(chr(34) + 'COMMODITY_DESC' + chr(34))})",
    ),
    "required_brand_flag": (
        "src_product",
        f"count(*) FILTER ({_EMPTY.format(chr(34) + 'BRAND' + chr(34))})",
    ),
    "invalid_brand_domain": (
        "src_product",
        "count(*) FILTER (lower(trim(\"BRAND\")) <> 'private' AND lower(trim(\"BRAND\")) <> 'national')",
    ),
    "duplicate_campaign_id": ("src_campaign", 'count(*) - count(DISTINCT "CAMPAIGN")'),
    "invalid_campaign_window": (
        "src_campaign",
        'count(*) FILTER (NOT COALESCE("START_DAY" >= 1 AND "END_DAY" >= "START_DAY", FALSE))',
    ),
    "duplicate_campaign_exposure": (
        "src_exposure",
        'count(*) - count(DISTINCT (household_key, "CAMPAIGN"))',
    ),
    "recipient_without_campaign": (
        "src_exposure",
        'count(*) FILTER ("DESCRIPTION" IS NULL OR "DESCRIPTION" NOT IN '
        '(SELECT "DESCRIPTION" FROM src_campaign))',
    ),
    "coupon_without_product": (
        "src_coupon",
        'count(*) FILTER ("PRODUCT_ID" NOT IN (SELECT "PRODUCT_ID" FROM src_product))',
    ),
    "coupon_without_campaign": (
        "src_coupon",
        'count(*) FILTER ("CAMPAIGN" NOT IN (SELECT "CAMPAIGN" FROM src_campaign))',
    ),
    "duplicate_coupon_product_campaign": (
        "src_coupon",
        'count(*) - count(DISTINCT ("COUPON_UPC", "PRODUCT_ID", "CAMPAIGN"))',
    ),
    "duplicate_redemption_event": (
        "src_redemption",
        'count(*) - count(DISTINCT (household_key, "DAY", "COUPON_UPC", "CAMPAIGN"))',
    ),
    "redemption_without_coupon_mapping": (
        "src_redemption",
        'count(*) FILTER (("COUPON_UPC", "CAMPAIGN") NOT IN '
        '(SELECT ("COUPON_UPC", "CAMPAIGN") FROM src_coupon))',
    ),
    "duplicate_product_store_week": (
        "src_causal",
        'count(*) - count(DISTINCT ("PRODUCT_ID", "STORE_ID", "WEEK_NO"))',
    ),
    "unsupported_promotion_codes": (
        "src_causal",
        # The two code domains.
        "count(*) FILTER (display NOT IN ('0', '1', '2', '3', '4', '5', '6', '7', '9', 'A') "
        "OR mailer NOT IN ('0', 'A', 'C', 'D', 'F', 'H', 'J', 'L', 'P', 'X', 'Z'))",
    ),
}
BODIES["contract_counts"] = union(
    f"SELECT '{source}' AS source_name, '{check}' AS check_name, {_CONTRACT[check][1]} AS n, "
    f"'{severity}' AS severity, {q(rule)} AS rule FROM {_CONTRACT[check][0]}"
    for (source, check), (severity, rule) in CONTRACT_RULES.items()
)
BODIES["qa_source_contract_audit"] = """
SELECT source_name, check_name, n AS violating_rows, severity,
       CASE n WHEN 0 THEN 'PASS' ELSE 'REVIEW' END AS status, rule
FROM contract_counts
"""
BODIES["promotion_universe_raw_audit"] = f"""
SELECT r.*, m.*, CASE WHEN none_rows > 0 THEN 'RECOVERED' ELSE 'NOT_OBSERVED' END AS none_state_status,
       CASE WHEN none_rows > 0 THEN 'RECOVERED_MODELED_NONE'
            WHEN raw_zero_zero_rows > 0 THEN 'CASE_B_RAW_ZERO_ZERO_NOT_RETAINED'
            ELSE 'CASE_A_RAW_PROMOTED_ROWS_ONLY' END AS recovery_case,
       none_rows > 0 AS valid_none_for_uplift, {q(text.PROMOTION_AUDIT)} AS interpretation_boundary
FROM state_totals m,
     (SELECT count(*) AS raw_total_rows,
             count(*) FILTER (display = '0' AND mailer = '0') AS raw_zero_zero_rows,
             count(DISTINCT ("PRODUCT_ID", "STORE_ID", "WEEK_NO"))
                 FILTER (display = '0' AND mailer = '0') AS raw_zero_zero_keys
      FROM src_causal) r
"""
BODIES["governed_asset_audit"] = (
    union(
        f"SELECT '{t}' AS asset, '{t}' AS relation, count(*) AS row_count, "
        f"CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'REVIEW' END AS status, '' AS error FROM "
        + (t if t != "dim_segment" else "range(7)")
        for t in REQUIRED_ASSETS
    )
    + "\nUNION ALL SELECT 'promotion_universe_interpretation', 'analysis_promotion_universe_audit', "
    "total_rows, 'PASS', none_state_status || ': ' || interpretation_boundary "
    "FROM analysis_promotion_universe_audit"
)


def _gate(t, name, value, reason, level, bad):
    return (
        f"SELECT '{t}' AS source_table, {name} AS audit_name, CAST({value} AS VARCHAR) AS value, "
        f"'{reason}' AS reason, {level} AS level FROM {t} WHERE {bad}"
    )


BODIES["quality_gate_findings"] = union(
    [
        _gate("qa_key_audit", "model", "duplicate_rows", "duplicate_key_rows", "'fail'", "duplicate_rows > 0"),
        _gate(
            "qa_grain_audit",
            "audit_name",
            "violating_baskets",
            "basket_grain_inconsistency",
            "'fail'",
            "violating_baskets > 0",
        ),
        _gate(
            "qa_reference_coverage",
            "audit_name",
            "violating_rows",
            "unmatched_reference",
            "'fail'",
            "violating_rows > 0",
        ),
        _gate(
            "qa_layer_reconciliation",
            "audit_name",
            "status",
            "layer_reconciliation_review",
            "'fail'",
            "status <> 'pass'",
        ),
        _gate(
            "qa_transaction_anomalies",
            "audit_name",
            "violating_rows",
            "transaction_anomaly_retained_for_review",
            "CASE WHEN starts_with(audit_name, 'missing_') THEN 'fail' ELSE 'warning' END",
            "violating_rows > 0",
        ),
        _gate(
            "qa_source_contract_audit",
            "check_name",
            "violating_rows",
            "source_contract_review",
            "CASE severity WHEN 'block' THEN 'fail' ELSE 'warning' END",
            "violating_rows > 0",
        ),
    ]
)
BODIES["quality_gate"] = """
SELECT count(*) FILTER (level = 'fail') = 0 AS ready, 6 AS checked_tables,
       count(*) FILTER (level = 'fail') AS failures, count(*) FILTER (level = 'warning') AS warnings
FROM quality_gate_findings
"""
