"""Result-edge casts: which columns leave as DOUBLE and which as BIGINT.

A table written by tools/oracle_edges.py from the Spark results' types.
"""

EDGES = {
    "analysis_basket_category": (
        "panel_net_spend",
        "buying_household_week_records category_baskets",
    ),
    "analysis_campaign_denominators": (
        "",
        "campaign_id",
    ),
    "analysis_campaign_funnel": (
        "",
        "campaign_id",
    ),
    "analysis_campaign_segment": (
        "",
        "campaign_id",
    ),
    "analysis_category_decomposition": (
        "early_spend late_spend spend_change",
        "",
    ),
    "analysis_category_materiality": (
        "early_spend late_spend spend_change",
        "early_category_baskets late_category_baskets basket_change",
    ),
    "analysis_category_penetration": (
        "panel_net_spend",
        "category_baskets household_category_active_weeks",
    ),
    "analysis_coupon_campaign": (
        "",
        "campaign_id",
    ),
    "analysis_coupon_category": (
        "",
        "campaign_id",
    ),
    "analysis_coupon_segment": (
        "",
        "campaign_id",
    ),
    "analysis_customer_engagement": (
        "observed_lifetime_spend",
        "frequency_baskets",
    ),
    "analysis_demographic_summary": (
        "observed_lifetime_spend",
        "",
    ),
    "analysis_first_observed_cohort": (
        "",
        "first_observed_week",
    ),
    "analysis_household_engagement_sequence": (
        "net_spend prior_week_spend next_week_spend cumulative_household_spend",
        "week_number",
    ),
    "analysis_panel_driver_tree": (
        "panel_net_spend cumulative_panel_spend prior_panel_net_spend",
        "week_number",
    ),
    "analysis_private_label": (
        "private_label_spend category_spend",
        "private_label_buying_households",
    ),
    "analysis_private_label_anomalies": (
        "private_label_spend category_spend",
        "",
    ),
    "analysis_promotion_association": (
        "panel_sales",
        "product_store_weeks panel_buying_households panel_baskets",
    ),
    "analysis_promotion_dependency": (
        "total_panel_sales promoted_panel_sales",
        "total_product_store_weeks promoted_product_store_weeks",
    ),
    "bridge_coupon_product_campaign": (
        "",
        "campaign_id",
    ),
    "dim_campaign": (
        "",
        "campaign_id start_day end_day",
    ),
    "fct_basket": (
        "basket_net_spend basket_gross_spend basket_discount_value basket_coupon_discount",
        "day_key week_number transaction_hour",
    ),
    "fct_campaign_exposure": (
        "",
        "campaign_id start_day end_day",
    ),
    "fct_promotion_product_store_week": (
        "",
        "week_number",
    ),
    "fct_transaction_line": (
        "sales_value retail_disc_raw coupon_disc_raw coupon_match_disc_raw retail_discount_value coupon_discount_value coupon_match_discount_value gross_spend_before_recorded_discounts",
        "day_key trans_time transaction_hour week_number",
    ),
    "finding_category_erosion": (
        "early_spend late_spend spend_change",
        "",
    ),
    "finding_promo_rank": (
        "panel_sales",
        "product_store_weeks",
    ),
    "finding_segment_rollup": (
        "spend",
        "",
    ),
    "finding_strongest_campaign": (
        "",
        "campaign_id",
    ),
    "finding_weakest_campaign": (
        "",
        "campaign_id",
    ),
    "mart_basket": (
        "basket_net_spend basket_gross_spend basket_discount_value basket_coupon_discount",
        "day_key week_number transaction_hour",
    ),
    "mart_brand_category": (
        "panel_net_spend",
        "",
    ),
    "mart_campaign_household": (
        "pre_28d_spend during_spend post_28d_spend",
        "campaign_id start_day end_day",
    ),
    "mart_campaign_summary": (
        "",
        "campaign_id",
    ),
    "mart_category_household": (
        "panel_net_spend discount_value coupon_discount private_label_spend",
        "first_observed_day last_observed_day first_observed_week last_observed_week",
    ),
    "mart_category_household_weekly": (
        "panel_net_spend discount_value",
        "week_number",
    ),
    "mart_category_weekly": (
        "panel_net_spend",
        "week_number",
    ),
    "mart_coupon_summary": (
        "",
        "campaign_id",
    ),
    "mart_customer_segment": (
        "observed_lifetime_spend monetary_spend",
        "first_observed_week last_observed_week lifetime_baskets frequency_baskets",
    ),
    "mart_household_summary": (
        "observed_lifetime_spend",
        "first_observed_week last_observed_week lifetime_baskets frequency_baskets",
    ),
    "mart_household_weekly": (
        "net_spend discount_value coupon_discount private_label_spend",
        "week_number",
    ),
    "mart_panel_weekly": (
        "panel_net_spend panel_gross_spend discount_value private_label_spend",
        "week_number",
    ),
    "mart_promotion_category_week": (
        "panel_sales",
        "week_number panel_buying_households panel_baskets",
    ),
    "mart_store_weekly": (
        "panel_net_spend",
        "week_number",
    ),
    "measures_campaign_slices": (
        "",
        "campaign_id",
    ),
    "measures_core_by_week": (
        "",
        "week_number",
    ),
    "measures_store_by_week": (
        "",
        "week_number",
    ),
    "private_label_category_audit": (
        "private_label_spend category_spend",
        "",
    ),
    "qa_campaign_observability": (
        "",
        "campaign_id start_day end_day",
    ),
    "qa_discount_audit": (
        "retail_discount_value coupon_discount_value coupon_match_discount_value",
        "",
    ),
    "qa_layer_reconciliation": (
        "upstream_sales downstream_sales sales_difference",
        "",
    ),
    "quality_gate": (
        "",
        "checked_tables",
    ),
    "read_parquet": (
        "",
        "column_count",
    ),
    "read_source": (
        "",
        "column_count",
    ),
    "root_cause_periods": (
        "panel_net_spend",
        "",
    ),
    "schema_contract_check": (
        "",
        "observed_column_count",
    ),
    "segment_share_of_total": (
        "segment_spend",
        "",
    ),
    "snapshot_brand_mix": (
        "spend",
        "households baskets",
    ),
    "snapshot_campaign_funnel": (
        "",
        "value",
    ),
    "snapshot_campaign_segments": (
        "",
        "recipients redeemers observable_rows",
    ),
    "snapshot_campaign_types": (
        "",
        "recipients redeemers observable_rows",
    ),
    "snapshot_declining_households": (
        "observed_lifetime_spend",
        "",
    ),
    "snapshot_department_brand": (
        "NATIONAL PRIVATE total_spend",
        "",
    ),
    "snapshot_department_promo": (
        "",
        "total promoted",
    ),
    "snapshot_promo_states": (
        "panel_sales",
        "product_store_weeks panel_baskets",
    ),
    "snapshot_promotion_weekly": (
        "panel_sales",
        "week_number product_store_weeks",
    ),
    "snapshot_segments": (
        "spend",
        "trips",
    ),
    "snapshot_top_commodities": (
        "spend",
        "baskets",
    ),
    "snapshot_week_bands": (
        "panel_net_spend",
        "baskets",
    ),
    "source_inventory": (
        "",
        "expected_row_count column_count",
    ),
    "source_profile_summary": (
        "",
        "column_count",
    ),
    "stg_campaign": (
        "",
        "campaign_id start_day end_day",
    ),
    "stg_campaign_exposure": (
        "",
        "campaign_id",
    ),
    "stg_coupon_product": (
        "",
        "campaign_id",
    ),
    "fct_coupon_redemption": (
        "",
        "day_key campaign_id",
    ),
    "stg_coupon_redemption": (
        "",
        "day_key campaign_id",
    ),
    "stg_promotion_state": (
        "",
        "week_number",
    ),
    "stg_transaction": (
        "sales_value retail_disc_raw coupon_disc_raw coupon_match_disc_raw retail_discount_value coupon_discount_value coupon_match_discount_value",
        "day_key trans_time transaction_hour week_number",
    ),
    "write_table": (
        "panel_net_spend",
        "week_number",
    ),
}
