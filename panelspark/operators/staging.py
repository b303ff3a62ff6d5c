"""Typed projections of the eight sources."""

from pyspark.sql import functions as F

from panelspark.functions.columns import MONEY, text_or_null
from panelspark.plans.registry import table


@table("staging")
def stg_transaction(w):
    signed = {
        "retail": F.col("RETAIL_DISC").cast(MONEY),
        "coupon": F.col("COUPON_DISC").cast(MONEY),
        "coupon_match": F.col("COUPON_MATCH_DISC").cast(MONEY),
    }
    time = F.col("TRANS_TIME").cast("int")
    return w.raw("transaction_data").select(
        F.col("household_key").cast("bigint"),
        F.col("BASKET_ID").cast("bigint").alias("basket_id"),
        F.col("DAY").cast("int").alias("day_key"),
        F.col("PRODUCT_ID").cast("bigint").alias("product_id"),
        F.col("QUANTITY").cast("double").alias("quantity_raw"),
        F.col("SALES_VALUE").cast(MONEY).alias("sales_value"),
        F.col("STORE_ID").cast("bigint").alias("store_id"),
        *[c.alias(f"{k}_disc_raw") for k, c in signed.items()],
        *[F.abs(c).alias(f"{k}_discount_value") for k, c in signed.items()],
        time.alias("trans_time"),
        F.floor(time / 100).cast("int").alias("transaction_hour"),
        F.col("WEEK_NO").cast("int").alias("week_number"),
    )


@table("internal")
def product_rows(w):
    """Typed product rows before de-duplication."""
    brand = F.trim(F.col("BRAND").cast("string"))
    known = F.lower(brand).isin("private", "national")
    return w.raw("product").select(
        F.col("PRODUCT_ID").cast("bigint").alias("product_id"),
        F.col("MANUFACTURER").cast("string").alias("manufacturer_id"),
        F.col("DEPARTMENT").cast("string").alias("department"),
        F.when(known, F.upper(brand))
        .otherwise(F.coalesce(F.nullif(brand, F.lit("")), F.lit("Unknown")))
        .alias("brand_type"),
        F.col("COMMODITY_DESC").cast("string").alias("commodity"),
        F.col("SUB_COMMODITY_DESC").cast("string").alias("sub_commodity"),
        F.col("CURR_SIZE_OF_PRODUCT").cast("string").alias("product_size"),
    )


@table("staging")
def stg_product(w):
    return w["product_rows"].distinct()


#: Which source attribute carries which demographic.
DEMOGRAPHICS = {
    "age_desc": "classification_1",
    "marital_status_code": "classification_2",
    "income_desc": "classification_3",
    "homeowner_desc": "HOMEOWNER_DESC",
    "hh_comp_desc": "classification_5",
    "household_size_desc": "classification_4",
    "kid_category_desc": "KID_CATEGORY_DESC",
}


@table("staging")
def stg_household_demographic(w):
    return w.raw("hh_demographic").select(
        F.col("household_key").cast("bigint"),
        *[text_or_null(source).alias(name) for name, source in DEMOGRAPHICS.items()],
    )


@table("staging")
def stg_campaign(w):
    return (
        w.raw("campaign_desc")
        .select(
            F.col("CAMPAIGN").cast("int").alias("campaign_id"),
            F.col("DESCRIPTION").cast("string").alias("campaign_type"),
            F.col("START_DAY").cast("int").alias("start_day"),
            F.col("END_DAY").cast("int").alias("end_day"),
        )
        .distinct()
    )


@table("staging")
def stg_campaign_exposure(w):
    return (
        w.raw("campaign_table")
        .select(
            F.col("household_key").cast("bigint"),
            F.col("CAMPAIGN").cast("int").alias("campaign_id"),
        )
        .distinct()
    )


@table("staging")
def stg_coupon_product(w):
    return (
        w.raw("coupon")
        .select(
            F.col("COUPON_UPC").cast("bigint").alias("coupon_upc"),
            F.col("PRODUCT_ID").cast("bigint").alias("product_id"),
            F.col("CAMPAIGN").cast("int").alias("campaign_id"),
        )
        .distinct()
    )


@table("staging")
def stg_coupon_redemption(w):
    return w.raw("coupon_redempt").select(
        F.col("household_key").cast("bigint"),
        F.col("DAY").cast("int").alias("day_key"),
        F.col("COUPON_UPC").cast("bigint").alias("coupon_upc"),
        F.col("CAMPAIGN").cast("int").alias("campaign_id"),
    )


def promo_state(on_display, in_mailer):
    """Four-state label; unknown flags fall through to the last state."""
    return (
        F.when(~on_display & ~in_mailer, "none")
        .when(on_display & ~in_mailer, "display_only")
        .when(~on_display & in_mailer, "mailer_only")
        .otherwise("display_and_mailer")
    )


@table("staging")
def stg_promotion_state(w):
    display, mailer = F.col("display").cast("string"), F.col("mailer").cast("string")
    no = F.lit(False)
    return w.raw("causal_data").select(
        F.col("PRODUCT_ID").cast("bigint").alias("product_id"),
        F.col("STORE_ID").cast("bigint").alias("store_id"),
        F.col("WEEK_NO").cast("int").alias("week_number"),
        display.alias("display_code"),
        mailer.alias("mailer_code"),
        F.coalesce(display != "0", no).alias("is_on_display"),
        F.coalesce(mailer != "0", no).alias("is_in_mailer"),
        promo_state(display != "0", mailer != "0").alias("promo_state_group"),
    )
