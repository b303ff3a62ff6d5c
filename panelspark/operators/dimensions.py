"""Dimensions."""

from pyspark.sql import functions as F

from panelspark.functions.columns import category_key, label
from panelspark.operators.staging import DEMOGRAPHICS
from panelspark.plans.registry import table

RULE_VERSION_CATEGORY = "category_v1_department_commodity"
#: Governed segments in display order.
SEGMENTS = (
    ("High-Value Declining", "High observed spend with declining late-window spend"),
    ("High-Value Engaged", "High observed spend with growing or stable late-window spend"),
    ("Frequent Core", "High basket frequency outside the high-monetary group"),
    ("Promotion-Responsive", "High observed coupon-basket or discount share"),
    ("Private-Label Loyal", "High observed private-label spend share"),
    ("Occasional", "Low frequency and limited active-week history"),
    ("Low-Engagement", "Observed households not assigned to a higher-priority rule"),
)


def _spine(w, column, first, last):
    """Every index between the observed bounds, gaps included."""
    ends = F.min(column), F.max(column)
    seen = w["stg_transaction"].agg(
        *[F.coalesce(e, F.lit(d)).alias(n) for e, d, n in zip(ends, (first, last), ("lo", "hi"))]
    )
    return seen.select(F.explode(F.sequence("lo", "hi")).alias(column))


@table("dimension")
def dim_day(w):
    days = _spine(w, "day_key", w.rules.first_day, w.rules.last_day)
    day = F.col("day_key")
    return days.select(
        "day_key",
        F.concat(F.lit("Observation Day "), day.cast("string")).alias("observation_day"),
        F.date_add(F.lit("2020-01-01").cast("date"), day - 1).alias("synthetic_date"),
    )


@table("dimension")
def dim_week(w):
    weeks = _spine(w, "week_number", w.rules.first_week, w.rules.last_week)
    week = F.col("week_number")
    return weeks.select(
        "week_number",
        F.concat(F.lit("Observation Week "), week.cast("string")).alias("observation_week"),
        F.date_add(F.lit("2020-01-01").cast("date"), (week - 1) * 7).alias("synthetic_week_start"),
    )


@table("dimension")
def dim_household(w):
    seen = w["stg_transaction"].where("household_key IS NOT NULL").select("household_key").distinct()
    attributes = F.struct(*[F.col(c) for c in DEMOGRAPHICS])
    # The smallest attribute row wins when a household is listed twice.
    described = (
        w["stg_household_demographic"]
        .groupBy("household_key")
        .agg(F.min(attributes).alias("d"), F.lit(True).alias("found"))
    )
    return seen.join(described, "household_key", "left").select(
        "household_key",
        *[F.col(f"d.{c}").alias(c) for c in DEMOGRAPHICS],
        F.coalesce("found", F.lit(False)).alias("has_demographics"),
    )


@table("dimension")
def dim_product(w):
    # MAX ignores repeats, so the typed rows need no DISTINCT first.
    names = [c for c in w["product_rows"].columns if c != "product_id"]
    return w["product_rows"].groupBy("product_id").agg(*[F.max(c).alias(c) for c in names])


@table("dimension")
def dim_store(w):
    return w["stg_transaction"].where("store_id IS NOT NULL").select("store_id").distinct()


@table("dimension")
def dim_campaign(w):
    return w["stg_campaign"]


@table("dimension")
def dim_coupon(w):
    linked = w["stg_coupon_product"].select("coupon_upc")
    return linked.unionByName(w["stg_coupon_redemption"].select("coupon_upc")).distinct()


@table("dimension")
def dim_category(w):
    pairs = w["dim_product"].select(
        label("department").alias("department"), label("commodity").alias("commodity")
    )
    return pairs.distinct().select(
        category_key("department", "commodity").alias("category_key"),
        "department",
        "commodity",
        F.concat_ws(" / ", "department", "commodity").alias("category_label"),
        F.lit(RULE_VERSION_CATEGORY).alias("rule_version"),
    )


@table("dimension")
def dim_segment(w):
    rows = [(name, i, text, "v1_deterministic") for i, (name, text) in enumerate(SEGMENTS, 1)]
    schema = "segment string, segment_order int, description string, rule_version string"
    return w.spark.createDataFrame(rows, schema)
