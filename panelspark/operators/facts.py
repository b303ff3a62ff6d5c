"""Facts and the coupon bridge."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.bits import bit_words, bits_set
from panelspark.functions.columns import category_key, label
from panelspark.functions.ordering import pinned
from panelspark.functions.quantiles import value_counts, weighted_quantile
from panelspark.operators.staging import promo_state
from panelspark.plans.registry import table
from panelspark.sources.files import work_folder

DISCOUNT = "retail_discount_value + coupon_discount_value + coupon_match_discount_value"
COUPON = "coupon_discount_value + coupon_match_discount_value"


@table("internal")
def lines(w):
    """Transaction lines with gross spend, without a surrogate id."""
    return w["stg_transaction"].select(
        "*",
        F.expr(f"sales_value + {DISCOUNT}")
        .cast("decimal(20,4)")
        .alias("gross_spend_before_recorded_discounts"),
    )


@table("internal")
def flagged_lines(w):
    """Lines with the outlier flag, which needs a pass over the quantities of its own."""
    counts = value_counts(w["lines"].where("quantity_raw IS NOT NULL"), "quantity_raw")
    p99 = pinned(weighted_quantile(counts, [], "quantity_raw", "_n", 0.99, "p99")).scalar()
    quantity = F.col("quantity_raw")
    odd = (quantity <= 0) | (quantity > p99)
    return w["lines"].withColumn("quantity_outlier_flag", F.coalesce(odd, F.lit(False)))


@table("internal")
def products(w):
    """Product attributes every line-level mart needs, with the governed key worked out once."""
    names = ("department", "commodity")
    return w["dim_product"].select(
        "product_id",
        "department",
        "commodity",
        "brand_type",
        category_key("department", "commodity").alias("category_key"),
        label("department").alias("department_name"),
        label("commodity").alias("commodity_name"),
        F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("\u0000")) for c in names]).alias("raw_key"),
    )


def unknown_category(w):
    """'Unknown|Unknown' when that category exists: where lines without a product row belong."""
    nameless = (F.col("department") == "Unknown") & (F.col("commodity") == "Unknown")
    return w["dim_category"].where(nameless).agg(F.max("category_key")).scalar()


def line_amounts(df):
    return df.withColumns(
        {
            # a private line without a sales value stays unknown; other lines count as nothing
            "private_sales": F.when(F.col("brand_type") == "PRIVATE", F.col("sales_value")).otherwise(
                F.lit(0).cast("decimal(18,4)")
            ),
            "discount": F.expr(DISCOUNT).cast("decimal(18,4)"),
            "coupon_discount": F.expr(COUPON).cast("decimal(18,4)"),
        }
    )


@table("internal")
def product_lines(w):
    """Lines with product attributes."""
    joined = w["lines"].join(w.beside(w["products"], "products"), "product_id", "left")
    return line_amounts(joined).withColumn(
        "category_key", F.coalesce("category_key", unknown_category(w))
    )


@table("internal")
def category_numbers(w):
    """One number per raw department and commodity: its smallest product id.

    Household-by-category work groups and shuffles on this number; the names come back at the
    end, on the aggregated rows.
    """
    names = ("raw_key", "category_key", "department", "commodity")
    return w["products"].groupBy(*names).agg(F.min("product_id").alias("category_no"))


@table("internal")
def governed_numbers(w):
    """The same per governed category, whose names are already cleaned."""
    cleaned = w["products"].groupBy("category_key", "department_name", "commodity_name")
    return cleaned.agg(F.min("product_id").alias("category_no")).withColumnsRenamed(
        {"department_name": "department", "commodity_name": "commodity"}
    )


def numbered_lines(w, numbers, key, nameless):
    """Lines with brand and category number; lines without a product take the nameless one."""
    known = w["products"].join(numbers.select(key, "category_no"), key)
    known = w.beside(known.select("product_id", "brand_type", "category_no"), "products")
    found = w["lines"].join(known, "product_id", "left")
    spare = numbers.where(nameless).agg(F.max("category_no")).scalar()
    return line_amounts(found).withColumn("category_no", F.coalesce("category_no", spare))


@table("internal")
def category_lines(w):
    nameless = F.col("department").isNull() & F.col("commodity").isNull()
    return numbered_lines(w, w["category_numbers"], "raw_key", nameless)


@table("internal")
def governed_lines(w):
    nameless = F.col("category_key") == "Unknown|Unknown"
    return numbered_lines(w, w["governed_numbers"], "category_key", nameless)


def per_person(lines, keys, sums, marked=None):
    """Lines in two stages, without repeating a line per counted column: one row per group and basket
    with its households, then one per group and household.

    ``sums`` are {name: column}. The result has the group, ``household_key``, the sums, ``baskets`` and, with a
    condition ``marked``, ``marked_baskets`` (baskets with such a line). A basket of several households, a
    fault the audits report, counts once, with one of them.
    """
    baskets = lines.groupBy(*keys, "basket_id").agg(
        F.collect_set("household_key").alias("_people"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
        F.max(F.coalesce(marked, F.lit(False)) if marked is not None else F.lit(False)).alias("_marked"),
    )
    people = baskets.select(*keys, "basket_id", "_marked", *sums, F.posexplode_outer("_people").alias("_i", "household_key"))
    lead = F.coalesce(F.col("_i"), F.lit(0)) == 0
    counted = lead & F.col("basket_id").isNotNull()
    found = people.groupBy(*keys, "household_key").agg(
        *[F.sum(F.when(lead, F.col(n))).alias(n) for n in sums],
        F.count_if(counted).alias("baskets"),
        F.count_if(counted & F.col("_marked")).alias("marked_baskets"),
    )
    return found if marked is not None else found.drop("marked_baskets")


def per_group(people, keys, sums):
    """The last stage: ``people`` (households), ``baskets`` and the sums per group."""
    return people.groupBy(*keys).agg(
        F.count("household_key").alias("people"), *[F.sum(c).alias(c) for c in ("baskets", *sums)]
    )


def named_categories(w, df):
    """Put category names back on aggregated rows of :func:`category_lines`."""
    names = w["category_numbers"].drop("raw_key")
    return df.join(names, "category_no", "left").withColumn(
        "category_key", F.coalesce("category_key", unknown_category(w))
    )


@table("fact")
def fct_transaction_line(w):
    lines_ = w["flagged_lines"]
    return lines_.select(
        (F.monotonically_increasing_id() + 1).alias("transaction_line_id"), *lines_.columns
    )


#: Names counted as bits; a longer list is counted by sets.
MOST_NAMES = 256


def list_sizes(w, columns):
    """Product ids with what ``sizes`` needs of them, and ``sizes``: {name: aggregate} of the distinct values of product
    attributes whose lists are short (departments, commodities).

    The lists are read once, a name becomes its place in its list and a set the bits of its places: sets merge
    inside the aggregation, so no row is repeated per counted column.
    """
    carried, sizes = [], {}
    for c in columns:
        known = w["products"].where(F.col(c).isNotNull()).select(c).distinct()
        names = [r[0] for r in known.limit(MOST_NAMES + 1).collect()]
        if 0 < len(names) <= MOST_NAMES:
            place = F.array_position(F.array(*[F.lit(n) for n in sorted(names)]), F.col(c))
            carried.append(place.alias(f"_place_{c}"))
            sizes[c] = bits_set(bit_words(f"_place_{c}", 1, len(names)))
        else:
            carried.append(F.col(c))
            sizes[c] = F.size(F.collect_set(c)).cast("bigint")
    return w.beside(w["products"].select("product_id", *carried), "products"), sizes


@table("fact")
def fct_basket(w):
    """One grouping by basket. What a reader leaves out is not worked out: without the three distinct counts
    neither products nor their names are read, and a basket is one row from the start."""
    carried = ("household_key", "day_key", "week_number", "store_id")
    sums = {
        "basket_net_spend": "sales_value",
        "basket_gross_spend": "gross_spend_before_recorded_discounts",
        "basket_discount_value": DISCOUNT,
        "basket_coupon_discount": COUPON,
        "basket_quantity_raw": "quantity_raw",
    }
    names, sizes = list_sizes(w, ("department", "commodity"))
    baskets = w["lines"].join(names, "product_id", "left").groupBy("basket_id").agg(
        *[F.max(c).alias(c) for c in carried],
        *[F.sum(F.expr(source)).alias(name) for name, source in sums.items()],
        F.count(F.lit(1)).alias("basket_line_count"),
        F.count_distinct("product_id").alias("basket_distinct_products"),
        sizes["department"].alias("basket_distinct_departments"),
        sizes["commodity"].alias("basket_distinct_commodities"),
        F.max(F.coalesce(F.expr(f"{COUPON} > 0"), F.lit(False))).alias("has_coupon_discount"),
        F.max("transaction_hour").alias("transaction_hour"),
    )
    return baskets.select(
        "basket_id",
        *carried,
        *[c for c in sums if c != "basket_quantity_raw"],
        "basket_line_count",
        "basket_distinct_products",
        "basket_quantity_raw",
        "basket_distinct_departments",
        "basket_distinct_commodities",
        "has_coupon_discount",
        "transaction_hour",
    )


@table("internal")
def trip_amounts(w):
    """Amounts per basket, household and week, written once; household scores and basket values read the
    lines only here.

    A basket is one row, unless the audits report it for several households or weeks. ``lead`` marks one row
    per basket; ``basket_household``, ``basket_net_spend`` and ``has_coupon_discount`` are those of ``fct_basket``.
    """
    keys = ("basket_id", "household_key", "week_number")
    sums = {
        "net_spend": "sales_value",
        "discount_value": "discount",
        "coupon_discount": "coupon_discount",
        "private_label_spend": "private_sales",
    }
    trips = w.spread(w["product_lines"], "basket_id").groupBy(*keys).agg(
        *[F.sum(c).cast("decimal(28,4)").alias(n) for n, c in sums.items()],
        F.max(F.coalesce(F.expr(f"{COUPON} > 0"), F.lit(False))).alias("_coupon"),
    )
    basket = Window.partitionBy("basket_id")
    first = basket.orderBy(F.col("household_key").asc_nulls_first(), F.col("week_number").asc_nulls_first())
    path = work_folder(w.spark, "trips")
    trips.select(
        *keys,
        *sums,
        F.max("household_key").over(basket).alias("basket_household"),
        F.sum("net_spend").over(basket).alias("basket_net_spend"),
        F.max("_coupon").over(basket).alias("has_coupon_discount"),
        (F.row_number().over(first) == 1).alias("lead"),
    ).write.option("compression", "zstd").parquet(path)
    return w.spark.read.parquet(path)


@table("fact")
def fct_promotion_product_store_week(w):
    on, mailed = F.col("is_on_display"), F.col("is_in_mailer")
    merged = (
        w["stg_promotion_state"]
        .groupBy("product_id", "store_id", "week_number")
        .agg(
            F.max(F.when(on, F.col("display_code")).otherwise("0")).alias("display_code"),
            F.max(F.when(mailed, F.col("mailer_code")).otherwise("0")).alias("mailer_code"),
            F.max("is_on_display").alias("is_on_display"),
            F.max("is_in_mailer").alias("is_in_mailer"),
        )
    )
    return merged.withColumn("promo_state_group", promo_state(on, mailed))


@table("internal")
def exposed_campaigns(w):
    """Distinct exposures with their campaign."""
    # Distinct pairs joined to distinct campaign rows stay distinct.
    return w["stg_campaign_exposure"].join(w["dim_campaign"], "campaign_id", "left")


@table("internal")
def campaign_redemptions(w):
    return w["stg_coupon_redemption"].groupBy("household_key", "campaign_id").agg(
        F.count(F.lit(1)).alias("redemption_count")
    )


@table("internal")
def redeeming_exposures(w):
    """Exposures with the redemption flag of ``mart_campaign_household``, for counts that need no trip and no
    segment: those are joined to the mart by unique keys and change no row."""
    keys = ["household_key", "campaign_id"]
    used = F.coalesce(F.col("redemption_count") > 0, F.lit(False))
    return w["exposed_campaigns"].join(w["campaign_redemptions"].hint("merge"), keys, "left").select(
        *keys, "campaign_type", used.alias("redeemed_coupon_flag")
    )


@table("fact")
def fct_campaign_exposure(w):
    r = w.rules
    seen = w.bounds
    first = F.lit(r.first_day if seen.first_day is None else seen.first_day)
    last = F.lit(r.last_day if seen.last_day is None else seen.last_day)
    start, end = F.col("start_day"), F.col("end_day")
    return w["exposed_campaigns"].select(
        "household_key",
        "campaign_id",
        "campaign_type",
        "start_day",
        "end_day",
        (start - r.pre_days >= first).alias("pre_28d_observable"),
        ((start >= first) & (end <= last)).alias("during_observable"),
        (end + r.post_short_days <= last).alias("post_14d_observable"),
        (end + r.post_days <= last).alias("post_28d_observable"),
    )


@table("fact")
def fct_coupon_redemption(w):
    event = (F.monotonically_increasing_id() + 1).alias("redemption_event_id")
    return w["stg_coupon_redemption"].select("*", event)


@table("fact")
def bridge_coupon_product_campaign(w):
    return w["stg_coupon_product"]
