"""Quality audits, layer reconciliation and the blocking gate."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from panelspark import fixed_text as text
from panelspark.functions.columns import mean_when, ratio
from panelspark.functions.ordering import pinned
from panelspark.functions.populations import Layer, Reference, layer_populations, stacked, unmatched
from panelspark.functions.quantiles import weighted_quantiles
from panelspark.operators.analysis import promotion_universe
from panelspark.plans.registry import LARGE_SOURCES, table
from panelspark.sources.contracts import CONTRACTS


def flagged(condition):
    """Rows meeting a condition; NULL over an empty table, so the gate cannot pass on it."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def repeats(*keys):
    """Rows beyond the first of each key. A struct keeps NULL parts comparable."""
    return F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))


def one_row_each(df, rows):
    """Turn a one-row frame of aggregates into one row per audit."""
    return df.select(F.explode(F.array(*[F.struct(*r) for r in rows])).alias("r")).select("r.*")


@table("quality")
def qa_source_reconciliation(w):
    keys = {
        "transaction_data": ("household_key", ["BASKET_ID"]),
        "causal_data": (None, ["PRODUCT_ID", "STORE_ID", "WEEK_NO"]),
        "coupon": (None, ["COUPON_UPC", "PRODUCT_ID", "CAMPAIGN"]),
        "coupon_redempt": ("household_key", ["household_key", "DAY", "COUPON_UPC", "CAMPAIGN"]),
        "campaign_table": ("household_key", ["household_key", "CAMPAIGN"]),
        "campaign_desc": ("CAMPAIGN", ["CAMPAIGN"]),
        "product": ("PRODUCT_ID", ["PRODUCT_ID"]),
        "hh_demographic": ("household_key", ["household_key"]),
    }
    frames = []
    for source, (people, key) in keys.items():
        found = F.count_distinct(F.struct(*key)) if len(key) > 1 else F.count_distinct(*key)
        frames.append(
            w.raw(source).agg(
                F.lit(source).alias("source_name"),
                F.count(F.lit(1)).alias("row_count"),
                (F.count_distinct(people) if people else F.lit(0).cast("bigint")).alias(
                    "households"
                ),
                found.alias("baskets"),
            )
        )
    return stacked(frames)


@table("quality")
def qa_key_audit(w):
    def audit(name, model, *keys):
        extra = (
            repeats(*keys) if len(keys) > 1 else F.count(F.lit(1)) - F.count_distinct(keys[0])
        )
        return w[model].agg(F.lit(name).alias("model"), extra.alias("duplicate_rows"))

    return stacked(
        [
            audit("product", "dim_product", "product_id"),
            audit("household", "dim_household", "household_key"),
            audit(
                "promotion_product_store_week",
                "fct_promotion_product_store_week",
                "product_id",
                "store_id",
                "week_number",
            ),
            audit("campaign_exposure", "fct_campaign_exposure", "household_key", "campaign_id"),
            audit(
                "coupon_bridge",
                "bridge_coupon_product_campaign",
                "coupon_upc",
                "product_id",
                "campaign_id",
            ),
        ]
    )


@table("quality")
def qa_grain_audit(w):
    """More than one distinct value per basket means its smallest differs from its largest."""
    checked = ("household", "day", "store")
    columns = {"household": "household_key", "day": "day_key", "store": "store_id"}
    spans = w["stg_transaction"].groupBy("basket_id").agg(
        *[(F.min(columns[c]) != F.max(columns[c])).alias(c) for c in checked]
    )
    counts = spans.agg(*[F.count_if(c).alias(c) for c in checked])
    return one_row_each(
        counts,
        [
            (F.lit(f"basket_{c}_consistency").alias("audit_name"), F.col(c).alias("violating_baskets"))
            for c in checked
        ],
    )


@table("quality")
def qa_discount_audit(w):
    kinds = ("retail", "coupon", "coupon_match")
    return w["stg_transaction"].agg(
        F.count(F.lit(1)).alias("transaction_lines"),
        *[flagged(F.col(f"{k}_disc_raw") > 0).alias(f"positive_{k}_disc_rows") for k in kinds],
        *[F.sum(f"{k}_discount_value").alias(f"{k}_discount_value") for k in kinds],
    )


@table("quality")
def qa_quantity_audit(w):
    # Quantities collapse to value counts first; the quantiles are placed across the cluster.
    counts = pinned(
        w["flagged_lines"].groupBy("quantity_raw").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("quantity_outlier_flag").alias("odd")
        )
    )
    shares = {"p50_quantity": 0.50, "p95_quantity": 0.95, "p99_quantity": 0.99}
    known = counts.where(F.col("quantity_raw").isNotNull())
    at = pinned(weighted_quantiles(known, [], "quantity_raw", "n", shares))
    return counts.agg(
        F.sum("n").alias("transaction_lines"),
        F.sum(F.when(F.col("quantity_raw") <= 0, F.col("n")).otherwise(0)).alias(
            "non_positive_quantity_rows"
        ),
        F.min("quantity_raw").alias("min_quantity"),
        F.max("quantity_raw").alias("max_quantity"),
        F.sum("odd").alias("flagged_outlier_rows"),
    ).select(
        "transaction_lines",
        "non_positive_quantity_rows",
        "min_quantity",
        "max_quantity",
        *[at.select(name).scalar().alias(name) for name in shares],
        "flagged_outlier_rows",
    )


@table("quality")
def qa_campaign_observability(w):
    phases = ("pre_28d", "during", "post_14d", "post_28d")
    return w["fct_campaign_exposure"].groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("recipient_rows"),
        *[flagged(F.col(f"{p}_observable")).alias(f"{p}_observable_rows") for p in phases],
        F.min("start_day").alias("start_day"),
        F.max("end_day").alias("end_day"),
    )


@table("quality")
def qa_demographic_coverage(w):
    totals = w["household_week_spend"].groupBy("household_key").agg(
        F.sum("net_spend").alias("spend"), F.sum("baskets").alias("trips")
    )
    known = F.col("has_demographics")
    return (
        w["dim_household"]
        .join(totals, "household_key", "left")
        .agg(
            F.count(F.lit(1)).alias("observed_households"),
            flagged(known).alias("households_with_demographics"),
            flagged(~known).alias("households_without_demographics"),
            ratio(flagged(known), F.count(F.lit(1))).alias("demographic_coverage_pct"),
            mean_when(known, "spend").alias("avg_spend_covered"),
            mean_when(~known, "spend").alias("avg_spend_uncovered"),
            mean_when(known, "trips").alias("avg_baskets_covered"),
            mean_when(~known, "trips").alias("avg_baskets_uncovered"),
        )
    )


@table("quality")
def qa_reference_coverage(w):
    exposure = (
        ("campaign_exposure_unmatched", "campaign_id", "campaign"),
        ("campaign_household_unmatched", "household_key", "household"),
    )
    redemption = (
        ("coupon_redemption_unmatched", "coupon_upc", "coupon"),
        ("coupon_redemption_household_unmatched", "household_key", "household"),
        ("coupon_redemption_campaign_unmatched", "campaign_id", "campaign"),
    )
    of_product = ("product_id", "product")
    references = [
        Reference(w["stg_transaction"], [("transaction_product_unmatched", *of_product)]),
        Reference(w["fct_promotion_product_store_week"], [("promotion_product_unmatched", *of_product)]),
        Reference(w["fct_campaign_exposure"], exposure),
        Reference(w["stg_coupon_redemption"], redemption),
        Reference(w["bridge_coupon_product_campaign"], [("coupon_bridge_product_unmatched", *of_product)]),
    ]
    members = [
        ("product", w["dim_product"], "product_id"),
        ("campaign", w["dim_campaign"], "campaign_id"),
        ("coupon", w["dim_coupon"], "coupon_upc"),
        ("household", w["dim_household"], "household_key"),
    ]
    found = unmatched(references, members)
    return one_row_each(
        found, [(F.lit(c).alias("audit_name"), F.col(c).alias("violating_rows")) for c in found.columns]
    )


#: Audit name, measured column, rule text.
ANOMALIES = (
    (
        "day_range",
        "day_key",
        "DAY must be a positive observation index; 1–711 is the planning range; "
        "retain and review deviations",
    ),
    (
        "week_range",
        "week_number",
        "WEEK_NO must be a positive observation index; 1–102 is the planning range; "
        "retain and review deviations",
    ),
    (
        "sales_negative",
        "sales_value",
        "Investigate negative SALES_VALUE; never delete before review",
    ),
    ("sales_zero", "sales_value", "Retain zero SALES_VALUE rows and explain their context"),
    (
        "quantity_non_positive",
        "quantity_raw",
        "Preserve raw quantity and flag non-positive values",
    ),
    (
        "quantity_outlier",
        "quantity_raw",
        "Use percentile flag; never silently cap source quantity",
    ),
    ("trans_time_invalid", "trans_time", "TRANS_TIME must be a valid HHMM observation"),
    ("missing_product", None, "PRODUCT_ID is required for line-level product analysis"),
    ("missing_household", None, "household_key is required for panel and customer analysis"),
    ("missing_basket", None, "basket_id is required for trip and basket analysis"),
)


@table("quality")
def qa_transaction_anomalies(w):
    r = w.rules
    day, week, sales = F.col("day_key"), F.col("week_number"), F.col("sales_value")
    quantity, time = F.col("quantity_raw"), F.col("trans_time")
    broken = {
        "day_range": day.isNull() | (day < r.first_day) | (day > r.last_day),
        "week_range": week.isNull() | (week < r.first_week) | (week > r.last_week),
        "sales_negative": sales < 0,
        "sales_zero": sales == 0,
        "quantity_non_positive": quantity.isNull() | (quantity <= 0),
        "quantity_outlier": F.col("quantity_outlier_flag"),
        "trans_time_invalid": time.isNull() | (time < 0) | (time > 2359) | (time % 100 > 59),
        "missing_product": F.col("product_id").isNull(),
        "missing_household": F.col("household_key").isNull(),
        "missing_basket": F.col("basket_id").isNull(),
    }
    measured = ("day_key", "week_number", "sales_value", "quantity_raw", "trans_time")
    # One scan answers every audit.
    seen = w["flagged_lines"].agg(
        *[flagged(c).alias(name) for name, c in broken.items()],
        *[f(c).alias(f"_{n}_{c}") for c in measured for n, f in (("min", F.min), ("max", F.max))],
    )

    def shown(which, c):
        if c is None:
            return F.lit(None).cast("string")
        value = F.col(f"_{which}_{c}")
        return (value.cast("double") if c == "sales_value" else value).cast("string")

    return one_row_each(
        seen,
        [
            (
                F.lit(name).alias("audit_name"),
                shown("min", c).alias("observed_min"),
                shown("max", c).alias("observed_max"),
                F.col(name).alias("violating_rows"),
                F.lit(rule).alias("rule"),
            )
            for name, c, rule in ANOMALIES
        ],
    )


@table("quality")
def qa_layer_reconciliation(w):
    """The transaction fact is ``lines`` with a flag and an id, which take no part here."""
    raw = w.raw
    full = ("household_key", "basket_id", "sales_value")
    people = ("household_key",)
    layers = {
        "raw_lines": Layer(raw("transaction_data"), "household_key", "BASKET_ID", "SALES_VALUE"),
        "stg_lines": Layer(w["stg_transaction"], *full),
        "fct_lines": Layer(w["lines"], *full),
        "baskets": Layer(w["fct_basket"], "household_key", "basket_id", "basket_net_spend"),
        "raw_causal": Layer(raw("causal_data").select("PRODUCT_ID", "STORE_ID", "WEEK_NO").distinct()),
        "promotions": Layer(w["fct_promotion_product_store_week"]),
        "raw_redemptions": Layer(raw("coupon_redempt"), *people),
        "redemptions": Layer(w["fct_coupon_redemption"], *people),
        "raw_exposures": Layer(raw("campaign_table"), *people),
        "exposures": Layer(w["fct_campaign_exposure"], *people),
        "raw_campaigns": Layer(raw("campaign_desc")),
        "campaigns": Layer(w["dim_campaign"]),
        "raw_products": Layer(raw("product")),
        "products": Layer(w["dim_product"]),
        "raw_coupons": Layer(raw("coupon")),
        "coupon_links": Layer(w["bridge_coupon_product_campaign"]),
    }
    checks = (
        ("transaction_raw_vs_staging", "equal_rows_population_and_sales", "raw_lines", "stg_lines"),
        ("transaction_staging_vs_fact", "equal_rows_population_and_sales", "stg_lines", "fct_lines"),
        ("transaction_fact_vs_basket", "equal_population_and_sales_aggregation", "fct_lines", "baskets"),
        ("causal_raw_vs_promotion_fact", "distinct_product_store_week_grain", "raw_causal", "promotions"),
        ("redemption_raw_vs_fact", "equal_rows", "raw_redemptions", "redemptions"),
        ("campaign_exposure_raw_vs_fact", "equal_rows_and_population", "raw_exposures", "exposures"),
        ("campaign_desc_raw_vs_dimension", "equal_rows", "raw_campaigns", "campaigns"),
        ("product_raw_vs_dimension", "deduplication_expected", "raw_products", "products"),
        ("coupon_raw_vs_bridge", "deduplication_expected", "raw_coupons", "coupon_links"),
    )
    found = layer_populations(list(layers.values())).withColumnRenamed("amount", "sales")
    # sixteen rows, gathered so that every check picks its two
    all_ = found.agg(
        F.map_from_entries(
            F.collect_list(F.struct("layer", F.struct("rows", "households", "baskets", "sales")))
        ).alias("layers")
    )
    at = list(layers)
    rows = all_.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("audit_name"),
                        F.lit(rule).alias("reconciliation_rule"),
                        F.col("layers")[at.index(up)].alias("u"),
                        F.col("layers")[at.index(down)].alias("d"),
                    )
                    for name, rule, up, down in checks
                ]
            )
        ).alias("r")
    ).select("r.*")

    def same(part):
        return F.col(f"u.{part}") == F.col(f"d.{part}")

    zero = F.lit(0).cast("decimal(38,4)")
    close = F.abs(F.coalesce("d.sales", zero) - F.coalesce("u.sales", zero)) <= F.lit(0.01).cast(
        "decimal(5,2)"
    )
    people = same("households") & same("baskets") & close
    rule = F.col("reconciliation_rule")
    passed = (
        ((rule == "equal_rows_population_and_sales") & same("rows") & people)
        | ((rule == "equal_population_and_sales_aggregation") & people)
        | ((rule == "equal_rows") & same("rows"))
        | ((rule == "distinct_product_store_week_grain") & same("rows"))
        | ((rule == "equal_rows_and_population") & same("rows") & same("households"))
        | ((rule == "deduplication_expected") & (F.col("d.rows") <= F.col("u.rows")))
    )
    names = {"rows": "row", "households": "household", "baskets": "basket", "sales": "sales"}
    columns = []
    for part, short in names.items():
        columns += [
            F.col(f"u.{part}").alias(f"upstream_{part}"),
            F.col(f"d.{part}").alias(f"downstream_{part}"),
            (F.col(f"d.{part}") - F.col(f"u.{part}")).alias(f"{short}_difference"),
        ]
    return rows.select(
        "audit_name",
        "reconciliation_rule",
        *columns,
        F.when(passed, "pass").otherwise("review").alias("status"),
    )


def blank(c):
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def not_whole(c):
    return F.col(c).try_cast("bigint").isNull()


def orphans(rows, other, keys):
    """Rows whose key is absent on the other side, collapsed to key counts first."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(other.select(*keys), list(keys), "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    )


#: Fixed values: (source, check) -> severity and rule text, in report order.
CONTRACT_RULES = {
    ("transaction_data", "required_household_key"): ("block", "household_key must be non-null"),
    ("transaction_data", "required_basket_id"): (
        "block",
        "BASKET_ID must be non-null and non-blank",
    ),
    ("transaction_data", "required_product_id"): (
        "block",
        "PRODUCT_ID must be non-null and numeric",
    ),
    ("transaction_data", "required_store_id"): ("block", "STORE_ID must be non-null and numeric"),
    ("transaction_data", "required_sales_value"): (
        "block",
        "SALES_VALUE must be non-null and numeric",
    ),
    ("transaction_data", "required_observation_index"): (
        "block",
        "DAY and WEEK_NO must be positive observation indexes",
    ),
    ("transaction_data", "duplicate_raw_rows"): (
        "warning",
        "Exact duplicate raw lines are retained and reported for review",
    ),
    ("product", "duplicate_product_id"): (
        "block",
        "PRODUCT_ID must be unique in the product dimension source",
    ),
    ("product", "required_category_attributes"): (
        "warning",
        "Missing DEPARTMENT/COMMODITY_DESC is retained as Unknown in the governed category "
        "dimension",
    ),
    ("product", "required_brand_flag"): (
        "warning",
        "BRAND is preserved as Unknown when source coverage is missing",
    ),
    ("product", "invalid_brand_domain"): (
        "block",
        "BRAND must use the source domains Private or National; staging normalizes them to "
        "PRIVATE/NATIONAL",
    ),
    ("campaign_desc", "duplicate_campaign_id"): (
        "block",
        "CAMPAIGN must be unique in campaign description source",
    ),
    ("campaign_desc", "invalid_campaign_window"): (
        "block",
        "Campaign end must be on or after start within the observation index",
    ),
    ("campaign_table", "duplicate_campaign_exposure"): (
        "block",
        "household x campaign exposure must be unique",
    ),
    ("campaign_table", "recipient_without_campaign"): (
        "block",
        "Every recipient row must map to a campaign description",
    ),
    ("coupon", "coupon_without_product"): (
        "block",
        "Every coupon product mapping must map to a product",
    ),
    ("coupon", "coupon_without_campaign"): (
        "block",
        "Every coupon mapping must map to a campaign",
    ),
    ("coupon", "duplicate_coupon_product_campaign"): (
        "warning",
        "Raw coupon relationship repeats are collapsed to a distinct coupon x product x campaign "
        "bridge",
    ),
    ("coupon_redempt", "duplicate_redemption_event"): (
        "warning",
        "Exact redemption-event duplicates are retained and reported for review",
    ),
    ("coupon_redempt", "redemption_without_coupon_mapping"): (
        "block",
        "Every redemption must map to a coupon x campaign record",
    ),
    ("causal_data", "duplicate_product_store_week"): (
        "warning",
        "Raw promotion rows may contain multiple codes at product x store x week; the modeled "
        "fact aggregates them at that grain",
    ),
    ("causal_data", "unsupported_promotion_codes"): (
        "block",
        "display and mailer must use the official source code domains; any non-zero code means "
        "the activity is on",
    ),
}


@table("quality")
def qa_source_contract_audit(w):
    raw = w.raw
    day, week = F.col("DAY").try_cast("bigint"), F.col("WEEK_NO").try_cast("bigint")
    start, end = F.col("START_DAY").try_cast("bigint"), F.col("END_DAY").try_cast("bigint")
    brand = F.lower(F.trim(F.col("BRAND").cast("string")))
    codes = CONTRACTS["causal_data"].allowed
    in_scan = {
        "transaction_data": {
            "required_household_key": F.count_if(not_whole("household_key")),
            "required_basket_id": F.count_if(blank("BASKET_ID")),
            "required_product_id": F.count_if(not_whole("PRODUCT_ID")),
            "required_store_id": F.count_if(not_whole("STORE_ID")),
            "required_sales_value": F.count_if(F.col("SALES_VALUE").try_cast("double").isNull()),
            "required_observation_index": F.count_if(
                day.isNull() | week.isNull() | (day < 1) | (week < 1)
            ),
            "duplicate_raw_rows": repeats(*CONTRACTS["transaction_data"].columns),
        },
        "product": {
            "duplicate_product_id": F.count(F.lit(1))
            - F.count_distinct(F.col("PRODUCT_ID").try_cast("bigint")),
            "required_category_attributes": F.count_if(
                blank("DEPARTMENT") | blank("COMMODITY_DESC")
            ),
            "required_brand_flag": F.count_if(blank("BRAND")),
            "invalid_brand_domain": F.count_if(~brand.isin(*CONTRACTS["product"].allowed["BRAND"])),
        },
        "campaign_desc": {
            "duplicate_campaign_id": F.count(F.lit(1))
            - F.count_distinct(F.col("CAMPAIGN").try_cast("bigint")),
            "invalid_campaign_window": F.count_if(
                start.isNull() | end.isNull() | (start < 1) | (end < start)
            ),
        },
        "campaign_table": {"duplicate_campaign_exposure": repeats("household_key", "CAMPAIGN")},
        "coupon": {
            "duplicate_coupon_product_campaign": repeats("COUPON_UPC", "PRODUCT_ID", "CAMPAIGN")
        },
        "coupon_redempt": {
            "duplicate_redemption_event": repeats("household_key", "DAY", "COUPON_UPC", "CAMPAIGN")
        },
        "causal_data": {
            "duplicate_product_store_week": repeats("PRODUCT_ID", "STORE_ID", "WEEK_NO"),
            "unsupported_promotion_codes": F.count_if(
                ~F.col("display").cast("string").isin(*codes["display"])
                | ~F.col("mailer").cast("string").isin(*codes["mailer"])
            ),
        },
    }
    lookups = {
        ("campaign_table", "recipient_without_campaign"): ("campaign_desc", ["DESCRIPTION"]),
        ("coupon", "coupon_without_product"): ("product", ["PRODUCT_ID"]),
        ("coupon", "coupon_without_campaign"): ("campaign_desc", ["CAMPAIGN"]),
        ("coupon_redempt", "redemption_without_coupon_mapping"): (
            "coupon",
            ["COUPON_UPC", "CAMPAIGN"],
        ),
    }
    frames = []
    for source, checks in in_scan.items():
        # All checks of one source share one scan.
        measured = raw(source).agg(*[c.cast("bigint").alias(n) for n, c in checks.items()])
        frames.append(
            one_row_each(
                measured,
                [
                    (
                        F.lit(source).alias("source_name"),
                        F.lit(n).alias("check_name"),
                        F.col(n).alias("violating_rows"),
                    )
                    for n in checks
                ],
            )
        )
    for (source, check), (other, keys) in lookups.items():
        frames.append(
            orphans(raw(source), raw(other), keys).select(
                F.lit(source).alias("source_name"),
                F.lit(check).alias("check_name"),
                F.col("n").alias("violating_rows"),
            )
        )
    key = F.concat_ws(".", "source_name", "check_name")
    severity, rule = F.lit("block"), F.lit(None).cast("string")
    for (source, check), (level, words) in CONTRACT_RULES.items():
        here = key == f"{source}.{check}"
        severity, rule = F.when(here, level).otherwise(severity), F.when(here, words).otherwise(rule)
    return stacked(frames).select(
        "source_name",
        "check_name",
        "violating_rows",
        severity.alias("severity"),
        F.when(F.col("violating_rows") == 0, "PASS").otherwise("REVIEW").alias("status"),
        rule.alias("rule"),
    )


@table("quality")
def promotion_universe_raw_audit(w):
    off = (F.col("display").cast("string") == "0") & (F.col("mailer").cast("string") == "0")
    key = F.struct("PRODUCT_ID", "STORE_ID", "WEEK_NO")
    raw = w.raw("causal_data").agg(
        F.struct(
            F.count(F.lit(1)).alias("raw_total_rows"),
            F.count_if(off).alias("raw_zero_zero_rows"),
            F.count_distinct(F.when(off, key)).alias("raw_zero_zero_keys"),
        )
    ).scalar()
    kept, seen = F.col("none_rows") > 0, F.col("raw.raw_zero_zero_rows") == 0
    case = (
        F.when(kept, "RECOVERED_MODELED_NONE")
        .when(seen, "CASE_A_RAW_PROMOTED_ROWS_ONLY")
        .otherwise("CASE_B_RAW_ZERO_ZERO_NOT_RETAINED")
    )
    modeled = promotion_universe(w)
    return modeled.withColumn("raw", raw).select(
        "raw.*",
        *modeled.columns,
        F.when(kept, "RECOVERED").otherwise("NOT_OBSERVED").alias("none_state_status"),
        case.alias("recovery_case"),
        kept.alias("valid_none_for_uplift"),
        F.lit(text.PROMOTION_AUDIT).alias("interpretation_boundary"),
    )


#: Tables a release must contain.
REQUIRED_ASSETS = (
    "dim_category",
    "dim_segment",
    "mart_store_weekly",
    "mart_category_household_weekly",
    "analysis_campaign_denominators",
    "analysis_promotion_universe_audit",
    "analysis_root_cause_lmdi",
    "analysis_category_materiality",
    "analysis_category_lmdi",
    "analysis_segment_stability",
    "analysis_first_observed_cohort",
    "analysis_demographic_summary",
)


@table("quality")
def governed_asset_audit(w):
    """Rows of every required asset. A table that a build has written is known by the count of its write;
    only others are counted."""
    rows = []
    for name in REQUIRED_ASSETS:

        def row(df, n, status, error=""):
            asset = (F.lit(name).alias("asset"), F.lit(name).alias("relation"))
            return df.agg(
                *asset, n.alias("row_count"), status.alias("status"), F.lit(error).alias("error")
            )

        n = F.count(F.lit(1))
        try:
            if name in w.written:
                source, n = w.spark.range(0), F.lit(w.written[name]).cast("bigint")
            else:
                source = w[name]
            rows.append(row(source, n, F.when(n > 0, "PASS").otherwise("REVIEW")))
        except AnalysisException as problem:
            rows.append(row(w.spark.range(0), F.lit(0).cast("bigint"), F.lit("FAIL"), str(problem)))
    rows.append(
        w["analysis_promotion_universe_audit"].select(
            F.lit("promotion_universe_interpretation").alias("asset"),
            F.lit("analysis_promotion_universe_audit").alias("relation"),
            F.col("total_rows").alias("row_count"),
            F.lit("PASS").alias("status"),
            F.concat_ws(": ", "none_state_status", "interpretation_boundary").alias("error"),
        )
    )
    return stacked(rows)


#: Fixed values. Gate inputs: table -> (name column, value column, reason).
GATE = {
    "qa_key_audit": ("model", "duplicate_rows", "duplicate_key_rows"),
    "qa_grain_audit": ("audit_name", "violating_baskets", "basket_grain_inconsistency"),
    "qa_reference_coverage": ("audit_name", "violating_rows", "unmatched_reference"),
    "qa_layer_reconciliation": ("audit_name", "status", "layer_reconciliation_review"),
    "qa_transaction_anomalies": (
        "audit_name",
        "violating_rows",
        "transaction_anomaly_retained_for_review",
    ),
    "qa_source_contract_audit": ("check_name", "violating_rows", "source_contract_review"),
}
#: Fixed values.
BLOCKING_ANOMALIES = ("missing_product", "missing_household", "missing_basket")


def gate_findings(spark, tables):
    """Every failure and warning in the audit tables, whatever builds those tables."""
    out = []

    def fixed(name, reason, value=None):
        return spark.range(1).select(
            F.lit(name).alias("source_table"),
            F.lit(None).cast("string").alias("audit_name"),
            F.lit(value).cast("string").alias("value"),
            F.lit(reason).alias("reason"),
            F.lit("fail").alias("level"),
        )

    for name, (key, measure, reason) in GATE.items():
        df = tables.get(name)
        if df is None:
            out.append(fixed(name, "missing_quality_output"))
            continue
        needed = {key, measure} | ({"severity"} if name == "qa_source_contract_audit" else set())
        absent = sorted(needed - set(df.columns))
        if absent:
            out.append(fixed(name, "missing_quality_columns", "|".join(absent)))
            continue
        value = F.col(measure).cast("string")
        number = value.try_cast("double")
        if name == "qa_layer_reconciliation":
            bad = F.coalesce(F.lower(F.trim(value)) != "pass", F.lit(True))
            why = F.lit(reason)
        else:
            bad = number.isNull() | (number > 0)
            why = F.when(number.isNull(), "invalid_quality_number").otherwise(reason)
        blocks = F.lit(True)
        if name == "qa_transaction_anomalies":
            blocks = F.col(key).isin(*BLOCKING_ANOMALIES)
        elif name == "qa_source_contract_audit":
            severity = F.coalesce(F.lower(F.trim(F.col("severity"))), F.lit(""))
            blocks = severity == "block"
        level = F.when(blocks | (why == "invalid_quality_number"), "fail").otherwise("warning")
        out.append(
            df.where(bad).select(
                F.lit(name).alias("source_table"),
                F.col(key).alias("audit_name"),
                value.alias("value"),
                why.alias("reason"),
                level.alias("level"),
            )
        )
        out.append(
            df.agg(F.count(F.lit(1)).alias("n"))
            .where("n = 0")
            .select(
                F.lit(name).alias("source_table"),
                F.lit(None).cast("string").alias("audit_name"),
                F.lit(None).cast("string").alias("value"),
                F.lit("empty_quality_output").alias("reason"),
                F.lit("fail").alias("level"),
            )
        )
    return stacked(out)


@table("quality")
def quality_gate_findings(w):
    # Each audit enters twice (its findings, and whether it has rows), so it is worked out once and
    # kept: tens of rows each. All read the same lines and promotion states, which are derived once;
    # of the baskets the audits need amounts only.
    kept = w.stored(LARGE_SOURCES + ("products", "fct_promotion_product_store_week"))
    return gate_findings(w.spark, {name: pinned(kept[name]) for name in GATE})


def gate_verdict(findings):
    failures = F.count_if(F.col("level") == "fail")
    return findings.agg(
        (failures == 0).alias("ready"),
        F.lit(len(GATE)).cast("bigint").alias("checked_tables"),
        failures.alias("failures"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
    )


@table("quality")
def quality_gate(w):
    return gate_verdict(w["quality_gate_findings"])
