"""Governed measures: named aggregates, evaluated for any filter and grouping.

A measure belongs to one table. Ratios are recomputed from the filtered rows, never averaged,
and distinct households are recounted for the chosen weeks. Segment labels come with the rows and
are not recomputed by a filter.
"""

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.columns import mean, mean_ratio, ratio
from panelspark.functions.populations import Reference, unmatched
from panelspark.operators.facts import named_categories
from panelspark.operators.marts import redeemer, week_bounds
from panelspark.operators.quality import stacked
from panelspark.plans.registry import table
from panelspark.sources.files import work_folder


@dataclass(frozen=True)
class Measure:
    name: str
    table: str
    value: Column


def _only(flag, c):
    return F.when(F.col(flag), F.col(c))


def registry():
    """Every measure that needs no context beyond its own table."""
    spend, households = F.sum("basket_net_spend"), F.count_distinct("household_key")
    # a basket is one row of mart_basket
    baskets, gross = F.count("basket_id"), F.sum("basket_gross_spend")
    discount = F.sum("basket_discount_value")
    coupon_baskets = F.count(_only("has_coupon_discount", "basket_id"))
    driver_check = (
        households.cast("double") * ratio(baskets, households) * ratio(spend, baskets)
    )
    own = F.sum(
        F.when(F.col("brand_type") == "PRIVATE", F.col("panel_net_spend")).otherwise(
            F.lit(0).cast("decimal(38,4)")
        )
    )
    cells, sales = F.sum("product_store_weeks"), F.sum("panel_sales")
    promoted = F.col("promo_state_group") != "none"
    both = F.col("promo_state_group") == "display_and_mailer"
    redeemed = F.count_if("redeemed_coupon_flag")
    in_tables = {
        "mart_basket": {
            "Panel Net Spend": spend,
            "Panel Gross Spend": gross,
            "Total Recorded Discount": discount,
            "Discount Rate": ratio(discount, gross),
            "Baskets": baskets,
            "Active Panel Households": households,
            "Spend per Basket": ratio(spend, baskets),
            "Trips per Active Household": ratio(baskets, households),
            "Spend per Active Household": ratio(spend, households),
            "Spend Driver Check": driver_check,
            "Coupon Baskets": coupon_baskets,
            "Coupon Basket Rate": ratio(coupon_baskets, baskets),
        },
        "mart_panel_weekly": {
            "Private Label Spend": F.sum("private_label_spend"),
            "Private Label Share": ratio(F.sum("private_label_spend"), F.sum("panel_net_spend")),
        },
        "analysis_category_penetration": {
            "Category Household Penetration": ratio(
                F.sum("buying_households"), F.sum("panel_households")
            ),
        },
        "mart_campaign_household": {
            "Campaign Recipients": households,
            "Campaign Redeemers": F.count_distinct(redeemer()),
            "Campaign Redemption Rate": ratio(F.count_distinct(redeemer()), households),
            "Campaign-Household Exposures": F.count(F.lit(1)),
            "Redeeming Exposures": redeemed,
            "Exposure Redemption Rate": ratio(redeemed, F.count(F.lit(1))),
        },
        "mart_decision_alerts": {"Decision Alert Count": F.count(F.lit(1))},
        "mart_category_household_weekly": {"Dynamic Category Buying Households": households},
        "mart_store_weekly": {
            "Store Panel Net Spend": F.sum("panel_net_spend"),
            "Store Baskets": F.sum("baskets"),
        },
        "root_cause_drivers": {
            "Root Cause Spend Contribution": F.sum("spend_change_contribution"),
            "Root Cause Contribution Share": F.sum("contribution_share"),
        },
        "mart_category_weekly": {
            "Category Spend": F.sum("panel_net_spend"),
            "Category Baskets": F.sum("category_baskets"),
            "Category Buyers": F.sum("buying_households"),
            "Category Penetration": ratio(
                F.sum("buying_households"), F.sum("active_panel_households")
            ),
            "Spend per Category Basket": ratio(F.sum("panel_net_spend"), F.sum("category_baskets")),
        },
        "mart_brand_category": {
            "Brand Private Label Spend": own,
            "Brand Private Label Share": ratio(own, F.sum("panel_net_spend")),
        },
        "mart_promotion_category_week": {
            "Promo Product-Store-Weeks": cells,
            "Promo Panel Sales": sales,
            "Promo Sales per PSW": mean_ratio(ratio("panel_sales", "product_store_weeks")),
            "Promoted State Sales Share": ratio(F.sum(F.when(promoted, F.col("panel_sales"))), sales),
            "Promotion Dependency": ratio(
                F.sum(F.when(promoted, F.col("product_store_weeks"))), cells
            ),
            "Display + Mailer Activity": ratio(
                F.sum(F.when(both, F.col("product_store_weeks"))), cells
            ),
        },
        "mart_campaign_summary": {
            "Summed Campaign Recipients": F.sum("campaign_recipients"),
            "Summed Campaign Redeemers": F.sum("campaign_redeemers"),
            "Summed Campaign Redemption Rate": ratio(
                F.sum("campaign_redeemers"), F.sum("campaign_recipients")
            ),
            "Avg Pre 28d Spend": mean_ratio("avg_pre_28d_spend"),
            "Avg During Spend": mean_ratio("avg_during_spend"),
            "Avg Post 28d Spend": mean_ratio("avg_post_28d_spend"),
        },
    }
    return {n: Measure(n, t, c) for t, measures in in_tables.items() for n, c in measures.items()}


#: The core measures.
CORE = (
    "Panel Net Spend",
    "Panel Gross Spend",
    "Total Recorded Discount",
    "Discount Rate",
    "Baskets",
    "Active Panel Households",
    "Spend per Basket",
    "Trips per Active Household",
    "Spend per Active Household",
    "Spend Driver Check",
    "Private Label Spend",
    "Private Label Share",
    "Coupon Baskets",
    "Coupon Basket Rate",
    "Category Household Penetration",
    "Campaign Recipients",
    "Campaign Redeemers",
    "Campaign Redemption Rate",
    "Decision Alert Count",
)


_ATTRIBUTE = re.compile(r"\b(dim_\w+)\.(\w+)\b")
#: an attribute once it stands beside a table's own columns
_JOINED = re.compile(r"\b(dim_[a-z]+)__(\w+)\b")


class UnreachableError(ValueError):
    """A dimension's filter does not flow to the tables of some measures."""


def _star_key(dim, source):
    return next(k for (d, k), facts in RELATIONSHIPS.items() if d == dim and source in facts)


def _members(w, dim, source, columns):
    """A dimension's key as ``_member`` and some attributes as ``dim__attribute``."""
    named = [F.col(c).alias(f"{dim}__{c}") for c in dict.fromkeys(columns)]
    return w[dim].select(F.col(_star_key(dim, source)).alias("_member"), *named)


def with_attributes(w, source, rows, attributes):
    """Rows of a table with attributes (dimension, column) along the star's relationships.

    Every dimension is joined once, on its key; rows without a member get NULL.
    """
    wanted = {}
    for dim, column in attributes:
        wanted.setdefault(dim, []).append(column)
    for dim, columns in wanted.items():
        same = F.col(_star_key(dim, source)) == F.col("_member")
        rows = rows.join(_members(w, dim, source, columns), same, "left").drop("_member")
    return rows


def key_filtered(w, source, rows, condition):
    """``rows`` under a condition on one dimension's attributes, as a filter on the table's key.

    No attribute is joined: keys of fitting members are kept (semi-join), or, where the condition also
    holds for a row without a member, keys of the other members dropped (anti-join). None if the condition
    needs more than one table.
    """
    named = sorted(set(_JOINED.findall(str(condition))))
    if len({dim for dim, _ in named}) != 1:
        return None
    dim, columns = named[0][0], [c for _, c in named]
    members = _members(w, dim, source, columns)
    try:
        blank = w.spark.range(1).select(
            *[F.lit(None).cast(members.schema[f"{dim}__{c}"].dataType).alias(f"{dim}__{c}") for c in columns]
        )
        keeps_strays = not blank.where(condition).isEmpty()
    except AnalysisException:  # it names columns of the table itself, too
        return None
    fits = F.coalesce(condition, F.lit(False))
    chosen = members.where(~fits if keeps_strays else fits).select("_member")
    how = "left_anti" if keeps_strays else "left_semi"
    return rows.join(chosen, F.col(_star_key(dim, source)) == F.col("_member"), how)


def evaluate(w, names, by=(), where=None):
    """Long rows (``by`` columns, measure, value); one aggregation per table involved.

    ``where`` is a condition or a list of them, each SQL text or a Column. ``by`` and texts may name
    attributes of a dimension (``dim_household.age_desc``; in a Column ``dim_household__age_desc``); they
    reach a measure's table along the star's relationships and leave under their own name. A condition on
    attributes of one dimension filters the table's keys before anything is joined or summed; one that mixes
    tables is applied after joining what it names, so give parts of an AND as a list. Measures that an
    attribute cannot reach are reported by an :class:`UnreachableError`.
    """
    known = registry()
    given = [] if where is None else list(where) if isinstance(where, list | tuple) else [where]
    given = [F.expr(_ATTRIBUTE.sub(r"\1__\2", c)) if isinstance(c, str) else c for c in given]
    asked = [m for c in by for m in _ATTRIBUTE.findall(c)]
    reached = [*asked, *(m for c in given for m in _JOINED.findall(str(c)))]
    lost = [
        n for n in names for dim, _ in reached
        if not any(d == dim and known[n].table in facts for (d, _), facts in RELATIONSHIPS.items())
    ]
    if lost:
        raise UnreachableError(f"not reached by the dimensions asked for: {sorted(set(lost))}")
    per_table = {}
    for name in names:
        per_table.setdefault(known[name].table, []).append(known[name])
    frames = []
    for source, measures in per_table.items():
        # same baskets; no segments to assign
        plain = source == "mart_basket" and not any("segment" in str(c) for c in [*by, *given])
        rows, mixed = w["fct_basket" if plain else source], []
        for condition in given:
            filtered = key_filtered(w, source, rows, condition)
            if filtered is None:
                mixed.append(condition)
            else:
                rows = filtered
        rows = with_attributes(w, source, rows, [*asked, *(m for c in mixed for m in _JOINED.findall(str(c)))])
        for condition in mixed:
            rows = rows.where(condition)
        groups = [F.col(_ATTRIBUTE.sub(r"\1__\2", c)).alias(c.split(".")[-1]) for c in by]
        wide = rows.groupBy(*groups).agg(
            *[m.value.cast("double").alias(f"m{i}") for i, m in enumerate(measures)]
        )
        pairs = F.array(
            *[
                F.struct(F.lit(m.name).alias("measure"), F.col(f"m{i}").alias("value"))
                for i, m in enumerate(measures)
            ]
        )
        out = [c.split(".")[-1] for c in by]
        frames.append(wide.select(*out, F.explode(pairs).alias("p")).select(*out, "p.*"))
    return stacked(frames)


@table("measure")
def measures_core_by_age(w):
    """Basket measures by the household's age group."""
    names = [m for m in CORE if registry()[m].table == "mart_basket"]
    return evaluate(w, names, ["dim_household.age_desc"])


@table("measure")
def measures_campaign_by_type(w):
    names = [n for n, m in registry().items() if m.table == "mart_campaign_household"]
    return evaluate(w, names, ["dim_campaign.campaign_type"], "dim_campaign.start_day > 100")


@table("measure")
def measures_core_by_dim_week(w):
    on_weeks = ("mart_panel_weekly", "mart_store_weekly")
    names = [n for n, m in registry().items() if m.table in on_weeks]
    return evaluate(w, names, ["dim_week.observation_week"])


@table("measure")
def measures_core(w):
    return evaluate(w, CORE)


@table("measure")
def measures_core_by_segment(w):
    return evaluate(w, [m for m in CORE if registry()[m].table == "mart_basket"], ["segment"])


@table("measure")
def measures_core_by_week(w):
    on_weeks = ("mart_basket", "mart_panel_weekly")
    return evaluate(w, [m for m in CORE if registry()[m].table in on_weeks], ["week_number"])


@table("measure")
def measures_supplement(w):
    return evaluate(
        w,
        [
            "Dynamic Category Buying Households",
            "Store Panel Net Spend",
            "Store Baskets",
            "Campaign-Household Exposures",
            "Redeeming Exposures",
            "Exposure Redemption Rate",
            "Root Cause Spend Contribution",
            "Root Cause Contribution Share",
        ],
    )


@table("measure")
def measures_store_by_week(w):
    return evaluate(w, ["Store Panel Net Spend", "Store Baskets"], ["week_number"])


def dynamic_category_penetration(w, where):
    """Distinct buyers over distinct active households of the chosen weeks, per category."""
    active = w["fct_basket"].where(where).agg(F.count_distinct("household_key")).scalar()
    buyers = w["mart_category_household_weekly"].where(where).groupBy("category_key").agg(
        F.count_distinct("household_key").alias("dynamic_category_buying_households")
    )
    return buyers.withColumn("active_panel_households", active).withColumn(
        "dynamic_category_household_penetration",
        ratio("dynamic_category_buying_households", "active_panel_households"),
    )


@table("measure")
def measures_dynamic_penetration(w):
    """The supplement's any-weeks penetration over the last 13 weeks."""
    _, top = week_bounds(w)
    return dynamic_category_penetration(w, F.col("week_number") > top - w.rules.window_weeks)


def _sides(w):
    """First and last windows against the whole week spine, whatever the query filters."""
    lo, hi = week_bounds(w)
    n, week = w.rules.window_weeks, F.col("week_number")
    return {"first_13w": week.between(lo, lo + n - 1), "last_13w": week.between(hi - n + 1, hi)}


def windows_over_baskets(w, by=()):
    sides = _sides(w)
    # One row per group and side keeps the distinct counts apart; a week may be on both sides.
    tagged = w["mart_basket" if "segment" in by else "fct_basket"].withColumn(
        "side",
        F.explode(F.array_compact(F.array(*[F.when(flag, s) for s, flag in sides.items()]))),
    )
    per_side = tagged.groupBy(*by, "side").agg(
        F.sum("basket_net_spend").alias("panel_spend"),
        F.nullif(F.count_distinct("household_key"), F.lit(0).cast("bigint")).alias("active_households"),
        F.count("basket_id").alias("baskets"),  # one row per basket
    )
    per_side = per_side.select(
        "*",
        ratio("panel_spend", "baskets").alias("spend_per_basket"),
        ratio("baskets", "active_households").alias("trips_per_household"),
        ratio("panel_spend", "active_households").alias("spend_per_active_household"),
    )
    names = [c for c in per_side.columns if c not in (*by, "side")]
    wide = per_side.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("side") == s, F.col(c).cast("double"))).alias(f"{s}_{c}")
            for c in names
            for s in sides
        ]
    )
    changes = {f"{c}_change_pct": ratio(F.col(f"last_13w_{c}") - F.col(f"first_13w_{c}"), f"first_13w_{c}") for c in names}
    return wide.withColumns(changes)


@table("measure")
def measures_window_13w(w):
    return windows_over_baskets(w)


@table("measure")
def measures_window_13w_by_segment(w):
    return windows_over_baskets(w, ["segment"])


@table("measure")
def measures_category_13w(w):
    sides = _sides(w)
    spend = {
        s: F.sum(F.when(flag, F.col("panel_net_spend"))).cast("double") for s, flag in sides.items()
    }
    return (
        w["mart_category_weekly"]
        .groupBy("category_key")
        .agg(*[c.alias(f"{s}_category_spend") for s, c in spend.items()])
        .withColumn(
            "category_spend_change_pct",
            ratio(
                F.col("last_13w_category_spend") - F.col("first_13w_category_spend"),
                "first_13w_category_spend",
            ),
        )
    )


@table("measure")
def segment_share_of_total(w):
    """Segment spend against spend with the segment filter removed."""
    total = w["mart_basket"].agg(F.sum("basket_net_spend")).scalar()
    return w["mart_basket"].groupBy("segment").agg(
        F.count_distinct("household_key").alias("segment_households"),
        F.sum("basket_net_spend").alias("segment_spend"),
        ratio(F.sum("basket_net_spend"), total).alias("segment_spend_share"),
        # a basket is one row here
        ratio(F.sum("basket_net_spend"), F.count("basket_id")).alias("segment_avg_basket"),
    )


@table("measure")
def measures_promotion(w):
    names = [n for n, m in registry().items() if m.table == "mart_promotion_category_week"]
    return evaluate(w, names)


@table("measure")
def measures_promotion_by_department(w):
    names = [n for n, m in registry().items() if m.table == "mart_promotion_category_week"]
    return evaluate(w, names, ["department"])


@table("measure")
def measures_campaign(w):
    names = [n for n, m in registry().items() if m.table == "mart_campaign_summary"]
    return evaluate(w, names)


@table("measure")
def measures_campaign_slices(w):
    """Single-campaign slices: the same measures, grouped by campaign."""
    return w["mart_campaign_summary"].groupBy("campaign_id").agg(
        mean("avg_pre_28d_spend").alias("pre_spend"),
        mean("avg_during_spend").alias("during_spend"),
        mean("avg_post_28d_spend").alias("post_spend"),
        ratio(F.sum("campaign_redeemers"), F.sum("campaign_recipients")).alias("redemption_rate"),
        ratio(
            F.sum(F.col("avg_during_spend") - F.col("avg_pre_28d_spend")),
            F.sum("avg_pre_28d_spend"),
        ).alias("during_vs_pre_change"),
    )


@table("measure")
def measures_category(w):
    tables = ("mart_category_weekly", "mart_brand_category")
    return evaluate(w, [n for n, m in registry().items() if m.table in tables], ["department"])


#: Fixed values. Dimension -> facts it filters, by key.
RELATIONSHIPS = {
    ("dim_week", "week_number"): (
        "mart_panel_weekly",
        "mart_category_weekly",
        "mart_promotion_category_week",
        "mart_category_household_weekly",
        "mart_store_weekly",
    ),
    ("dim_day", "day_key"): ("mart_basket",),
    ("dim_household", "household_key"): (
        "mart_basket",
        "mart_household_summary",
        "mart_customer_segment",
        "mart_campaign_household",
        "mart_category_household",
        "mart_category_household_weekly",
    ),
    ("dim_store", "store_id"): ("mart_store_weekly",),
    ("dim_category", "category_key"): (
        "mart_category_weekly",
        "mart_category_household",
        "mart_category_household_weekly",
        "mart_brand_category",
        "mart_promotion_category_week",
    ),
    ("dim_segment", "segment"): ("mart_customer_segment", "mart_campaign_household"),
    ("dim_campaign", "campaign_id"): (
        "mart_campaign_household",
        "mart_campaign_summary",
        "analysis_campaign_funnel",
        "analysis_campaign_segment",
        "mart_coupon_summary",
        "analysis_coupon_campaign",
        "analysis_coupon_segment",
        "analysis_coupon_category",
    ),
}


def fact_keys(w, fact):
    """The rows of a fact with its keys only.

    Marts of one grouping of the lines have a row per distinct key, so their sums and distinct counts are not
    worked out. A test compares the rows with those of the marts.
    """
    lines = {
        "mart_store_weekly": ("lines", None, ("store_id", "week_number")),
        "mart_category_weekly": ("category_lines", named_categories, ("week_number",)),
        "mart_brand_category": ("category_lines", named_categories, ("brand_type",)),
        "mart_category_household": ("category_lines", named_categories, ("household_key",)),
        "mart_category_household_weekly": ("governed_lines", named_governed, ("household_key", "week_number")),
    }
    if fact in lines:
        source, named, keys = lines[fact]
        if named is None:
            return w[source].select(*keys).distinct()
        return named(w, w[source].select(*keys, "category_no").distinct())
    if fact == "mart_panel_weekly":
        return w["fct_basket"].select("week_number").distinct()
    if fact == "mart_campaign_household":
        exposed = w["exposed_campaigns"].select("household_key", "campaign_id")
        return exposed.join(w["household_segment"], "household_key", "left")
    same_rows = {
        "mart_basket": "fct_basket",
        "mart_household_summary": "household_scores",
        "mart_customer_segment": "household_scores",
        "mart_promotion_category_week": "promotion_amounts",
    }
    return w[same_rows.get(fact, fact)]


def named_governed(w, rows):
    return rows.join(w["governed_numbers"], "category_no", "left")


@table("measure")
def star_relationships(w):
    """Each single-direction relationship needs a unique dimension key and no orphan fact key.

    Runs on a build of its own that writes the lines once. Every fact is reduced to its keys, read once for all
    of them, and one grouping merges the keys of all facts and dimensions.
    """
    w = w.fork()
    staged = w["stg_transaction"].columns
    w.materialise(work_folder(w.spark, "relationships"), ["lines", "products"])
    w.replace("stg_transaction", w["lines"].select(*staged))
    names = {(dim, fact): f"{dim}-{fact}" for (dim, _), facts in RELATIONSHIPS.items() for fact in facts}
    uses = {}
    for (dim, key), facts in RELATIONSHIPS.items():
        for fact in facts:
            uses.setdefault(fact, []).append((names[dim, fact], key, dim))
    references = [Reference(fact_keys(w, fact), columns) for fact, columns in uses.items()]
    members = [(dim, w[dim], key) for dim, key in RELATIONSHIPS]
    found = unmatched(references, members, "string")
    rows = []
    for (dim, key), facts in RELATIONSHIPS.items():
        repeated = w[dim].agg(F.count(F.lit(1)) - F.count_distinct(key)).scalar()
        rows += [
            F.struct(
                F.lit(dim).alias("from_table"),
                F.lit(fact).alias("to_table"),
                F.lit(key).alias("key_column"),
                repeated.alias("duplicate_dimension_keys"),
                F.col(f"`{names[dim, fact]}`").alias("orphan_rows"),
            )
            for fact in facts
        ]
    checks = found.select(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    clean = (F.col("duplicate_dimension_keys") == 0) & (F.col("orphan_rows") == 0)
    return checks.withColumn("status", F.when(clean, "PASS").otherwise("REVIEW"))
