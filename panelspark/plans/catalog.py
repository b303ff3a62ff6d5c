"""Every query the library answers, by name, over a folder of input tables."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.columns import presented
from panelspark.operators import load_all
from panelspark.plans.registry import LAYERS
from panelspark.plans.warehouse import Warehouse
from panelspark.sources.order_tables import OrderTables


@dataclass(frozen=True)
class Query:
    table: str
    #: DOUBLE columns shown to ``places`` decimals, since the last bits of a logarithm differ
    #: between math libraries.
    rounded: tuple[str, ...] = ()
    places: int = 6
    #: columns shown to 6 decimals: differences that should be nothing (amounts of 1e8 leave 1e-8)
    fine: tuple[str, ...] = ()
    #: surrogate ids, which differ from run to run
    drop: tuple[str, ...] = ()
    #: False where no SQL counterpart exists
    checked: bool = True


#: Tables that need more than their name.
_DETAILS = {
    "fct_transaction_line": Query("fct_transaction_line", drop=("transaction_line_id",)),
    "fct_coupon_redemption": Query("fct_coupon_redemption", drop=("redemption_event_id",)),
    "analysis_root_cause_lmdi": Query(
        "analysis_root_cause_lmdi",
        rounded=(
            "contribution",
            "total_spend_change",
            "summed_driver_contribution",
        ),
        places=4,
        fine=("reconciliation_delta",),
    ),
    "analysis_category_lmdi": Query(
        "analysis_category_lmdi",
        rounded=(
            "buying_households_contribution",
            "frequency_contribution",
            "basket_value_contribution",
            "contribution_sum",
        ),
        places=4,
        fine=("reconciliation_delta",),
    ),
    "root_cause_drivers": Query(
        "root_cause_drivers", rounded=("spend_change_contribution", "contribution_share"), places=4
    ),
    # The full report adds tail probabilities and intervals, which have no SQL counterpart.
    "stats_basket_by_segment": Query("stats_basket_by_segment", checked=False),
    "stats_promotion_state": Query("stats_promotion_state", checked=False),
    "stats_basket_effect_size": Query(
        "stats_basket_effect_size", rounded=("effect_size_cohens_d",), places=8
    ),
    "stats_promotion_kruskal": Query(
        "stats_promotion_kruskal",
        rounded=(
            "mean_panel_sales_per_product_store_week",
            "kruskal_wallis_stat",
            "kruskal_wallis_p_value",
            "effect_size_eta_squared",
        ),
    ),
    "stats_promotion_mann_whitney": Query(
        "stats_promotion_mann_whitney", rounded=("mann_whitney_p_value_vs_none",)
    ),
    "stats_campaign_chi_square": Query(
        "stats_campaign_chi_square",
        rounded=("chi_square_statistic", "chi_square_p_value", "effect_size_cramers_v"),
        places=8,
    ),
    "finding_window_comparison": Query(
        "finding_window_comparison", rounded=("spend_change",), places=4
    ),
    # Averages of ratios are sums of doubles, whose last bits follow the order of the rows.
    "mart_household_summary": Query("mart_household_summary", rounded=("avg_basket_value",)),
    "mart_customer_segment": Query("mart_customer_segment", rounded=("avg_basket_value",)),
    "analysis_customer_engagement": Query("analysis_customer_engagement", rounded=("avg_basket_value",)),
    "analysis_basket_category": Query(
        "analysis_basket_category",
        rounded=("avg_private_label_share", "avg_discount_rate"),
        places=9,
    ),
    "measures_promotion": Query("measures_promotion", rounded=("value",)),
    "measures_promotion_by_department": Query("measures_promotion_by_department", rounded=("value",)),
    "measures_campaign": Query("measures_campaign", rounded=("value",)),
    "measures_supplement": Query("measures_supplement", rounded=("value",), places=4),
    "export_curated": Query("export_curated", drop=("duration_seconds",)),
}
#: A fixed seven-row list; it is used by other queries but reads no input itself.
_NOT_QUERIES = {"dim_segment"}


def _all() -> dict[str, Query]:
    load_all()
    names = [n for layer, ns in LAYERS.items() if layer != "internal" for n in ns]
    return {n: _DETAILS.get(n, Query(n)) for n in names if n not in _NOT_QUERIES}


QUERIES = _all()
KEPT_WAREHOUSES = 2
_warehouses: dict[tuple, Warehouse] = {}


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    """One warehouse per application and folder, so tables pinned for one query serve the next.

    Only the last ``KEPT_WAREHOUSES`` folders are remembered, and files are taken as unchanged while one is;
    ``forget`` drops all.
    """
    key = (spark.sparkContext.applicationId, folder)
    kept = _warehouses.pop(key, None) or Warehouse(spark, OrderTables(spark, folder))
    _warehouses[key] = kept
    while len(_warehouses) > KEPT_WAREHOUSES:
        _warehouses.pop(next(iter(_warehouses)))
    return kept


def forget() -> None:
    _warehouses.clear()


def _runner(spec: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = presented(warehouse(spark, folder)[spec.table])
        out = out.drop(*spec.drop)
        for names, places in ((spec.rounded, spec.places), (spec.fine, 6)):
            for c in names:
                # a fiftieth of the last place more, so that exact halves fall one way whatever the last bits
                shown = F.round(F.col(c).cast("double") + F.lit(2.0 * 10.0 ** -(places + 2)), places)
                out = out.withColumn(c, shown + F.lit(0.0))
        return out

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(spec) for name, spec in QUERIES.items()}
