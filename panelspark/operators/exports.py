"""Export tables and the metric reconciliation around them."""

import time

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.functions.columns import ratio
from panelspark.operators.quality import one_row_each, stacked
from panelspark.operators.marts import redeemer
from panelspark.plans.registry import LARGE_SOURCES, LAYERS, SHARED, table
from panelspark.sources import files

#: The metric names.
METRICS = (
    "Panel Net Spend",
    "Baskets",
    "Active Panel Households",
    "Spend per Basket",
    "Private Label Share",
    "Campaign Recipients",
    "Campaign Redeemers",
    "Redemption Rate",
)
TOLERANCE = 1e-6


def headline_metrics(basket, panel, exposure, value):
    """The eight headline metrics in long form, one scan per table."""
    spend = F.sum("basket_net_spend").cast("double")
    n, people = F.count_distinct("basket_id"), F.count_distinct("household_key")
    used = F.count_distinct(redeemer())
    per_table = (
        (basket, METRICS[:4], (spend, n, people, ratio(spend, n))),
        (
            panel,
            METRICS[4:5],
            (ratio(F.sum("private_label_spend"), F.sum("panel_net_spend")),),
        ),
        (exposure, METRICS[5:], (people, used, ratio(used, people))),
    )
    frames = []
    for df, names, columns in per_table:
        wide = df.agg(*[c.cast("double").alias(f"m{i}") for i, c in enumerate(columns)])
        rows = [
            (F.lit(name).alias("metric"), F.col(f"m{i}").alias(value))
            for i, name in enumerate(names)
        ]
        frames.append(one_row_each(wide, rows))
    return stacked(frames)


@table("export")
def export_metric_reconciliation(w):
    return headline_metrics(
        w["mart_basket"], w["mart_panel_weekly"], w["mart_campaign_household"], "sql_value"
    )


@table("export")
def export_decision_alerts(w):
    return w["mart_decision_alerts"].where(F.col("severity").isin("high", "medium"))


@table("export")
def metric_totals(w):
    """The same metrics recomputed from exported files."""
    folder = files.export_tables(
        w.stored(), ["mart_basket", "mart_panel_weekly", "mart_campaign_household"], gate=False
    ).folder

    def back(name):
        return files.read_parquet(w.spark, f"{folder}/{files.export_name(name)}")

    return headline_metrics(
        back("mart_basket"), back("mart_panel_weekly"), back("mart_campaign_household"), "value"
    )


def reconcile(left, right, tolerance=TOLERANCE, scope="curated_export_snapshot"):
    """Compare two (metric, value) tables over the union of their names.

    A name missing on one side, or given twice, fails.
    """

    def one_side(df, name):
        value = next(c for c in ("value", "sql_value", "export_value") if c in df.columns)
        return df.groupBy("metric").agg(
            F.max(F.col(value).cast("double")).alias(name), F.count(F.lit(1)).alias(f"_n_{name}")
        )

    both = one_side(left, "sql_value").join(one_side(right, "export_value"), "metric", "full_outer")
    gap = F.abs(F.col("sql_value") - F.col("export_value"))
    single = (F.col("_n_sql_value") == 1) & (F.col("_n_export_value") == 1)
    good = single & (gap <= tolerance) & ~F.isnan(gap)
    return both.select(
        "metric",
        "sql_value",
        "export_value",
        gap.alias("difference"),
        F.lit(tolerance).alias("tolerance"),
        F.when(F.coalesce(good, F.lit(False)), "pass").otherwise("fail").alias("status"),
        F.lit(scope).alias("comparison_scope"),
    )


@table("export")
def metric_reconcile(w):
    kept = w.stored()
    return reconcile(kept["export_metric_reconciliation"], kept["metric_totals"])


#: Governed tables of a release, in export order.
#: The governed tables in build order.
EXPORTS = (
    "dim_day",
    "dim_week",
    "dim_household",
    "dim_product",
    "dim_store",
    "dim_campaign",
    "dim_category",
    "dim_segment",
    "mart_panel_weekly",
    "mart_household_summary",
    "mart_customer_segment",
    "mart_basket",
    "mart_category_weekly",
    "mart_category_household",
    "mart_category_household_weekly",
    "mart_store_weekly",
    "analysis_category_penetration",
    "analysis_category_decomposition",
    "mart_brand_category",
    "mart_promotion_category_week",
    "analysis_promotion_association",
    "analysis_promotion_dependency",
    "analysis_promotion_universe_audit",
    "analysis_root_cause_lmdi",
    "analysis_category_materiality",
    "analysis_category_lmdi",
    "analysis_segment_stability",
    "analysis_private_label_anomalies",
    "analysis_first_observed_cohort",
    "analysis_demographic_summary",
    "mart_campaign_household",
    "mart_campaign_summary",
    "analysis_campaign_funnel",
    "analysis_campaign_segment",
    "analysis_campaign_denominators",
    "mart_coupon_summary",
    "analysis_coupon_campaign",
    "analysis_coupon_segment",
    "analysis_coupon_category",
    "analysis_coupon_basket",
    "analysis_coupon_repeat_category",
    "mart_cross_category_pair",
    "mart_decision_alerts",
    "export_metric_reconciliation",
    "export_decision_alerts",
)


@table("export")
def export_curated(w):
    """A full build: every governed table, each derived once, over lines and facts that are written on first use.

    The report shows what a build writes; the gate is a table of its own and not asked here.
    """
    build = w.fork(LARGE_SOURCES + SHARED + ("mart_household_weekly",))
    return files.export_tables(build, EXPORTS, reuse=True, gate=False).report


def build_models(w, names, run_id="manual", folder=None):
    """Build tables one after another and log every one: run id, rows read and written, error, seconds.

    Each is derived once; later ones read its files. Rows read are those of the sources and tables a
    model was built from (as the warehouse saw them used; internal steps count as part of the model).
    Written rows are counted by the write itself, other inputs once per run. A model that fails is
    logged with its error and the build goes on.
    """
    # facts are models and are written as such; what lies before them is kept beside
    build = w.fork(LARGE_SOURCES + ("products", "household_week_spend"))
    folder = folder or files.work_folder(w.spark, "models")
    sizes, log = {}, []

    def size(at):
        if at not in sizes:
            sizes[at] = (build[at] if isinstance(at, str) else build.raw(at[1])).count()
        return sizes[at]

    for name in names:
        start, read, written, error = time.monotonic(), 0, 0, ""
        try:
            rows = build[name]
            read = sum(size(at) for at in build.models_read(name))
            written = sizes[name] = files.write_counted(rows, f"{folder}/{name}")
            build.replace(name, files.read_parquet(w.spark, f"{folder}/{name}"), written)
        except PySparkException as problem:
            error = str(problem)
        status = "failed" if error else "success"
        log.append((run_id, name, read, written, status, error, time.monotonic() - start))
    schema = (
        "run_id string, table_name string, rows_read bigint, rows_written bigint, status string, error string, "
        "duration_seconds double"
    )
    return w.spark.createDataFrame(log, schema)


@table("export")
def run_row_metrics(w):
    """Build log of all dimensions, facts and marts."""
    names = [n for layer in ("dimension", "fact", "mart") for n in LAYERS[layer]]
    return build_models(w, names).drop("duration_seconds")
