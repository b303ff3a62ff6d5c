"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
BENCH_QUERIES, a comma list, narrows the queries. Every query starts from a fresh warehouse, so
none reads tables another one has pinned, and is run to its end into a no-op sink.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from panelspark.plans import catalog  # noqa: E402
from panelspark.plans.warehouse import SETTINGS  # noqa: E402

HEADLINE = [
    "mart_panel_weekly",
    "fct_basket",
    "fct_promotion_product_store_week",
    "mart_household_weekly",
    "mart_household_summary",
    "mart_customer_segment",
    "mart_category_weekly",
    "mart_brand_category",
    "mart_promotion_category_week",
    "mart_campaign_household",
    "mart_campaign_summary",
    "mart_cross_category_pair",
    "mart_category_household",
    "mart_category_household_weekly",
    "mart_store_weekly",
    "mart_decision_alerts",
    "qa_transaction_anomalies",
    "qa_layer_reconciliation",
    "qa_source_contract_audit",
    "source_null_profile",
    "analysis_root_cause_lmdi",
    "analysis_household_engagement_sequence",
    "analysis_category_materiality",
    "analysis_coupon_repeat_category",
    "analysis_coupon_basket",
    "analysis_segment_stability",
    "stats_basket_by_segment",
    "stats_promotion_state",
    "measures_core",
    "snapshot_pair_affinity",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config(map=SETTINGS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["mart_panel_weekly"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        catalog.forget()
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
