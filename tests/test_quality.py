from conftest import PANEL, as_dicts, frames

from panelspark import Warehouse
from panelspark.operators.exports import reconcile
from panelspark.operators.quality import GATE, gate_findings, gate_verdict


def tables(spark, **changed):
    base = {
        "qa_key_audit": ("model string, duplicate_rows bigint", [("product", 0)]),
        "qa_grain_audit": ("audit_name string, violating_baskets bigint", [("g", 0)]),
        "qa_reference_coverage": ("audit_name string, violating_rows bigint", [("r", 0)]),
        "qa_layer_reconciliation": ("audit_name string, status string", [("l", "pass")]),
        "qa_transaction_anomalies": ("audit_name string, violating_rows bigint", [("outlier", 0)]),
        "qa_source_contract_audit": (
            "check_name string, violating_rows bigint, severity string",
            [("c", 0, "block")],
        ),
    }
    out = {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in base.items()}
    for name, rows in changed.items():
        out[name] = spark.createDataFrame(rows, base[name][0])
    return out


def verdict(spark, given):
    found = gate_findings(spark, given)
    return gate_verdict(found).collect()[0], {(r.source_table, r.reason, r.level) for r in found.collect()}


def test_clean_tables_are_ready(spark):
    row, found = verdict(spark, tables(spark))
    assert row.ready and not found and row.checked_tables == len(GATE)


def test_grain_blocks_and_outlier_warns(spark):
    row, found = verdict(
        spark, tables(spark, qa_grain_audit=[("g", 2)], qa_transaction_anomalies=[("outlier", 3)])
    )
    assert not row.ready and row.failures == 1 and row.warnings == 1
    assert ("qa_grain_audit", "basket_grain_inconsistency", "fail") in found


def test_missing_key_anomaly_blocks(spark):
    row, _ = verdict(spark, tables(spark, qa_transaction_anomalies=[("missing_basket", 1)]))
    assert not row.ready


def test_contract_severity_decides(spark):
    row, _ = verdict(spark, tables(spark, qa_source_contract_audit=[("c", 2, "warning")]))
    assert row.ready and row.warnings == 1


def test_empty_absent_and_incomplete_outputs_fail(spark):
    given = tables(spark, qa_key_audit=[])
    del given["qa_grain_audit"]
    given["qa_reference_coverage"] = given["qa_reference_coverage"].drop("violating_rows")
    row, found = verdict(spark, given)
    assert not row.ready
    assert {reason for _, reason, _ in found} == {
        "empty_quality_output",
        "missing_quality_output",
        "missing_quality_columns",
    }


def test_missing_number_fails(spark):
    _, found = verdict(spark, tables(spark, qa_reference_coverage=[("r", None)]))
    assert ("qa_reference_coverage", "invalid_quality_number", "fail") in found


def test_layers_reconcile_on_the_panel(panel):
    rows = as_dicts(panel["qa_layer_reconciliation"], "audit_name")
    assert len(rows) == 9 and {r["status"] for r in rows.values()} == {"pass"}
    assert rows["causal_raw_vs_promotion_fact"]["upstream_rows"] == 5


def test_audits_on_the_panel(panel):
    assert {r.violating_baskets for r in panel["qa_grain_audit"].collect()} == {0}
    coverage = as_dicts(panel["qa_reference_coverage"], "audit_name")
    assert coverage["transaction_product_unmatched"]["violating_rows"] == 1
    assert coverage["campaign_household_unmatched"]["violating_rows"] == 1
    odd = as_dicts(panel["qa_transaction_anomalies"], "audit_name")
    assert odd["trans_time_invalid"]["violating_rows"] == 1
    assert odd["quantity_non_positive"]["observed_min"] == "0.0"
    checks = as_dicts(panel["qa_source_contract_audit"], "source_name", "check_name")
    assert len(checks) == 22
    assert checks[("product", "required_category_attributes")]["violating_rows"] == 2
    assert checks[("coupon_redempt", "duplicate_redemption_event")]["violating_rows"] == 1


def test_bad_codes_and_split_baskets_are_found(spark):
    lines = [list(r) for r in PANEL["transaction_data"]]
    lines[1][0] = 5
    w = Warehouse(
        spark,
        frames(spark, transaction_data=[tuple(r) for r in lines], causal_data=[(1, 1, 1, "0", "1")]),
    )
    assert as_dicts(w["qa_grain_audit"], "audit_name")["basket_household_consistency"][
        "violating_baskets"
    ] == 1
    checks = as_dicts(w["qa_source_contract_audit"], "check_name")
    assert checks["unsupported_promotion_codes"]["violating_rows"] == 1


def test_reconcile_rules(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "metric string, sql_value double")
    right = spark.createDataFrame(
        [("a", 1.0), ("b", 2.5), ("d", 1.0), ("c", 3.0), ("c", 3.0)], "metric string, value double"
    )
    rows = as_dicts(reconcile(left, right), "metric")
    assert {m: r["status"] for m, r in rows.items()} == {
        "a": "pass", "b": "fail", "c": "fail", "d": "fail",
    }


def test_universe_audit_cases(spark, panel):
    assert panel["promotion_universe_raw_audit"].collect()[0].recovery_case == "RECOVERED_MODELED_NONE"
    promoted = Warehouse(spark, frames(spark, causal_data=[(1, 1, 1, "1", "0")]))
    row = promoted["promotion_universe_raw_audit"].collect()[0]
    assert row.recovery_case == "CASE_A_RAW_PROMOTED_ROWS_ONLY" and not row.valid_none_for_uplift
    merged = Warehouse(spark, frames(spark, causal_data=[(1, 1, 1, "1", "0"), (1, 1, 1, "0", "0")]))
    row = merged["promotion_universe_raw_audit"].collect()[0]
    assert row.recovery_case == "CASE_B_RAW_ZERO_ZERO_NOT_RETAINED"
