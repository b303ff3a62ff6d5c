from conftest import as_dicts, frames

from panelspark import Warehouse
from panelspark.operators.exports import build_models
from panelspark.plans.registry import BUILDERS, LAYERS


def test_every_model_is_logged_with_what_it_read(spark, panel):
    names = ["dim_product", "dim_category", "dim_coupon", "fct_basket", "mart_panel_weekly", "mart_decision_alerts"]
    rows = as_dicts(build_models(panel, names, run_id="r7"), "table_name")
    assert list(rows) == names
    for name, row in rows.items():
        assert (row["run_id"], row["status"], row["error"]) == ("r7", "success", "")
        assert row["rows_written"] == panel[name].count() and row["duration_seconds"] > 0
    lines, written = panel["stg_transaction"].count(), {n: r["rows_written"] for n, r in rows.items()}
    read = {n: r["rows_read"] for n, r in rows.items()}
    assert read["dim_product"] == panel.raw("product").count()
    assert read["dim_category"] == written["dim_product"]
    assert read["fct_basket"] == lines + written["dim_product"]
    assert read["mart_decision_alerts"] == written["mart_panel_weekly"]
    assert read["mart_panel_weekly"] == lines + sum(written[n] for n in ("dim_product", "dim_category", "fct_basket"))


def test_a_failing_model_is_logged_and_the_build_goes_on(spark, monkeypatch):
    monkeypatch.setitem(BUILDERS, "dim_store", lambda w: w["stg_transaction"].select("no_such_column"))
    rows = as_dicts(build_models(Warehouse(spark, frames(spark)), ["dim_store", "dim_week"]), "table_name")
    assert rows["dim_store"]["status"] == "failed" and "no_such_column" in rows["dim_store"]["error"]
    assert (rows["dim_store"]["rows_read"], rows["dim_store"]["rows_written"]) == (0, 0)
    assert rows["dim_week"]["status"] == "success" and rows["dim_week"]["rows_written"] > 0


def test_inputs_do_not_depend_on_the_order_of_building(spark):
    names = [n for layer in ("dimension", "fact", "mart") for n in LAYERS[layer]]
    found = []
    for order in (names, names[::-1]):
        w = Warehouse(spark, frames(spark))
        for n in order:
            w[n]
        found.append({n: w.models_read(n) for n in names})
    assert found[0] == found[1]
