import pytest
from conftest import PANEL, as_dicts, frames

from panelspark import Warehouse
from panelspark.operators.profiles import contract_check, inventory
from panelspark.sources import files


@pytest.fixture()
def folder(spark, tmp_path):
    source = frames(spark)
    for name in PANEL:
        files.write_csv(source(name).coalesce(1), f"{tmp_path}/{name}.csv")
    return str(tmp_path)


def test_csv_round_trip_builds_the_same_mart(spark, panel, folder):
    from_csv = Warehouse(spark, files.csv_sources(spark, folder))
    columns = sorted(panel["mart_panel_weekly"].columns)
    assert sorted(map(str, from_csv["mart_panel_weekly"].select(columns).collect())) == sorted(
        map(str, panel["mart_panel_weekly"].select(columns).collect())
    )


def test_header_drift_raises(spark, tmp_path):
    spark.range(1).selectExpr("id AS COUPON_UPC", "id AS WRONG", "id AS CAMPAIGN").write.option(
        "header", True
    ).csv(f"{tmp_path}/coupon.csv")
    with pytest.raises(Exception, match="CSV header does not conform"):
        files.read_source(spark, str(tmp_path), "coupon").collect()


def test_columns_are_found_by_name(spark, tmp_path):
    spark.sql("SELECT 7 AS PRODUCT_ID, 3 AS CAMPAIGN, 500 AS COUPON_UPC").write.option("header", True).csv(
        f"{tmp_path}/coupon.csv"
    )
    (row,) = files.read_source(spark, str(tmp_path), "coupon").collect()
    assert (row.COUPON_UPC, row.PRODUCT_ID, row.CAMPAIGN) == (500, 7, 3)


def test_failed_gate_blocks_exports(panel, tmp_path):
    assert not panel["quality_gate"].first()["ready"]
    with pytest.raises(files.QualityGateError):
        files.export_tables(panel, ["dim_week"], folder=str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_contract_check_precedence(spark, folder, tmp_path_factory):
    rows = as_dicts(contract_check(spark, folder), "source_name")
    assert {r["status"] for r in rows.values()} == {"ok"} and len(rows) == 8
    other = tmp_path_factory.mktemp("bad")
    headers = {
        "coupon": "COUPON_UPC,PRODUCT_ID,PRODUCT_ID",
        "coupon_redempt": "household_key,DAY,COUPON_UPC,EXTRA",
        "campaign_desc": "DESCRIPTION,CAMPAIGN,START_DAY,END_DAY,NOTE",
    }
    for name, head in headers.items():
        (other / f"{name}.csv").write_text(head + "\n")
    rows = as_dicts(contract_check(spark, str(other)), "source_name")
    assert rows["coupon"]["status"] == "duplicate_columns"
    assert rows["coupon"]["duplicate_columns"] == "PRODUCT_ID"
    assert rows["coupon"]["missing_columns"] == "CAMPAIGN"
    assert rows["coupon_redempt"]["status"] == "missing_columns"
    assert rows["campaign_desc"]["status"] == "unexpected_columns"
    assert rows["product"]["status"] == "missing_file"


def test_inventory_reports_missing_and_counts(spark, folder):
    rows = as_dicts(inventory(spark, folder), "source_name")
    assert rows["coupon"]["row_count"] == 3 and rows["coupon"]["column_count"] == 3
    assert rows["coupon"]["planning_expectation_status"] == "review"
    gone = as_dicts(inventory(spark, folder + "/nowhere"), "source_name")
    assert {r["load_status"] for r in gone.values()} == {"missing"}


def test_curated_parquet_has_lineage(spark, tmp_path):
    log = files.curate(spark, frames(spark), str(tmp_path), "run7")
    assert all(r.rows_read == r.rows_written == len(PANEL[r.source_name]) for r in log.collect())
    curated = spark.read.parquet(f"{tmp_path}/coupon.parquet")
    assert set(files.LINEAGE) <= set(curated.columns)
    assert [r.pipeline_run_id for r in curated.select("pipeline_run_id").distinct().collect()] == ["run7"]
    assert files.parquet_sources(spark, str(tmp_path))("coupon").columns == [
        "COUPON_UPC", "PRODUCT_ID", "CAMPAIGN",
    ]


def test_profile(panel):
    rows = as_dicts(panel["source_null_profile"], "source_name", "column_name")
    assert len(rows) == 46
    department = rows[("product", "DEPARTMENT")]
    assert department["null_or_blank_count"] == 2 and department["distinct_count"] == 2
    assert department["null_or_blank_pct"] == 0.5
    assert rows[("transaction_data", "DAY")]["max_value"] == "9"
    ratios = as_dicts(panel["source_cardinality"], "source_name", "column_name")
    assert ratios[("coupon", "PRODUCT_ID")]["cardinality_ratio"] == 1


def test_exports_carry_the_run_id(spark, panel, tmp_path):
    done = files.export_tables(panel, ["dim_week"], run_id="r1", folder=str(tmp_path), gate=False)
    assert done.report.collect()[0].rows_written == 4
    back = spark.read.parquet(f"{tmp_path}/Dim_Week")
    assert [r.pipeline_run_id for r in back.select("pipeline_run_id").distinct().collect()] == ["r1"]


def test_materialised_tables_are_read_back(spark, tmp_path):
    w = Warehouse(spark, frames(spark))
    w.materialise(str(tmp_path), ["fct_basket"])
    assert "parquet" in w["mart_panel_weekly"]._jdf.queryExecution().toString().lower()
    assert w["fct_basket"].count() == 6
