import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelspark import Warehouse  # noqa: E402
from panelspark.sources.contracts import CONTRACTS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def money(x):
    return Decimal(str(x)).quantize(Decimal("0.0001"))


def line(hh, basket, day, product, qty, sales, store=1, off=0, coupon=0, time=900):
    return (
        hh, str(basket), day, product, float(qty), money(sales), store, money(-off),
        money(-coupon), money(0), time, 1 + (day - 1) // 7,
    )


#: A made-up panel: three households over four weeks, one product without a row, blank names.
PANEL = {
    "transaction_data": [
        line(1, 10, 1, 1, 2, 8, off=1, coupon=1),
        line(1, 10, 1, 2, 1, 2),
        line(1, 11, 9, 1, 1, 5),
        line(2, 20, 3, 3, 1, 7, store=2, time=1275),
        line(2, 21, 24, 3, 0, 4, store=2),
        line(3, 30, 10, 4, 1, 6, off=2),
        line(3, 31, 22, 9, 50, 3),
    ],
    "causal_data": [
        (1, 1, 1, "0", "0"), (1, 1, 2, "5", "0"), (1, 1, 2, "0", "A"), (3, 2, 1, "0", "D"),
        (3, 2, 3, "2", "0"), (2, 1, 1, "0", "0"),
    ],
    "coupon": [(500, 1, 1), (500, 2, 1), (501, 3, 2)],
    "coupon_redempt": [(1, 2, 500, 1), (1, 2, 500, 1)],
    "campaign_table": [(1, 1, "TypeA"), (2, 1, "TypeA"), (2, 2, "TypeB"), (7, 2, "TypeB")],
    "campaign_desc": [("TypeA", 1, 2, 9), ("TypeB", 2, 12, 15)],
    "product": [
        (1, 1, "FOOD", "Private", "SNACK", "chips", "1"), (2, 1, "FOOD", " national ", "DRINK", "tea", "2"),
        (3, 2, "", "National", "SNACK", "nuts", "3"), (4, 2, None, "National", " ", "misc", "4"),
    ],
    "hh_demographic": [("25-34", " ", "A", "Owner", "Two", "2", None, 1)],
}


def frames(spark, **changed):
    rows = {**PANEL, **changed}

    def source(name):
        contract = CONTRACTS[name]
        schema = type(contract.schema)([type(f)(f.name, f.dataType, True) for f in contract.schema])
        return spark.createDataFrame(rows[name], schema)

    return source


@pytest.fixture(scope="session")
def panel(spark):
    return Warehouse(spark, frames(spark))


def as_dicts(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r.asDict() for r in df.collect()}
