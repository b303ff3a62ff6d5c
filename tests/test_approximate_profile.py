from conftest import as_dicts
from pyspark.sql import functions as F

from panelspark.operators.profiles import approximate_profile, column_sketches, sketch_error, sketched_profile

EXACT = ("row_count", "null_or_blank_count", "min_value", "max_value")


def test_sketches_agree_with_the_exact_profile(panel):
    key = ("source_name", "column_name")
    exact, rough = as_dicts(panel["column_profile"], *key), as_dicts(approximate_profile(panel), *key)
    assert exact.keys() == rough.keys()
    for at, row in exact.items():
        assert [rough[at][c] for c in EXACT] == [row[c] for c in EXACT]
        assert rough[at]["distinct_count"] == row["distinct_count"]  # few values are counted exactly


def test_error_bound_and_merging_of_parts(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 20_000).alias("a"), F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).otherwise(" ").alias("b"),
        (F.col("id") % 5).alias("day"),
    )
    for k in (10, 14):
        whole = as_dicts(sketched_profile(column_sketches(df.drop("day"), k)), "column_name")
        parts = as_dicts(sketched_profile(column_sketches(df, k, by=["day"])), "column_name")
        for seen in (whole, parts):
            for c, n in (("a", 20_000), ("b", 45_001)):
                assert abs(seen[c]["distinct_count"] / n - 1) <= 4 * sketch_error(k)
                assert seen[c]["row_count"] == 60_000
            assert seen["b"]["null_or_blank_count"] == 15_000
