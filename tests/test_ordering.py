import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.ordering import ntile, rank_table, with_before
from panelspark.functions.quantiles import grouped_quantile, weighted_quantiles


def plain_ntile(values, tiles):
    n, out = len(values), {}
    small, extra = divmod(n, tiles)
    place = 0
    for t in range(tiles):
        for _ in range(small + (t < extra)):
            out[values[place]] = t + 1
            place += 1
    return out


@pytest.mark.parametrize("n", [1, 3, 5, 7, 103, 400])
def test_ntile_matches_the_rule_with_heavy_ties(spark, n):
    random.seed(n)
    # A third of the rows share one value.
    rows = [(i, 0 if i % 3 == 0 else random.randint(0, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(3)
    got = {
        r.k: r.t for r in ntile(df, 5, [F.col("v").asc(), F.col("k").asc()], "t").collect()
    }
    ordered = [k for k, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert got == plain_ntile(ordered, 5)


def test_rank_table_is_rank_within_groups(spark):
    random.seed(1)
    rows = [(random.randint(0, 2), random.randint(0, 20)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, v int")
    got = {(r.g, r.v): r["rank"] for r in rank_table(df, ["v"], ["g"]).collect()}
    for g, v in set(rows):
        assert got[(g, v)] == 1 + sum(1 for a, b in rows if a == g and b > v)


def test_before_is_the_same_for_any_partitioning(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).alias("w"))
    results = []
    for parts in (1, 5):
        placed = with_before(df.repartition(parts), [F.col("k")], {"a": F.col("w"), "b": F.lit(1)})
        results.append(sorted((r.k, r.a, r.b) for r in placed.collect()))
    assert results[0] == results[1]
    running = 0
    for k, a, b in results[0]:
        assert (a, b) == (running, k)
        running += k % 7


def test_grouped_quantile_matches_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in ("a", "b") for v in rng.integers(0, 40, 101 if g == "a" else 64)]
    df = spark.createDataFrame([*rows, ("c", 5.0)], "g string, v double")
    for share in (0.5, 0.99):
        got = {r.g: r.q for r in grouped_quantile(df, ["g"], "v", share, "q").collect()}
        for g in "ab":
            assert got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g], share))
        assert got["c"] == 5.0


def test_quantiles_without_groups(spark):
    df = spark.createDataFrame([(float(v), n) for v, n in [(1, 1), (2, 2), (10, 1)]], "v double, n long")
    (row,) = weighted_quantiles(df, [], "v", "n", {"p50": 0.5, "p99": 0.99}).collect()
    assert row.p50 == pytest.approx(np.quantile([1, 2, 2, 10], 0.5))
    assert row.p99 == pytest.approx(np.quantile([1, 2, 2, 10], 0.99))
