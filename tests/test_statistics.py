import itertools
import math

import numpy as np
import pytest

from panelspark.functions.bootstrap import bootstrap_interval
from panelspark.functions.tails import chi_square_upper, exact_rank_sum_p, rank_sum_p
from panelspark.operators.statistics import contingency_test


@pytest.mark.parametrize(
    "x, df, p",
    [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (11.0705, 5, 0.05), (9.487729, 4, 0.05)],
)
def test_chi_square_tail_at_published_critical_values(x, df, p):
    assert chi_square_upper(x, df) == pytest.approx(p, abs=1e-6)


def test_chi_square_tail_edges():
    assert chi_square_upper(0.0, 3) == 1.0
    assert math.isnan(chi_square_upper(1.0, 0))


@pytest.mark.parametrize("n1, n2", [(2, 3), (3, 3), (4, 5)])
def test_exact_rank_sum_against_all_arrangements(n1, n2):
    ranks = range(1, n1 + n2 + 1)
    values = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(ranks, n1)]
    for u in set(values):
        top = max(u, n1 * n2 - u)
        wanted = min(1.0, 2 * sum(v >= top for v in values) / len(values))
        assert exact_rank_sum_p(u, n1, n2) == pytest.approx(wanted)


def test_rank_sum_normal_branch():
    # u at its mean: the continuity correction makes the tail exceed one half on both sides.
    assert rank_sum_p(50.0, 10, 10, 0.0) == 1.0
    assert rank_sum_p(100.0, 10, 10, 0.0) < 0.001
    assert math.isnan(rank_sum_p(1.0, 0, 3, 0.0))


def test_contingency_against_the_closed_form(spark):
    groups = spark.createDataFrame([("a", 8, 10), ("b", 3, 10)], "g string, hit bigint, n bigint")
    row = contingency_test(groups, "hit", "n").collect()[0]
    assert row.chi_square_statistic == pytest.approx(20 * (8 * 7 - 2 * 3) ** 2 / (10 * 10 * 11 * 9))
    assert row.effect_size_cramers_v == pytest.approx(math.sqrt(row.chi_square_statistic / 20))
    assert row.chi_square_p_value == pytest.approx(chi_square_upper(row.chi_square_statistic, 1))


def test_contingency_without_any_hit_is_nan(spark):
    groups = spark.createDataFrame([("a", 0, 4), ("b", 0, 2)], "g string, hit bigint, n bigint")
    assert all(math.isnan(v) for v in contingency_test(groups, "hit", "n").collect()[0])


def test_bootstrap_brackets_the_difference_and_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(v), 1) for v in rng.normal(12, 2, 300).round(2)]
    rows += [("b", float(v), 2) for v in rng.normal(10, 2, 300).round(2)]
    df = spark.createDataFrame(rows, "segment string, value double, n bigint").groupBy(
        "segment", "value"
    ).sum("n").withColumnRenamed("sum(n)", "n")
    first = {r.segment: r for r in bootstrap_interval(df).collect()}
    again = {r.segment: r for r in bootstrap_interval(df.repartition(7)).collect()}
    a = np.average([v for s, v, _ in rows if s == "a"])
    b = np.average([v for s, v, _ in rows if s == "b"])
    assert first["a"].ci_low < a - b < first["a"].ci_high
    assert first["b"].ci_low < b - a < first["b"].ci_high
    # The width of a mean difference is known: about 1.96 standard errors on each side.
    half = (first["a"].ci_high - first["a"].ci_low) / 2
    assert half == pytest.approx(1.96 * math.sqrt(4 / 300 + 4 / 600), rel=0.15)
    for s in "ab":
        assert first[s].ci_low == pytest.approx(again[s].ci_low, rel=1e-9)


def test_effect_size_by_hand(spark, panel):
    rows = {r.segment: r for r in panel["stats_basket_effect_size"].collect()}
    spends = {}
    for r in panel["mart_basket"].collect():
        spends.setdefault(r.segment, []).append(float(r.basket_net_spend))
    for segment, own in spends.items():
        rest = [v for s, vs in spends.items() if s != segment for v in vs]
        got = rows[segment]
        assert got.n == len(own)
        assert got.median_basket_value == pytest.approx(np.median(own))
        assert got.mean_vs_other_segments == pytest.approx(np.mean(own) - np.mean(rest))
        if len(own) > 1 and len(rest) > 1:
            pooled = (np.var(own) * len(own) + np.var(rest) * len(rest)) / (len(own) + len(rest) - 2)
            assert got.effect_size_cohens_d == pytest.approx(
                (np.mean(own) - np.mean(rest)) / math.sqrt(pooled)
            )


def test_rank_tests_against_brute_force(panel):
    values = {}
    for r in panel["promotion_values"].collect():
        values.setdefault(r.promo_state_group, []).append(r.value)
    everything = sorted(v for vs in values.values() for v in vs)

    def rank(v):
        return sum(x < v for x in everything) + (sum(x == v for x in everything) + 1) / 2

    n = len(everything)
    h = 12 / (n * (n + 1)) * sum(
        sum(map(rank, vs)) ** 2 / len(vs) for vs in values.values()
    ) - 3 * (n + 1)
    ties = sum(everything.count(v) ** 3 - everything.count(v) for v in set(everything))
    h /= 1 - ties / (n**3 - n)
    for r in panel["stats_promotion_kruskal"].collect():
        assert r.kruskal_wallis_stat == pytest.approx(h)
    for r in panel["stats_promotion_mann_whitney"].collect():
        if r.promo_state_group == "none":
            assert math.isnan(r.mann_whitney_u_vs_none)
            continue
        u = sum(
            (x > y) + 0.5 * (x == y) for x in values[r.promo_state_group] for y in values["none"]
        )
        assert r.mann_whitney_u_vs_none == pytest.approx(u)
        pairs = len(values[r.promo_state_group]) * len(values["none"])
        assert r.effect_size_rank_biserial_vs_none == pytest.approx(1 - 2 * u / pairs)
