import random
import re

import pytest
from conftest import PANEL, as_dicts, frames, line
from pyspark.sql import functions as F

from panelspark import Warehouse
from panelspark.functions.bits import bit_words, bits_set, key_filter, may_hold, merged_words
from panelspark.functions.populations import Layer, Reference, layer_populations, unmatched
from panelspark.operators.measures import evaluate
from panelspark.plans import catalog


def test_layers_are_counted_like_distinct_counts(spark):
    rng = random.Random(1)
    a = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), rng.randint(0, 9)) for _ in range(200)]
    b = [(5, "x", None)]
    one = spark.createDataFrame(a, "h int, b string, s int")
    two = spark.createDataFrame(b, "h int, b string, s int")
    none = spark.createDataFrame([], "h int, b string, s int")
    layers = [Layer(one, "h", "b", "s"), Layer(two, "h"), Layer(none, "h", "b", "s"), Layer(one), Layer(two, amount="s")]
    got = {r.layer: r for r in layer_populations(layers).collect()}
    seen = [(r.rows, r.households, r.baskets, None if r.amount is None else int(r.amount)) for _, r in sorted(got.items())]
    assert seen == [(200, 3, 2, sum(s for *_, s in a)), (1, 1, None, None), (0, 0, 0, None), (200, None, None, None), (1, None, None, None)]


def test_unmatched_keys_equal_anti_joins(spark):
    rng = random.Random(2)
    uses = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 10, 11])) for _ in range(300)]
    rows = spark.createDataFrame(uses, "p int, q int")
    p = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    q = spark.createDataFrame([(10,), (10,), (1,)], "id int")
    refs = [Reference(rows, [("p_lost", "p", "p"), ("q_lost", "q", "q")]), Reference(rows, [("p_in_q", "p", "q")])]
    got = unmatched(refs, [("p", p, "id"), ("q", q, "id")]).first().asDict()
    assert got == {
        "p_lost": sum(x not in (1, 2) for x, _ in uses),
        "q_lost": sum(y not in (10, 1) for _, y in uses),
        "p_in_q": sum(x not in (10, 1) for x, _ in uses),
    }
    nothing = unmatched(refs[:1], [("p", p.where("false"), "id"), ("q", q.where("false"), "id")]).first()
    assert tuple(nothing) == (300, 300)


def test_bits_count_distinct_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, *range(-70, 200)])) for _ in range(150)] + [("c", None), ("d", 10**6)]
    df = spark.createDataFrame(rows, "k string, n int")
    words = bit_words("n", -70, 199)
    names = [f"w{i}" for i in range(len(words))]
    out = df.groupBy("k", F.pmod(F.hash("n"), F.lit(3))).agg(*[c.alias(n) for n, c in zip(names, words)])
    got = dict(out.groupBy("k").agg(bits_set(merged_words(names)).alias("n")).collect())
    assert got == {k: len({n for g, n in rows if g == k and n is not None and n < 200}) for k in "abcd"}


def test_key_filter_misses_no_key(spark):
    held = spark.range(0, 3000, 3).select(F.col("id").alias("k"), (F.col("id") % 7).alias("b"))
    passed = spark.range(3000).select("id", (F.col("id") % 7).alias("b")).where(may_hold(key_filter(held, "k", "b"), "id", "b"))
    found = {r.id for r in passed.collect()}
    assert set(range(0, 3000, 3)) <= found and len(found) < 1010
    assert spark.range(9).where(may_hold(key_filter(held.where("false"), "k"), "id")).count() == 0


def test_basket_of_several_households_counts_once(spark):
    """A fault the audits report: three households share a basket."""
    rows = [line(h, 50, 3, 1, 1, h, coupon=1 if h == 3 else 0) for h in (1, 2, 3)] + [line(1, 51, 3, 1, 1, 5)]
    w = Warehouse(spark, frames(spark, transaction_data=rows))
    week = w["mart_category_weekly"].collect()
    assert [(r.buying_households, r.category_baskets, float(r.panel_net_spend)) for r in week] == [(3, 2, 11.0)]
    store = w["mart_store_weekly"].collect()
    assert [(r.active_households, r.baskets, r.transaction_lines, r.distinct_products) for r in store] == [(3, 2, 4, 1)]
    own = as_dicts(w["mart_category_household"], "household_key")
    assert {h: (r["category_baskets"], r["coupon_baskets"], r["active_days"]) for h, r in own.items()} == {
        1: (2, 0, 1), 2: (1, 0, 1), 3: (1, 1, 1),
    }


def test_promotion_weeks_outside_the_plan_are_counted(spark):
    rows = [(1, 1, 1, "0", "0"), (1, 2, 500, "1", "0"), (2, 2, 500, "1", "A"), (2, 2, -3, "0", "A")]
    got = Warehouse(spark, frames(spark, causal_data=rows))["analysis_promotion_universe_audit"].first()
    assert (got.total_rows, got.products, got.stores, got.weeks) == (4, 2, 2, 3)
    assert (got.none_rows, got.display_only_rows, got.display_and_mailer_rows, got.mailer_only_rows) == (1, 1, 1, 1)


def test_trips_without_campaign_are_not_grouped(spark):
    lines = [*PANEL["transaction_data"], *[line(99, 1000 + i, 5, 1, 1, 1) for i in range(200)]]
    w = Warehouse(spark, frames(spark, transaction_data=lines))
    plan = w["mart_campaign_household"]._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan
    assert {r.household_key for r in w["mart_campaign_household"].collect()} == {1, 2, 7}


@pytest.mark.parametrize("where", [F.col, str, None])
def test_column_and_text_filters_work_with_attributes(panel, where):
    kept = "basket_net_spend > 3"
    given = None if where is None else kept if where is str else F.expr(kept)
    rows = as_dicts(evaluate(panel, ["Baskets"], ["dim_household.age_desc"], given), "age_desc")
    assert sum(r["value"] for r in rows.values()) == (6 if where is None else 5)


AGE = "dim_household.age_desc = '25-34'"


@pytest.mark.parametrize(
    "where, joined",
    [
        (AGE, False),
        (lambda: F.col("dim_household__age_desc") == "25-34", False),
        ([AGE, "basket_net_spend > 3"], False),
        (f"{AGE} AND basket_net_spend > 3", True),
        ("dim_household.age_desc IS NULL OR dim_household.age_desc <> '25-34'", False),
        ([AGE, "dim_day.day_key > 3"], False),
    ],
)
def test_attribute_filters_reach_the_keys_before_the_sum(panel, where, joined):
    where = where() if callable(where) else where
    got = {r.measure: r.value for r in evaluate(panel, ["Baskets", "Panel Net Spend"], where=where).collect()}

    def plan(where):
        out = evaluate(panel, ["Baskets"], where=where)._jdf.queryExecution().optimizedPlan().toString()
        return len(re.findall("Left(?:Semi|Anti)", out))

    # only a condition over two tables joins attributes
    assert (plan(where) > plan(None)) != joined
    rows = panel["mart_basket"].join(panel["dim_household"].select("household_key", "age_desc"), "household_key", "left")
    for part in where if isinstance(where, list) else [where]:
        text = part if isinstance(part, str) else AGE
        rows = rows.where(text.replace("dim_household.", "").replace("dim_day.", ""))
    wanted = rows.agg(F.count(F.lit(1)), F.sum("basket_net_spend")).first()
    assert (got["Baskets"], got["Panel Net Spend"]) == (wanted[0], None if wanted[1] is None else float(wanted[1]))
    assert got["Baskets"] > 0


def test_written_tables_are_counted_by_their_write(spark, panel, tmp_path):
    from panelspark.operators.quality import REQUIRED_ASSETS

    build = panel.fork()
    build.materialise(str(tmp_path), REQUIRED_ASSETS)
    assert build.written == {n: panel[n].count() for n in REQUIRED_ASSETS}
    audit = build["governed_asset_audit"]
    named = "analysis_promotion_universe_audit"
    leaves = audit._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert leaves <= (1 if named in REQUIRED_ASSETS else 2)
    assert sorted(map(str, audit.collect())) == sorted(map(str, panel["governed_asset_audit"].collect()))
    build.replace(REQUIRED_ASSETS[0], panel[REQUIRED_ASSETS[0]])
    assert REQUIRED_ASSETS[0] not in build.written


NO_EXPAND = (
    "mart_category_weekly", "mart_brand_category", "mart_promotion_category_week", "mart_category_household",
    "mart_category_household_weekly", "mart_store_weekly", "analysis_promotion_universe_audit",
    "promotion_universe_raw_audit", "qa_layer_reconciliation", "qa_reference_coverage", "root_cause_periods",
    "root_cause_drivers", "finding_window_comparison", "mart_campaign_summary",
)


@pytest.mark.parametrize("name", NO_EXPAND)
def test_no_row_is_repeated_per_distinct_count(panel, name):
    plan = panel[name]._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\bExpand\b", plan)
    assert name in catalog.QUERIES
