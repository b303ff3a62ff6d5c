from decimal import Decimal

from pyspark.sql import functions as F

from panelspark.operators import profiles

KINDS = "a long, b int, c decimal(18,4), d double, e string, f decimal(38,10), g decimal(18,0), `h.i` tinyint"


def odd_rows():
    whole = [0, 1, 9, 10, 63, 64, 99, 100, 127, 1000, 12345, -1, -9, -10, -64, -65, -100, 2**31, 2**63 - 1, -(2**63), 7, 7]
    rows = [(None,) * 8, (None, None, None, float("nan"), "", None, None, None), (1, 1, None, -0.0, "  ", None, None, 1)]
    for n in whole:
        small = n if abs(n) < 10**9 else n // 2**40
        money, big = Decimal(small * 37).scaleb(-4), Decimal(n).scaleb(-10)
        rows.append((n, small % 2**31 - 2**30, money, n / 8, f"t{n}", big, Decimal(10**18 - 1) * (1 if n > 0 else -1), small % 100 - 50))
    return rows


def by_texts(df):
    out = {}
    for place, (name, _) in enumerate(df.dtypes):
        text = F.col(f"`{name}`").cast("string")
        blank = F.count_if(text.isNull() | (F.trim(text) == ""))
        out[place] = tuple(df.agg(F.count(F.lit(1)), blank, F.countDistinct(text), F.min(text), F.max(text)).first())
    return out


def test_profile_of_blocks_is_that_of_texts(spark):
    for rows in (odd_rows(), odd_rows()[:1], odd_rows()[5:9], odd_rows()[12:14]):
        df = spark.createDataFrame(rows, KINDS).repartition(3)
        got = {r.place: tuple(r)[1:] for r in profiles._column_summary(profiles.cell_counts(df), df).collect()}
        assert got == by_texts(df)


def test_near_numbers_are_one_row_of_the_exchange(spark):
    df = spark.range(-6400, 6400).selectExpr("id", "(id / 100)::decimal(18,2) money", "id::string text")
    rows = dict(profiles.cell_counts(df).groupBy("place").count().collect())
    assert rows == {0: 200, 1: 200, 2: 12800}
