"""Column expressions shared by every layer."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line money. Sums of it stay exact whatever the partitioning, unlike DOUBLE sums.
MONEY = T.DecimalType(18, 4)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator, denominator) -> Column:
    """Denominator-safe division: NULL, never 0, when the denominator is 0 or missing."""
    bottom = F.nullif(_col(denominator).cast("double"), F.lit(0.0))
    return _col(numerator).cast("double") / bottom


def mean(c) -> Column:
    """Average taken as exact sum over count, so it does not depend on row order for money."""
    return ratio(F.sum(_col(c)), F.count(_col(c)))


def mean_ratio(c) -> Column:
    """Plain average of a ratio column; its last bits depend on the order of the rows."""
    return F.avg(_col(c).cast("double"))


def total_ratio(c, places: int = 12) -> Column:
    return F.sum(_col(c).cast(f"decimal(38,{places})"))


def mean_when(condition, c) -> Column:
    return mean(F.when(condition, _col(c)))


def median(c) -> Column:
    return F.percentile(_col(c).cast("double"), F.lit(0.5))


def label(c) -> Column:
    """Blank or missing text becomes 'Unknown'."""
    return F.coalesce(F.nullif(F.trim(_col(c)), F.lit("")), F.lit("Unknown"))


def text_or_null(c) -> Column:
    return F.nullif(F.trim(_col(c).cast("string")), F.lit(""))


def category_key(department, commodity) -> Column:
    return F.concat(label(department), F.lit("|"), label(commodity))


def in_first_weeks(week, min_week, weeks: int) -> Column:
    return _col(week) <= min_week + F.lit(weeks - 1)


def in_last_weeks(week, max_week, weeks: int) -> Column:
    return _col(week) > max_week - F.lit(weeks)


def trajectory(early, late, rules) -> Column:
    """Early-against-late label; comparisons with NULL fall through to 'Stable'."""
    early, late = _col(early), _col(late)
    grown = late >= early * F.lit(rules.growing_factor)
    fallen = late <= early * F.lit(rules.declining_factor)
    return (
        F.when(early.isNull() | late.isNull(), "Insufficient History")
        .when(grown, "Growing")
        .when(fallen, "Declining")
        .otherwise("Stable")
    )


def wilson(successes, total, sign: int, z: float = 1.96) -> Column:
    """One bound of the Wilson score interval; NULL when there are no trials."""
    k, n = _col(successes).cast("double"), _col(total).cast("double")
    z2 = z * z
    p = ratio(k, n)
    spread = F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + F.lit(z2) / (n * 4.0)) / n)
    centre = p + F.lit(z2) / (n * 2.0)
    bound = (centre + spread if sign > 0 else centre - spread) / (F.lit(1.0) + F.lit(z2) / n)
    return F.when(n > 0, bound)


def total_rows(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def presented(df: DataFrame) -> DataFrame:
    """Result edge: exact decimals leave as DOUBLE, narrow integers as BIGINT."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)
