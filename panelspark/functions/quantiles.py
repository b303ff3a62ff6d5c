"""Exact interpolated quantiles over value counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned, with_before

#: Up to so many groups (a few bytes each) their sizes are broadcast.
BROADCAST_GROUPS = 100_000


def value_counts(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row per distinct value; repeats collapse before the shuffle."""
    return df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))


def weighted_quantile(
    counts: DataFrame, keys: list[str], column: str, weight: str, share: float, name: str
) -> DataFrame:
    """Exact interpolated quantile per group over value counts, however large one group is."""
    out = weighted_quantiles(counts, keys, column, weight, {name: share})
    return out.select(*keys, name)


def weighted_quantiles(
    counts: DataFrame, keys: list[str], column: str, weight: str, shares: dict[str, float]
) -> DataFrame:
    """Several exact interpolated quantiles per group (one group without keys) in one pass.

    Values are ordered across the cluster and only the two around each wanted position leave
    each group. Group sizes come from partial counts; with keys they are joined to the placed
    values, without keys they are a scalar.
    """
    rows = counts.select(*keys, column, weight)
    placed = pinned(with_before(rows, [F.col(column)], {"before": F.col(weight)}, keys))
    last = (F.sum(weight) - 1).cast("double")
    if keys:
        sizes = placed.groupBy(*keys).agg(last.alias("_last"))
        # one row per group: beside the data if the groups are few, so that no hot group moves
        few = sizes.count() <= BROADCAST_GROUPS
        sized = placed.join(F.broadcast(sizes) if few else sizes, keys)
    else:
        sized = placed.withColumn("_last", placed.agg(last.alias("_last")).scalar())
    found = []
    for name, share in shares.items():
        spot = F.col("_last") * share
        near = (F.col("before") <= F.ceil(spot)) & (F.col("before") + F.col(weight) > F.floor(spot))
        low, high = F.min(F.when(near, F.col(column))), F.max(F.when(near, F.col(column)))
        part = F.max(spot - F.floor(spot))
        found.append((low + (high - low) * part).alias(name))
    return sized.groupBy(*keys).agg(*found)


def grouped_quantile(df: DataFrame, keys: list[str], column: str, share: float, name: str):
    """:func:`weighted_quantile` over the counted values of ``column``."""
    values = df.where(F.col(column).isNotNull()).withColumn(column, F.col(column).cast("double"))
    return weighted_quantile(value_counts(values, column, *keys), keys, column, "_n", share, name)
