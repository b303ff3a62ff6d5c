"""Exact global order statistics without a one-task window.

An unpartitioned window sorts every row in one task. Here rows are range-partitioned on the
wanted order, the partition number is stored with the row by a reliable checkpoint (so later
passes and lost executors all see the same split), and each partition is numbered on its own
and shifted by the totals of the partitions before it. Only those totals, one row per
partition, meet in one place.
"""

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; a local one only for a local master (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return sc.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_before(
    df: DataFrame,
    order: Sequence[Column],
    weights: Mapping[str, Column] | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add, per weight, its total over the rows before this one in the ``within`` group.

    Without weights the column ``before`` counts those rows. ``order`` must be a total order
    inside each group.
    """
    spark = df.sparkSession
    weights = weights or {"before": F.lit(1)}
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(c) for c in within], *order]
    weighted = df.withColumns({f"_w_{n}": c.cast("bigint") for n, c in weights.items()})
    split = pinned(
        weighted.repartitionByRange(cells, *by).withColumn("_cell", F.spark_partition_id())
    )
    until_here = Window.unboundedPreceding, -1
    inside = Window.partitionBy("_cell", *within).orderBy(*order).rowsBetween(*until_here)
    zero = F.lit(0).cast("bigint")
    numbered = split.withColumns(
        {f"_in_{n}": F.coalesce(F.sum(f"_w_{n}").over(inside), zero) for n in weights}
    )
    # At most one row per cell plus one per group boundary.
    totals = split.groupBy("_cell", *within).agg(
        *[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in weights]
    )
    along = Window.partitionBy(*within).orderBy("_cell").rowsBetween(*until_here)
    carry = totals.select(
        F.col("_cell").alias("_c"),
        *[F.col(c).alias(f"_g_{c}") for c in within],
        *[F.coalesce(F.sum(f"_t_{n}").over(along), zero).alias(f"_up_{n}") for n in weights],
    )
    same = F.col("_cell") == F.col("_c")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = numbered.join(carry if within else F.broadcast(carry), same, "left")
    return joined.select(
        *df.columns, *[(F.col(f"_in_{n}") + F.col(f"_up_{n}")).alias(n) for n in weights]
    )


def ntile(df: DataFrame, tiles: int, order: Sequence[Column], name: str) -> DataFrame:
    """NTILE over the whole frame; ``order`` must be a total order."""
    numbered = with_before(df, order)
    n = numbered.agg(F.count(F.lit(1))).scalar()
    small = F.floor(n / F.lit(tiles)).cast("bigint")
    large = small + 1
    extra = (n % F.lit(tiles)).cast("bigint")
    in_large = extra * large
    tile = F.when(
        F.col("before") < in_large, F.floor(F.col("before") / large) + 1
    ).otherwise(
        F.floor((F.col("before") - in_large) / F.nullif(small, F.lit(0).cast("bigint"))) + extra + 1
    )
    return numbered.withColumn(name, tile.cast("int")).drop("before")


def rank_table(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), descending=True):
    """RANK by value: one row per distinct (group, value) with its rank.

    Equal values are counted together before any shuffle, so a heavily tied value costs one row.
    """
    counts = df.groupBy(*within, *order).agg(F.count(F.lit(1)).alias("_n"))
    keys = [F.col(c).desc() if descending else F.col(c).asc_nulls_last() for c in order]
    ranked = with_before(counts, keys, {"before": F.col("_n")}, within)
    return ranked.withColumn("rank", F.col("before") + 1).withColumnRenamed("_n", "ties").drop(
        "before"
    )
