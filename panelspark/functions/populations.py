"""Populations and key coverage of many tables from one aggregation.

Tables are reduced on their own to key counts, tagged and stacked; one grouping by (kind, key) then
merges the tags of every key as bits. How many keys a table holds, and which keys no member table
has, is read off those bits, without a distinct count or a join per table.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AMOUNT = "decimal(38,4)"


@dataclass(frozen=True)
class Layer:
    """A table with its rows, and optionally a household and a basket column and an amount."""

    rows: DataFrame
    household: str | None = None
    basket: str | None = None
    amount: str | None = None


def stacked(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def layer_populations(layers: Sequence[Layer]) -> DataFrame:
    """(layer, rows, households, baskets, amount): one row per layer, by its position.

    Distinct households and baskets leave out nulls; they are NULL for a layer without that column.
    Every layer is read once. At most 62 layers, one bit each.
    """
    if len(layers) > 62:
        raise ValueError("at most 62 layers")
    parts = []
    for i, layer in enumerate(layers):
        amount = F.sum(layer.amount).cast(AMOUNT) if layer.amount else F.lit(None).cast(AMOUNT)
        sums = [F.count(F.lit(1)).alias("_n"), amount.alias("_amount")]
        columns = {k: c for k, c in (("household", layer.household), ("basket", layer.basket)) if c}
        counted = layer.rows.groupBy(*[F.col(c).cast("string").alias(k) for k, c in columns.items()]).agg(*sums)
        missing = {k: F.lit(None).cast("string") for k in ("household", "basket") if k not in columns}
        parts.append(counted.withColumns({"layer": F.lit(i), **missing}))
    totals, households, baskets = F.lit(0), F.lit(1), F.lit(2)
    none, no_amount = F.lit(0).cast("bigint"), F.lit(None).cast(AMOUNT)
    entries = F.array(
        # totals are kept apart by layer, keys are shared by all layers
        F.struct(totals.alias("kind"), F.col("layer").cast("string").alias("key"), F.col("_n").alias("n"), F.col("_amount").alias("amount")),
        F.struct(households.alias("kind"), F.col("household").alias("key"), none.alias("n"), no_amount.alias("amount")),
        F.struct(baskets.alias("kind"), F.col("basket").alias("key"), none.alias("n"), no_amount.alias("amount")),
    )
    merged = (
        stacked(parts)
        .select("layer", F.explode(entries).alias("e"))
        .select("layer", "e.*")
        .where("key IS NOT NULL")
        .groupBy("kind", "key")
        .agg(F.bit_or(F.expr("shiftleft(1L, layer)")).alias("bits"),
             F.sum("n").alias("n"), F.sum("amount").cast(AMOUNT).alias("amount"))
    )
    # one row in all: per layer, how many keys of each kind carry its bit
    read = []
    for i, layer in enumerate(layers):
        here = (F.shiftright("bits", i) % 2 == 1)
        of = {k: here & (F.col("kind") == v) for k, v in (("rows", 0), ("households", 1), ("baskets", 2))}
        unknown = F.lit(None).cast("bigint")
        read.append(
            F.struct(
                F.lit(i).alias("layer"),
                F.coalesce(F.sum(F.when(of["rows"], F.col("n"))), none).alias("rows"),
                (F.count_if(of["households"]) if layer.household else unknown).alias("households"),
                (F.count_if(of["baskets"]) if layer.basket else unknown).alias("baskets"),
                F.max(F.when(of["rows"], F.col("amount"))).alias("amount"),
            )
        )
    return merged.agg(F.array(*read).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@dataclass(frozen=True)
class Reference:
    """A table whose columns refer to members of a kind: (name of the check, column, kind)."""

    rows: DataFrame
    columns: Sequence[tuple[str, str, str]]


def unmatched(
    references: Sequence[Reference], members: Sequence[tuple[str, DataFrame, str]], key_type: str = "bigint"
) -> DataFrame:
    """One row with a column per check: rows whose key is null or no member of its kind.

    ``members`` are (kind, table, column). A table with several checks is read once and becomes
    key counts, so that a heavy key is one row; the merge sees distinct keys only.
    """
    names = [name for r in references for name, _, _ in r.columns]
    kinds = [kind for kind, _, _ in members]

    def tagged(kind, column, check):
        key = F.col(column).cast(key_type).alias("key")
        return F.lit(kinds.index(kind)).alias("kind"), key, F.lit(check).alias("check")

    parts = []
    for r in references:
        uses = [tagged(kind, c, names.index(name)) for name, c, kind in r.columns]
        if len(uses) == 1:
            parts.append(r.rows.select(*uses[0]))
        else:
            parts.append(r.rows.select(F.explode(F.array(*[F.struct(*u) for u in uses])).alias("e")).select("e.*"))
        parts[-1] = parts[-1].groupBy("kind", "key", "check").agg(F.count(F.lit(1)).alias("n"))
    for kind, rows, c in members:
        parts.append(rows.where(F.col(c).isNotNull()).select(*tagged(kind, c, -1), F.lit(0).cast("bigint").alias("n")))
    merged = stacked(parts).groupBy("kind", "key").agg(
        F.min("check").alias("least"),
        *[F.sum(F.when(F.col("check") == i, F.col("n"))).alias(f"n{i}") for i in range(len(names))],
    )
    zero = F.lit(0).cast("bigint")
    return merged.where(F.col("key").isNull() | (F.col("least") >= 0)).agg(
        *[F.coalesce(F.sum(f"n{i}"), zero).alias(name) for i, name in enumerate(names)]
    )
