"""Connected components of a link table, by spreading the smallest id and jumping pointers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in a link (a, b), the smallest id it reaches.

    A round takes the smallest label among the neighbours and then the label of that label, so a
    chain of n links needs about log2(n) rounds. Every round is pinned. Each row is one link or
    one id; nothing is gathered per component.
    """
    both = pinned(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        .where(F.col("a") != F.col("b")).distinct()
    )
    labels = pinned(
        both.groupBy("a").agg(F.min("b").alias("_b"))
        .select(F.col("a").alias("id"), F.least("a", "_b").alias("component"))
    )
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy("a").agg(F.min("component").alias("_near"))
        )
        spread = labels.join(near.withColumnRenamed("a", "id"), "id").select(
            "id", F.col("component").alias("_old"), F.least("component", "_near").alias("_new")
        )
        target = labels.select(F.col("id").alias("_new"), F.col("component").alias("_jump"))
        moved = pinned(
            spread.join(target, "_new", "left").select(
                "id", "_old", F.least("_new", F.coalesce("_jump", "_new")).alias("component")
            )
        )
        labels = moved.select("id", "component")
        if moved.where(F.col("_old") != F.col("component")).isEmpty():
            return labels
