"""Contiguous balanced shards from global byte-size prefix sums.

Documents are laid out in the order of their text's MD5, so that equal texts lie together. Bytes and
rows are totalled per stretch of that order (a 20-bit prefix), the totals are summed up in order, and
only then every row finds its own position inside its stretch. Cutting the positions at equal targets
gives contiguous shards. A group of equal texts goes whole where its middle falls, which keeps copies
in one shard, however large the table or what else lies beside it. Only a group that itself weighs more
than ``whole`` of a shard is cut row by row: its rows are stretches of their own, by a prefix of the
id's MD5. There are at most shards / ``whole`` such groups. DataFrame functions only.

Defined results: a null text weighs ``overhead`` and counts as the empty text; a null id hashes
like the empty string; repeated rows get neighbouring slots; an empty table gives no rows. Only
the two named columns are read, so other columns cannot clash.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned


def shard(
    docs: DataFrame,
    shards: int = 24,
    overhead: int = 8,
    whole: float = 0.02,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 per shard).

    A group of at most ``whole`` times the target is kept in one shard, so shards differ from the
    target by at most that share plus one document.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    rows = pinned(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.length(body) + overhead).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.md5(body).alias("digest"),
            F.substring(F.md5(ident), 1, 3).alias("id_part"),
        )
    )
    total = rows.agg(F.sum("size")).scalar()
    heavy = pinned(
        rows.groupBy("digest").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * shards > F.lit(whole) * total)
        .select("digest", F.lit(True).alias("heavy"))
    )
    spread = rows.join(F.broadcast(heavy), "digest", "left").withColumns(
        {
            "stretch": F.when(F.col("heavy"), F.col("digest")).otherwise(F.substring("digest", 1, 5)),
            "part": F.when(F.col("heavy"), F.col("id_part")).otherwise(""),
            "bucket": F.substring("digest", 1, 3),
        }
    )
    cells = pinned(
        spread.groupBy("bucket", "stretch", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    )
    until = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    # At most 4096 buckets meet in one place.
    along = Window.orderBy("bucket").rowsBetween(*until)
    buckets = (
        cells.groupBy("bucket")
        .agg(F.sum("bytes").alias("_b"), F.sum("n").alias("_n"))
        .select(
            "bucket",
            F.coalesce(F.sum("_b").over(along), zero).alias("bytes_before"),
            F.coalesce(F.sum("_n").over(along), zero).alias("n_before"),
            F.sum("_b").over(Window.partitionBy()).alias("total"),
        )
    )
    inside = Window.partitionBy("bucket").orderBy("stretch", "part").rowsBetween(*until)
    grid = cells.join(buckets, "bucket").select(
        "stretch", "part", "total",
        (F.col("bytes_before") + F.coalesce(F.sum("bytes").over(inside), zero)).alias("cell_start"),
        (F.col("n_before") + F.coalesce(F.sum("n").over(inside), zero)).alias("cell_rank"),
    )
    order = ("digest", "doc_id", "text_crc32", "size")
    here = Window.partitionBy("stretch", "part").orderBy(*order).rowsBetween(*until)
    group = Window.partitionBy("stretch", "part", "digest")
    ranked = spread.withColumns(
        {
            "_bytes": F.coalesce(F.sum("size").over(here), zero),
            "_rows": F.coalesce(F.count(F.lit(1)).over(here), zero),
        }
    )
    # a group's unit is the group, or the row where the group is cut
    unit = ranked.withColumns(
        {
            "_start": F.when(F.col("heavy"), F.col("_bytes")).otherwise(F.min("_bytes").over(group)),
            "_size": F.when(F.col("heavy"), F.col("size")).otherwise(F.sum("size").over(group)),
        }
    ).join(grid, ["stretch", "part"])
    middle = (F.col("cell_start") + F.col("_start")) * 2 + F.col("_size")
    at = F.least(F.floor(middle * shards / (F.col("total") * 2)), F.lit(shards - 1)).cast("int")
    placed = pinned(
        unit.select(
            "doc_id", "size", "text_crc32", at.alias("shard"),
            (F.col("cell_rank") + F.col("_rows")).alias("rank"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )
