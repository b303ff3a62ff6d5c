"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a hash of its id. Words are summed by source and hash bucket (three hex
digits at a time), the bucket that crosses a source's budget is found and only that bucket is
split further; the final filter compares each document's hash with its source's threshold, so
nothing is ever sorted. DataFrame functions only.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source
of its own and comes last; a null id hashes like the empty string; repeated rows share a hash
and are taken or left together; an empty table gives an empty mix. Only the three named columns
are read, so other columns cannot clash.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that one histogram resolves, and how often the boundary is refined.
DIGITS, LEVELS = 3, 3
#: Up to so many sources (one short row each) their thresholds are broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Per source ``key``: ``source_size``, ``target``, whole ``copies`` and the ``rest`` to draw.

    ``sizes`` has one row per source (key, source, source_size). Sources take ``weights`` in turn
    by code point. A target stops at ``most`` times its source; what is over goes to the others
    by weight. With sources ordered by size per weight, the level paid per unit of weight is the
    largest of the levels left after the smaller ones are full.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    at = ((F.row_number().over(turn) - 1) % len(weights)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("bigint")
    full = F.lit(most) * F.col("source_size")
    level = Window.orderBy(F.col("_full") / F.col("weight"), F.col("key"))
    before = F.coalesce(F.sum("_full").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    ranked = sizes.withColumns({"weight": weight, "_full": full}).withColumn(
        "_level", (F.sum("source_size").over(everything) - before) / after
    )
    target = F.least(
        F.col("_full").cast("double"), F.col("weight") * F.max("_level").over(everything)
    )
    copies = F.when(
        F.col("source_size") > 0,
        F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size"))),
    ).otherwise(0)
    return (
        ranked.withColumn("target", target)
        .withColumn("copies", copies.cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .select("key", "source_size", "target", "copies", "rest")
    )


def _crossing(histogram: DataFrame) -> DataFrame:
    """Of each source's buckets, the one in which the running sum passes ``rest``."""
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("words").over(ahead), F.lit(0))
    return histogram.withColumn("before", before).where(
        (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    )


def _key(source: str):
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _hash(doc_id: str):
    digits = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.substring(digits, 1, DIGITS * LEVELS)


def _cuts(rows: DataFrame, weights: Sequence[int], most: int):
    """Per source its size, target, whole copies and hash threshold; and how to join them."""
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = pinned(source_targets(sizes, weights, most))
    # One row per source: with few sources no row of a hot one has to move.
    beside = F.broadcast if plan.count() <= BROADCAST_SOURCES else lambda df: df
    edge = plan.select("key", "rest", F.lit("").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    for level in range(LEVELS):
        part = F.substring("hash", 1 + level * DIGITS, DIGITS)
        inside = rows.join(beside(edge), "key").where(F.col("hash").startswith(F.col("prefix")))
        histogram = inside.groupBy("key", "rest", "prefix", "before", part.alias("part")).agg(
            F.sum("size").alias("words")
        )
        edge = pinned(
            _crossing(histogram).select(
                "key", "rest", F.concat("prefix", "part").alias("prefix"), "before", "words"
            )
        )
    last = edge.select(
        "key", "prefix", (F.col("before") + F.col("words") / 2 <= F.col("rest")).alias("with_last")
    )
    cut = pinned(plan.select("key", "source_size", "target", "copies").join(last, "key", "left"))
    return cut, beside


def _copies():
    extra = (F.col("hash") < F.col("prefix")) | ((F.col("hash") == F.col("prefix")) & F.col("with_last"))
    return F.col("copies") + F.coalesce(extra, F.lit(False)).cast("bigint")


def _measured(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return pinned(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _key(source).alias("key"),
            word_count(F.col(text)).alias("size"), _hash(doc_id).alias("hash"),
        )
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` is ``size`` times the copies the mix takes. Each source's total differs from its
    target by at most half of the documents that share the last hash bucket (36 bits), which is
    one document unless rows repeat.
    """
    rows = _measured(docs, doc_id, text, source)
    cut, beside = _cuts(rows, weights, most)
    return rows.join(beside(cut), "key").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken")
    )


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The table with every row as often as the mix takes it; a row without words once, if its hash is
    under its source's threshold or whole copies are taken. Texts are not shuffled."""
    cut, beside = _cuts(_measured(docs, doc_id, text, source), weights, most)
    tag = "_mix"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    names = [f"{tag}_{c}" for c in cut.columns]
    taken = cut.toDF(*names)
    row_hash = _hash(doc_id)
    prefix = F.col(f"{tag}_prefix")
    extra = (row_hash < prefix) | ((row_hash == prefix) & F.col(f"{tag}_with_last"))
    copies = F.col(f"{tag}_copies") + F.coalesce(extra, F.lit(False)).cast("bigint")
    joined = docs.join(beside(taken), _key(source) == F.col(f"{tag}_key")).withColumn(f"{tag}_n", copies)
    repeated = joined.where(F.col(f"{tag}_n") > 0).withColumn(
        f"{tag}_at", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"{tag}_n")))
    )
    return repeated.select(*docs.columns)
