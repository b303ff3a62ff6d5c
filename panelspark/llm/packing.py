"""Packing into optimal length buckets.

Documents are cut into pieces of at most ``context`` tokens. The global histogram of piece lengths
(at most ``context`` rows, however large the corpus) goes to a dynamic program that picks the
bucket boundaries with the least padding; batches of at most ``token_budget`` padded tokens are
then filled inside each bucket.

Batch numbers come from counts, not from a global sort: a bucket is split into salted groups of
about ``group_rows`` pieces, a piece is numbered inside its group and shifted by the groups before
it. So a bucket that holds most of the corpus is still many tasks, and only the last batch of a
bucket can be short.

Defined results: a document has its words plus one end token, so a null or empty text is one piece
of one token; repeated rows are packed as often as they occur; a null id is kept; an empty table
gives no rows. Only the named columns are read, so other columns cannot clash.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned

from .mixing import word_count


def best_boundaries(lengths, counts, buckets: int) -> list[int]:
    """The at most ``buckets`` upper bounds that minimise total padding, by dynamic programming.

    ``cost[k][j]``: least padding of the lengths up to the j-th with k buckets, the last of which
    ends at the j-th length. Ties take the smaller split.
    """
    order = np.argsort(lengths)
    size, n = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    if not len(size):
        return []
    rows = np.concatenate([[0], np.cumsum(n)])
    tokens = np.concatenate([[0], np.cumsum(n * size)])
    buckets = min(buckets, len(size))
    cost = rows[1:] * size - tokens[1:]
    back = []
    for _ in range(1, buckets):
        best, split = cost.copy(), np.zeros(len(size), dtype=np.int64)
        for j in range(1, len(size)):
            # lengths i..j in the last bucket, 1 <= i <= j
            i = np.arange(1, j + 1)
            total = cost[i - 1] + (rows[j + 1] - rows[i]) * size[j] - (tokens[j + 1] - tokens[i])
            at = int(np.argmin(total))
            if total[at] < best[j]:
                best[j], split[j] = total[at], i[at]
        back.append(split)
        cost = best
    ends, j = [], len(size) - 1
    for split in reversed(back):
        if split[j]:
            ends.append(int(size[j]))
            j = int(split[j]) - 1
    return [int(size[j]), *reversed(ends)]


def pieces(docs: DataFrame, context: int, tokens: Column, doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, n_tokens."""
    counted = docs.select(F.col(doc_id).alias("doc_id"), tokens.cast("bigint").alias("_n"))
    last = F.floor((F.col("_n") - 1) / context).cast("bigint")
    cut = counted.select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * context
    return cut.select(
        "doc_id", "piece", start.alias("start"), F.least(F.lit(context), F.col("_n") - start).alias("n_tokens")
    )


def pack(
    docs: DataFrame,
    context: int = 2048,
    token_budget: int = 65536,
    buckets: int = 8,
    group_rows: int = 2000,
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """Placements: doc_id, piece, start, n_tokens, bucket, boundary, batch, slot.

    ``tokens`` (an expression of at least 1) replaces the count of words plus one.
    """
    if not 0 < context <= token_budget or buckets < 1:
        raise ValueError("0 < context <= token_budget and at least one bucket are needed")
    length = word_count(F.col(text)) + 1 if tokens is None else tokens
    rows = pinned(pieces(docs, context, length, doc_id))
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    ends = best_boundaries([r.n_tokens for r in histogram], [r.n for r in histogram], buckets)
    if not ends:
        return rows.select(
            "doc_id", "piece", "start", "n_tokens", F.lit(0).alias("bucket"),
            F.lit(0).cast("bigint").alias("boundary"), F.lit(0).cast("bigint").alias("batch"),
            F.lit(0).cast("bigint").alias("slot"),
        )
    held = np.bincount(np.searchsorted(ends, [r.n_tokens for r in histogram]),
                       weights=[r.n for r in histogram], minlength=len(ends))
    groups = [max(1, -(-int(n) // group_rows)) for n in held]

    def of_bucket(values):
        return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("bucket") + 1)

    over = [(F.col("n_tokens") > e).cast("int") for e in ends]
    mixed = F.xxhash64("doc_id", "piece")
    put = rows.withColumn("bucket", sum(over[1:], over[0])).withColumns(
        {"_hash": mixed, "_group": F.pmod(mixed, of_bucket(groups)), "boundary": of_bucket(ends)}
    )
    sizes = put.groupBy("bucket", "_group").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("bucket").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("bucket", "_group", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("bucket", "_group").orderBy("_hash", "doc_id", "piece")
    number = F.col("_shift") + F.row_number().over(inside) - 1
    room = F.floor(F.lit(token_budget) / F.col("boundary")).cast("bigint")
    return put.join(shift, ["bucket", "_group"]).withColumn("_at", number).select(
        "doc_id", "piece", "start", "n_tokens", "bucket", "boundary",
        F.floor(F.col("_at") / room).cast("bigint").alias("batch"),
        F.pmod(F.col("_at"), room).alias("slot"),
    )
