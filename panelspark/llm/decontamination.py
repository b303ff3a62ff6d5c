"""Benchmark decontamination with a broadcast set of test n-grams.

Benchmark items are cut into windows of ``width`` consecutive words (a shorter item is one window).
The distinct windows, keyed by a 64-bit hash, are the set that training text is held against: every
document is scanned once, each of its windows of the same lengths is looked up by hash, and a hit is
verified word by word. The set is broadcast while it weighs at most ``BROADCAST_BYTES``, measured
first; a larger one is joined by shuffle on the hash. Hits leave the scan as word positions, so no text
moves. DataFrame functions only.

Words are compared with A-Z lower-cased; letters are digits, a-z and everything from U+0080 on.

Defined results: a null or empty text has no words and no hits; a null document id is a key like any
other; rows that repeat both id and text each get their result; benchmark items are known by their
id (a null id reads as the empty string), and an item without words has no window. Empty tables give
no rows, or no hits. Only the named columns are read, so other columns cannot clash; helper columns
of :func:`decontaminate` take free names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned

#: Weight of the window set up to which it is broadcast (its words and ``ROW`` bytes per window).
BROADCAST_BYTES, ROW = 64_000_000, 120
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII but for digits and letters. As a regular expression, and listed.
GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
GAPS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(text: Column) -> Column:
    """One pass over the characters and a split at single blanks, which needs no pattern matching."""
    plain = F.translate(F.coalesce(text, F.lit("")), GAPS + UPPER, " " * len(GAPS) + LOWER)
    return F.array_remove(F.split(plain, " "), "")


def benchmark_windows(benchmark: DataFrame, width: int, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(windows, members): the distinct windows, and which items each of their keys stands for.

    Windows of one item only share that item's key; a window of several items has a key of its own,
    so that no list of items is gathered and a document collects few keys.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("words")
    ).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(width))
    occurs = items.select("item", "words", F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at")).select(
        "item", F.slice("words", F.col("at"), size).alias("window")
    )
    own = F.min("item") == F.max("item")
    windows = (
        occurs.groupBy("window")
        .agg(F.when(own, F.concat(F.lit("i"), F.min("item"))).alias("own"))
        .select(
            F.xxhash64("window").alias("hash"),
            "window",
            F.coalesce("own", F.concat(F.lit("w"), F.md5(F.array_join("window", " ").cast("binary")))).alias("key"),
        )
    )
    members = occurs.join(windows, "window").select("key", "item").distinct()
    return windows, members


def _spans(hits: Column, width: int) -> Column:
    """Merged [start, end) of hits, which are at most ``width`` long, in word positions.

    Of the hits at one start the longest stands; a span opens where none of the ``width`` starts
    before reaches this one, and closes where the next start is not reached.
    """
    ordered = F.sort_array(hits)
    longest = F.filter(
        ordered, lambda h, i: F.coalesce(F.get(ordered, i + 1)["start"] != h["start"], F.lit(True))
    )
    return F.transform(
        F.array(longest),
        lambda s: F.arrays_zip(
            F.transform(
                F.filter(s, lambda h, i: F.coalesce(_reach(s, i - 1, width) < h["start"], F.lit(True))),
                lambda h: h["start"],
            ).alias("start"),
            F.filter(
                F.transform(
                    s,
                    lambda h, i: F.when(
                        F.coalesce(_reach(s, i, width) < F.get(s, i + 1)["start"], F.lit(True)), _reach(s, i, width)
                    ),
                ),
                lambda e: e.isNotNull(),
            ).alias("end"),
        ),
    )[0]


def _reach(hits: Column, last: Column, width: int) -> Column:
    """Furthest end among the ``width`` hits up to position ``last``; null before the first."""
    first = F.greatest(last - width + 1, F.lit(0))
    return F.when(
        last >= 0, F.array_max(F.transform(F.slice(hits, first + 1, last - first + 1), lambda h: h["end"]))
    )


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, digest (MD5 of its text), n_words, spans, items.

    ``spans`` are the merged hit ranges [start, end) in word positions from 0, ``items`` the sorted ids
    of the benchmark items with occurring windows.
    """
    each = _found(docs, benchmark, width, doc_id, text, item_id, item_text)
    return each.select("*", F.explode(F.sequence(F.lit(1), "copies"))).drop("col", "copies")


def _found(docs, benchmark, width, doc_id, text, item_id, item_text):
    """As :func:`find`, rows that repeat id and text counted in ``copies``."""
    windows, members = map(pinned, benchmark_windows(benchmark, width, item_id, item_text))
    weight = F.sum(F.length(F.array_join("window", " ")) + ROW).cast("bigint")
    known = windows.agg(weight, F.collect_set(F.size("window"))).first()  # at most ``width`` lengths
    light, lengths = (known[0] or 0) <= BROADCAST_BYTES, sorted(known[1])

    body = F.coalesce(F.col(text), F.lit(""))
    scanned = docs.select(
        F.col(doc_id).alias("doc_id"), F.md5(body.cast("binary")).alias("digest"), words_of(body).alias("words")
    )
    size = F.size("words")
    # A window is one number, start * width + length - 1; -1 is one row more per document, which stays
    # whether or not anything is found. Windows are cut after the explode, inside generated code.
    none = F.array().cast("array<int>")
    codes = [
        F.when(size >= n, F.sequence(F.lit(n - 1), (size - n) * width + n - 1, F.lit(width))).otherwise(none)
        for n in lengths
    ]
    start, n = F.floor(F.col("code") / width).cast("int"), F.col("code") % width + 1
    gram = F.slice("words", F.col("start") + 1, F.col("n"))
    every = scanned.select(
        "doc_id", "digest", size.alias("n_words"), "words", F.explode(F.concat(F.array(F.lit(-1)), *codes)).alias("code")
    ).select(
        "doc_id", "digest", "n_words", "words", F.when(F.col("code") >= 0, start).otherwise(-1).alias("start"),
        F.when(F.col("code") >= 0, n).otherwise(0).alias("n"),
    )
    every = every.withColumn("gram", F.when(F.col("start") >= 0, gram)).withColumn(
        "hash", F.when(F.col("start") >= 0, F.xxhash64("gram")).otherwise(F.xxhash64("digest"))
    )
    met = every.drop("words").join(F.broadcast(windows) if light else windows, "hash", "left")
    is_mark = F.col("start") < 0
    hit = ~is_mark & (F.col("gram") == F.col("window"))
    position = F.when(hit, F.struct("start", (F.col("start") + F.col("n")).alias("end")))
    kept = met.where(is_mark | hit).select(
        "doc_id", "digest", "n_words", is_mark.alias("mark"), position.alias("position"),
        F.when(hit, F.col("key")).alias("key"),
    )
    rows = kept.groupBy("doc_id", "digest", "n_words").agg(
        F.count_if("mark").alias("copies"), F.collect_set("position").alias("hits"), F.collect_set("key").alias("keys")
    )
    rows = rows.select("doc_id", "digest", "n_words", "copies", _spans(F.col("hits"), width).alias("spans"), "keys")
    few = F.broadcast(members) if light else members
    # a document without hits keeps a key of its own, which no item has
    keys = F.when(F.size("keys") == 0, F.array(F.concat(F.lit("-"), "digest"))).otherwise(F.col("keys"))
    each = rows.select("doc_id", "digest", "n_words", "copies", "spans", F.explode(keys).alias("key"))
    return (
        each.join(few, "key", "left")
        .groupBy("doc_id", "digest", "n_words")
        .agg(
            F.first("copies").alias("copies"), F.first("spans").alias("spans"),
            F.sort_array(F.collect_set("item")).alias("items"),
        )
    )


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "spans",
    width: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The documents in their own columns, hit words cut out of the texts (``remove="spans"``) or
    whole documents left out (``"documents"``).

    With a hit word goes what separates it from the word before; all else stays as it is.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove: spans or documents")
    found = _found(docs, benchmark, width, doc_id, text, item_id, item_text)
    dirty = found.where(F.size("spans") > 0).select(
        F.col("doc_id").alias("_found_id"), F.col("digest").alias("_found_digest"), F.col("spans").alias("_found_spans")
    )
    for c in dirty.columns:
        free = c
        while free in docs.columns:
            free += "_"
        dirty = dirty.withColumnRenamed(c, free)
    found_id, found_digest, found_spans = (dirty[c] for c in dirty.columns)
    body = F.coalesce(docs[text], F.lit(""))
    same = docs[doc_id].eqNullSafe(found_id) & (F.md5(body.cast("binary")) == found_digest)
    if remove == "documents":
        return docs.join(dirty, same, "left_anti")
    joined = docs.join(dirty, same, "left")
    cut = F.when(found_spans.isNull(), docs[text]).otherwise(_without(body, found_spans))
    return joined.select(*[(cut if c == text else docs[c]).alias(c) for c in docs.columns])


def _without(text: Column, spans: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(f"[{GAP}]*[^{GAP}]+"), F.lit(0))
    tail = F.regexp_extract(text, f"[{GAP}]*\\z", 0)
    kept = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.array_join(
            F.slice(
                tokens,
                F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1,
                F.coalesce(F.get(spans, i)["start"], F.size(tokens)) - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)),
            ),
            "",
        ),
    )
    return F.concat(F.array_join(kept, ""), tail)
