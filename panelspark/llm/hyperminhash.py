"""Near-duplicate documents by HyperMinHash.

Each document's word shingles are dealt to ``registers`` buckets by hash; a bucket keeps only the
leading-zero count (6 bits) and the next 10 mantissa bits of its smallest hash. Empty buckets
borrow from a full one in an order fixed per bucket, so short documents have whole signatures.
Bands of compressed registers propose pairs, the register match rate corrected for accidental
collisions drops hopeless ones, and full shingle sets decide.

Hot groups need care. Documents with the same word sequence are one class. In a band bucket every
class is first compared with one class of the bucket only, the first in one of ``orders`` orders by
hash (so that a group has few such centres, and not only one). Classes that this leaves in
different components are then compared with each other: in small buckets as a table of pairs
(bounded by ``small`` per class), in larger ones inside tasks, one pair of slices at a time, where
pairs whose components have met meanwhile are passed over and only joining links come out. So no
proposed pair that could still join two components is skipped, and none of the many within a hot
group is written down.

With 26 bands of 5 registers a pair of similarity 0.85 shares no band with probability about
2e-7 (at 0.8 about 3e-5; 29 bands of 4 have 2e-7 there); a pair is dropped before verification only if its estimate is ``errors`` standard errors under
the threshold.

Defined results: a null, empty or word-less text has no shingles and is linked with nothing;
fewer words than a shingle are one shingle; repeated rows are copies (of one id, they stay rows of
one component); a null id is carried as a row of its own and takes part in no link; an empty table
gives no rows. Only the two named columns are read, so other columns cannot clash.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned

from .components import components
from .shingles import Powers, folded, scrambled, shingle_set

MANTISSA = 10


def registers_of(hashes: np.ndarray, buckets: int, probe: np.ndarray) -> np.ndarray:
    """Compressed registers (uint16) of a non-empty set of 64-bit hashes."""
    where = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    value = scrambled(hashes ^ np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(value)[::-1]
    least = np.zeros(buckets, dtype=np.uint64)
    full = np.zeros(buckets, dtype=bool)
    least[where[order]] = value[order]  # the smallest is written last
    full[where] = True
    zeros = np.minimum(64 - np.frexp(least.astype(np.float64))[1], 62).clip(0).astype(np.uint64)
    fraction = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    packed = ((zeros << np.uint64(MANTISSA)) | fraction).astype(np.uint16)
    lender = probe[np.arange(buckets), np.argmax(full[probe], axis=1)]
    return packed[np.where(full, np.arange(buckets), lender)]


def lending_order(buckets: int) -> np.ndarray:
    """For each bucket, the order in which it asks the others when it is empty."""
    rng = np.random.default_rng(1)
    return np.stack([rng.permutation(buckets) for _ in range(buckets)]).astype(np.int64)


def collision_table(buckets: int, classes: int = 40) -> np.ndarray:
    """P(two unrelated registers agree), by log2 of each set's size.

    The minimum of n uniform values lies in [a, b) with probability (1-a)^n - (1-b)^n; two
    registers agree if both minima fall into the same cell of leading zeros and mantissa.
    """
    zeros = np.arange(62)[:, None]
    step = np.arange(2**MANTISSA)[None, :]
    low = (2.0 ** -(zeros + 1) * (1 + step / 2**MANTISSA)).ravel()
    high = (2.0 ** -(zeros + 1) * (1 + (step + 1) / 2**MANTISSA)).ravel()
    low, high = np.log1p(-low), np.log1p(-np.minimum(high, 1 - 1e-16))
    load = np.maximum(1.0, 2.0 ** np.arange(classes) / buckets)
    mass = np.empty((classes, len(low)))
    for row, n in zip(mass, load):  # row by row, so that only one table of this size is held
        np.subtract(np.exp(n * low), np.exp(n * high), out=row)
    return mass @ mass.T


def estimated_jaccard(a: np.ndarray, b: np.ndarray, na, nb, table: np.ndarray) -> np.ndarray:
    """Match rate of register rows, less what unrelated registers would share."""
    classes = len(table) - 1
    chance = table[
        np.minimum(np.log2(np.maximum(na, 1)).astype(int), classes),
        np.minimum(np.log2(np.maximum(nb, 1)).astype(int), classes),
    ]
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def least_estimate(percent: int, errors: float, buckets: int, na, nb) -> np.ndarray:
    """The estimate under which a pair is dropped. Small sets fill fewer registers of their own."""
    share = percent / 100
    own = buckets * -np.expm1(-np.minimum(na, nb) / buckets)
    return share - errors * np.sqrt(share * (1 - share) / np.maximum(own, 1.0))


def signatures(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """(doc_id, n_shingles, key, registers): key names the word sequence."""
    probe = lending_order(buckets)

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for batch in batches:
            keys, sizes, packed = [], [], []
            for text in batch["text"]:
                words = folded(text)
                hashes = shingle_set(words, powers, width)
                keys.append(hashlib.blake2b(words, digest_size=16).digest())
                sizes.append(len(hashes))
                packed.append(registers_of(hashes, buckets, probe).tobytes() if len(hashes) else None)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "n_shingles": sizes, "key": keys, "registers": packed}
            )

    return docs.mapInPandas(signed, "doc_id long, n_shingles long, key binary, registers binary")


def shingle_table(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles): the full sets."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for batch in batches:
            yield pd.DataFrame(
                {
                    "id": batch["doc_id"],
                    "shingles": [shingle_set(folded(t), powers, width).view(np.int64) for t in batch["text"]],
                }
            )

    return docs.mapInPandas(sets, "id long, shingles array<long>")


def _likely(
    pairs: DataFrame, classes: DataFrame, table: np.ndarray, buckets: int, percent: int, errors: float
) -> DataFrame:
    """The pairs (a, b) whose estimate does not rule them out."""

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="bool")
        left = np.frombuffer(b"".join(a), dtype=np.uint16).reshape(len(a), -1)
        right = np.frombuffer(b"".join(b), dtype=np.uint16).reshape(len(b), -1)
        na, nb = na.to_numpy(), nb.to_numpy()
        return pd.Series(
            estimated_jaccard(left, right, na, nb, table) >= least_estimate(percent, errors, buckets, na, nb)
        )

    def side(x):
        return classes.select(
            F.col("id").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}")
        )

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.where(likely("ra", "rb", "na", "nb")).select("a", "b")


def _joined_inside(
    open_: DataFrame, classes: DataFrame, sets: DataFrame, table: np.ndarray, slice_: int, bands: int, percent: int,
    errors: float,
) -> DataFrame:
    """Links (a, b) that join components inside large buckets, found without writing out pairs.

    A bucket is cut into slices of about ``slice_`` shingles (and at most 4096 classes, as a class
    counts for slice_ / 4096 at least) and every two slices meet in a task. A pair is looked at only
    in the first band that it shares.
    """
    slices = F.ceil(F.greatest(F.col("_mass") / slice_, F.col("_n") / 4096)).cast("int")
    own = F.pmod(F.xxhash64("id"), slices).cast("int")
    rows = (
        open_.join(classes.select("id", "registers", "n_shingles"), "id").join(sets, "id")
        .select("*", own.alias("_own"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("_other"))
        .select(
            "pos", "band", "id", "component", "registers", "n_shingles", "shingles", "_own",
            F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
        )
    )

    def met(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["component", "id"])
        packed = np.frombuffer(b"".join(group["registers"]), dtype=np.uint16).reshape(len(group), -1)
        ids, n = group["id"].to_numpy(), group["n_shingles"].to_numpy()
        side, sets_ = group["_own"].to_numpy(), group["shingles"].tolist()
        across = group["_i"].iloc[0] != group["_j"].iloc[0]
        band = int(group["pos"].iloc[0])
        parent = np.unique(group["component"].to_numpy(), return_inverse=True)[1]  # component of each row
        links = []
        for x in range(len(group) - 1):
            later = np.arange(x + 1, len(group))
            later = later[(parent[later] != parent[x]) & (not across or side[later] != side[x])]
            if not len(later):
                continue
            left = np.broadcast_to(packed[x], (len(later), packed.shape[1]))
            guess = estimated_jaccard(left, packed[later], np.full(len(later), n[x]), n[later], table)
            floor = least_estimate(percent, errors, packed.shape[1], np.full(len(later), n[x]), n[later])
            agree = (packed[later] == packed[x]).reshape(len(later), bands, -1).all(axis=2)
            good = np.flatnonzero((guess >= floor) & (agree.argmax(axis=1) == band))
            for y in later[good[np.argsort(-guess[good])]]:
                if parent[x] == parent[y]:
                    continue
                shared = len(np.intersect1d(sets_[x], sets_[y], assume_unique=True))
                if 100 * shared >= percent * (n[x] + n[y] - shared):
                    links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                    parent[parent == parent[y]] = parent[x]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy("band", "_i", "_j").applyInPandas(met, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_sb"))
    shared = F.size(F.array_intersect("_sa", "_sb"))
    both = pairs.join(left, "a").join(right, "b").select(
        "a", "b", shared.alias("_i"), (F.size("_sa") + F.size("_sb") - shared).alias("_u")
    )
    return both.where(F.col("_i") * 100 >= F.col("_u") * percent).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    width: int = 3,
    bands: int = 26,
    rows: int = 5,
    errors: float = 4.5,
    orders: int = 4,
    small: int = 64,
    slice_: int = 1_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have a Jaccard similarity of at least ``percent`` are linked;
    component_id is the smallest id reachable, kept says that it is the document's own.
    """
    buckets = bands * rows
    table = collision_table(buckets)  # made once: in a task it would take tens of MB for each group
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = pinned(signatures(source, width, buckets))
    linked = signed.where(F.col("registers").isNotNull() & F.col("doc_id").isNotNull())
    classes = pinned(
        linked.groupBy("key").agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("registers").alias("registers"),
        )
    )
    parts = [
        F.xxhash64(F.lit(b), F.substring("registers", b * rows * 2 + 1, rows * 2)) for b in range(bands)
    ]
    exploded = classes.select("id", "n_shingles", F.posexplode(F.array(*parts)).alias("pos", "band"))
    shared = exploded.groupBy("band").agg(
        F.min_by("id", F.xxhash64("id", F.col("pos") % orders)).alias("centre"),
        F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_mass"),
    )
    members = pinned(exploded.drop("n_shingles").join(shared.where("_n > 1"), "band"))
    stars = pinned(
        members.where("id <> centre")
        .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    )
    sets = pinned(
        shingle_table(
            source.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), width
        ).dropDuplicates(["id"])
    )
    first = pinned(_verified(_likely(stars, classes, table, buckets, percent, errors), sets, percent))
    label = components(first)

    # Buckets that still hold several components.
    named = members.select("pos", "band", "id", "_n", "_mass").join(label, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    split = named.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    open_ = pinned(named.join(split.where("_lo < _hi").select("band"), "band"))
    few = open_.where(F.col("_n") <= small)
    left = few.select("band", F.col("id").alias("_x"), F.col("component").alias("_cx"))
    right = few.select("band", F.col("id").alias("_y"), F.col("component").alias("_cy"))
    across = (
        left.join(right, "band").where("_cx < _cy")
        .select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    second = _verified(_likely(across, classes, table, buckets, percent, errors), sets, percent)
    third = _joined_inside(open_.where(F.col("_n") > small), classes, sets, table, slice_, bands, percent, errors)
    label = components(pinned(first.union(second).union(third)))

    named = classes.select("key", "id").join(label, "id", "left").select(
        "key", F.coalesce("component", "id").alias("_component")
    )
    # Links join classes of different texts, and copies share their class.
    out = signed.join(named, "key", "left")
    component = F.when(
        F.col("registers").isNull() | F.col("doc_id").isNull(), F.col("doc_id")
    ).otherwise(F.col("_component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def without_near_copies(
    docs: DataFrame,
    percent: int = 80,
    width: int = 5,
    bands: int = 29,
    rows: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Of each group of near copies one row, of the smallest id, in the columns of ``docs``.

    A row is known by its id and text, so of rows that repeat both one stays, and of two texts under
    one id each is kept or dropped for itself. Rows without an id or without words all stay. Rows are
    numbered by a 64-bit hash; rows of different documents that share a number all stay, unjudged.
    """
    key = ["id", "body"]
    facts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    known = facts.where(F.col("id").isNotNull()).withColumn("row", F.xxhash64(*key))
    counted = pinned(known.groupBy("row", *key).agg(F.count(F.lit(1)).alias("n")))
    double = pinned(counted.groupBy("row").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("row"))
    if not double.isEmpty():
        known, counted = (x.join(double, "row", "left_anti") for x in (known, counted))
    found = near_duplicates(known, percent=percent, width=width, bands=bands, rows=rows, doc_id="row")
    groups = found.where(F.col("n_shingles") > 0).select(F.col("doc_id").alias("row"), "component_id").distinct()
    grouped = pinned(counted.join(groups, "row"))
    first = grouped.groupBy("component_id").agg(F.min(F.struct(*key, "n")).alias("first")).select("first.*")
    again = pinned(first.where(F.col("n") > 1).select(*key))
    lost = pinned(grouped.select(*key).join(first.where(F.col("n") == 1), key, "left_anti"))

    def same(other):
        return (docs[doc_id] == other["id"]) & (F.xxhash64(docs[text]) == other["body"])

    out = docs.join(lost, same(lost), "left_anti")
    if not again.isEmpty():
        once = docs.join(again, same(again), "left_semi")
        number = _free("number", docs.columns)
        # rows that repeat id and text may differ in other columns; any one of them stays
        once = once.withColumn(number, F.xxhash64(text)).dropDuplicates([doc_id, number]).drop(number)
        out = out.unionByName(once)
    return out.select(*docs.columns)


def _free(name: str, taken) -> str:
    while name in taken:
        name += "_"
    return name
