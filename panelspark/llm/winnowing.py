"""Document fingerprints by winnowing.

Every ``k`` consecutive code points get a rolling hash; of every ``window`` consecutive hashes the
smallest is chosen, the rightmost one among equals, and its position is kept. Two texts that share
a passage of at least ``window + k - 1`` code points share a chosen hash of it, and consecutive
choices are at most ``window`` apart.

Defined results: a null or empty text has an empty fingerprint; a text shorter than ``k`` has one
hash, of the whole text; a text with fewer than ``window`` hashes has one window; repeated rows have
equal fingerprints; an empty table gives no rows. Only the named columns are read, so other columns
cannot clash.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import Powers, scrambled

#: Texts of one range of ids, and so of one task; beyond it there are more ranges.
PIECE_BYTES = 1 << 28


def code_points(text) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(points: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Hash of every run of ``k`` code points, by differences of one running sum."""
    if not len(points):
        return np.zeros(0, dtype=np.uint32)
    k = min(k, len(points))
    up, down = powers.to(len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
    rolled = (total[k:] - total[:-k]) * down[: len(points) - k + 1]
    return (scrambled(rolled) >> np.uint64(32)).astype(np.uint32)


def chosen(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the window minima, rightmost of equals, by doubling the span looked at."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    # hash above, distance from the right below: the smallest key is the rightmost smallest hash
    key = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(len(hashes), 0, -1).astype(np.uint64)
    window, span = min(window, len(hashes)), 1
    while 2 * span <= window:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < window:
        key = np.minimum(key[: len(key) - (window - span)], key[window - span :])
    at = len(hashes) - (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def winnow(points: np.ndarray, k: int, window: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the choices."""
    hashes = gram_hashes(points, k, powers)
    at = chosen(hashes, window)
    return hashes[at], at


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Ten hex digits a choice: its hash and its distance from the choice before."""
    out = np.zeros((len(hashes), 5), dtype=np.uint8)
    out[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4] = np.diff(positions, prepend=0)
    return out.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the shared distinct hashes over all distinct hashes of both; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def fingerprints(
    docs: DataFrame, k: int = 20, window: int = 40, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, hashes array<long>, positions array<int>."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for batch in batches:
            marks = [winnow(code_points(t), k, window, powers) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "hashes": [h.astype(np.int64) for h, _ in marks],
                    "positions": [p.astype(np.int32) for _, p in marks],
                }
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        run, f"doc_id {kind}, hashes array<long>, positions array<int>"
    )


def _at_or_above(bounds) -> Callable:
    """Column function: how many of the ``bounds`` are at or above an id that is not null."""
    ordered = np.array(sorted(bounds), dtype=np.int64)

    @F.pandas_udf("int")
    def count(ids: pd.Series) -> pd.Series:
        return pd.Series(len(ordered) - np.searchsorted(ordered, ids.to_numpy(np.int64)), dtype="int32")

    return count


def in_order(docs: DataFrame, pieces: int) -> DataFrame:
    """(piece, doc_id, text, lead): ranges of descending ids, each with the first row after it.

    Twice as many ranges as ``pieces`` are cut by ids alone; their bytes, one row a range, then
    decide which of them make a piece, so that pieces are near equal in bytes. The first document of
    every piece is also sent to the piece before (lead = true), so each piece can be read on its own
    and texts move once. Pieces are numbered from 0, the largest ids first; null ids make one more.
    """
    spark = docs.sparkSession
    share = [i / (2 * pieces) for i in range(1, 2 * pieces)]
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)), 10 * pieces)).head()[0] or []
    known = docs.where("doc_id IS NOT NULL")
    ranges = known.withColumn("range", _at_or_above(set(cuts))("doc_id")).groupBy("range").agg(
        F.max("doc_id").alias("first"), F.sum(F.octet_length("text") + F.lit(1)).alias("bytes")
    ).collect()
    total, before, firsts = sum(r["bytes"] for r in ranges), 0, {}
    for r in sorted(ranges, key=lambda r: r["range"]):
        firsts.setdefault(before * pieces // total, r["first"])
        before += r["bytes"]
    firsts = list(firsts.values())
    number = _at_or_above(firsts)(F.coalesce("doc_id", F.lit(0))) - 1
    ranged = docs.withColumn("piece", F.when(F.col("doc_id").isNull(), len(firsts)).otherwise(number))
    # the piece before each piece's first document; the last piece is followed by the first
    led = [(first, i - 1) for i, first in enumerate(firsts)]
    if docs.where("doc_id IS NULL").limit(1).count():
        led = [*led, (None, len(firsts) - 1)]
    led = [(first, len(led) - 1 if target < 0 else target) for first, target in led]
    ahead = F.broadcast(spark.createDataFrame(led or [(0, -1)], "first long, target int"))
    lead = ranged.join(ahead, F.col("doc_id").eqNullSafe(F.col("first"))).select(
        F.col("target").alias("piece"), "doc_id", "text", F.lit(True).alias("lead")
    )
    own = ranged.select("piece", "doc_id", "text", F.lit(False).alias("lead"))
    return own.union(lead)


def compared(
    docs: DataFrame, k: int = 20, window: int = 40, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every text beside its edited text and the next text (descending id, after the last the first).

    The edited text replaces the last floor(n/2) code points by the first as many (or all) of the
    next text. Rows with one id follow each other by text and lie in one task. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    pieces = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PIECE_BYTES))
    ordered = (
        in_order(rows, pieces).repartitionById(pieces + 1, "piece")
        .sortWithinPartitions("piece", "lead", F.col("doc_id").desc_nulls_last(), "text")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        waiting = None  # (piece, doc_id, points, hashes, positions) whose next text is not known yet

        def result(own, following):
            _, ident, points, hashes, at = own
            half = len(points) // 2
            edited = np.concatenate([points[: len(points) - half], following[2][:half]]) if half else points
            other, other_at = winnow(edited, k, window, powers)
            raw = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            return (
                ident, len(points), hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest(),
                written(hashes, at), written(other, other_at),
                likeness(hashes, other), likeness(hashes, following[3]),
            )

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        led = None  # the piece whose following document has been seen
        for batch in batches:
            out = []
            for piece, ident, words, lead in zip(batch["piece"], batch["doc_id"], batch["text"], batch["lead"]):
                if lead and led == piece:
                    continue  # further rows with the following document's id
                points = code_points(words)
                row = (piece, None if pd.isna(ident) else int(ident), points, *winnow(points, k, window, powers))
                if waiting is not None:
                    out.append(result(waiting, row))
                waiting, led = (None, piece) if lead else (row, led)
            done = pd.DataFrame(out, columns=names)
            done["doc_id"] = done["doc_id"].astype("Int64")
            yield done

    return ordered.mapInPandas(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
