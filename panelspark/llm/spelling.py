"""Spelling variants: words one edit apart, by dynamic programming over a sorted list.

The vocabulary is sorted and cut into blocks of equal size. A query word is matched against a block by
walking it once in order: the banded rows of the edit matrix (three cells, since only one edit is
allowed) of a listed word's prefixes stay valid for the next word as far as their common prefix
reaches, and where a prefix already needs more than one edit, all words that begin with it are
skipped.

One edit leaves the first half of the query word untouched or the second. So every word is looked up
in the sorted list among the words that share its first half, and in a second list, of reversed
words, among those that share its second half. Which blocks a word visits follows from the first and last word of
every block, with the same rows run over their common prefix. A block with many queries is
copied, so that every task holds at most one block and about as many queries.

Defined results: null, empty and wordless texts give no words; a null id reads as the empty string
where runs are hashed; repeated rows count as often as they stand there; an empty table gives no rows.
Only the named columns are read, so other columns cannot clash.
"""

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned, with_before

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[^a-zÀ-ÿ]+"
#: Words of a block, and most blocks of a list: beyond their product blocks grow, so that the list of
#: block ends, which goes to all tasks, does not.
BLOCK, MOST_BLOCKS = 10_000, 20_000


def _steps() -> list[int]:
    """All moves from one banded row to the next.

    A row at depth i holds the edits (capped at 2) between a prefix of i characters and the first i - 1,
    i and i + 1 characters of the query, as one number in base 3. A move depends on whether the next
    character equals the query's at i - 1, i and i + 1 (from 0), as bits 4, 2, 1. -1 is a dead row.
    """
    out = []
    for row in range(27):
        low, mid, high = row // 9, row // 3 % 3, row % 3
        for same in range(8):
            a = min(low + (same & 4 == 0), mid + 1, 2)
            b = min(mid + (same & 2 == 0), high + 1, a + 1, 2)
            c = min(high + (same & 1 == 0), b + 1, 2)
            out.append(-1 if min(a, b, c) > 1 else 9 * a + 3 * b + c)
    return out


STEPS = _steps()
CELLS = [(row // 9, row // 3 % 3, row % 3) for row in range(27)]
#: The row of a prefix that equals the query's: 1, 0, 1 edits.
EQUAL = 10


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            return n
        n += 1
    return n


def alive(prefix: str, query: str, start: int) -> bool:
    """Whether words that begin with ``prefix`` can be one edit from ``query``, whose first ``start`` they share."""
    chars, row = [*query, None, None], EQUAL
    if len(prefix) > len(query) + 1:
        return False
    for i in range(start, len(prefix)):
        c = prefix[i]
        row = STEPS[8 * row + 4 * (c == chars[i - 1]) + 2 * (c == chars[i]) + (c == chars[i + 1])]
        if row < 0:
            return False
    return True


def near_words(words: Sequence[str], shared: Sequence[int], query: str, start: int) -> Iterator[int]:
    """Positions of the sorted ``words`` that begin with the first ``start`` characters of ``query`` and
    are one edit from it. ``shared[i]`` is the common prefix length of words i - 1 and i.
    """
    head, size = query[:start], len(query)
    at = bisect_left(words, head)
    end = bisect_right(words, head, at, key=lambda w: w[:start])
    chars = [*query, "", ""]
    rows = [EQUAL] * (size + 2)  # rows[i]: of the current word's first i characters
    known = start
    while at < end:
        word = words[at]
        length, row = len(word), rows[known]
        while known < length:
            if known > size:
                row = -1
                break
            c = word[known]
            row = STEPS[8 * row + 4 * (c == chars[known - 1]) + 2 * (c == chars[known]) + (c == chars[known + 1])]
            if row < 0:
                break
            known += 1
            rows[known] = row
        if row >= 0:
            column = size - length + 1
            if 0 <= column <= 2 and CELLS[row][column] == 1:
                yield at
            at += 1
            if at < end:
                known = min(known, shared[at])
            continue
        # All words with this prefix are out. The edit is spent, so the next that may follow is one of
        # three characters; failing that, the words that begin with the characters before are out too.
        prefix, ahead = word[:known], ""
        if known <= size:
            c, (low, mid, high) = word[known], CELLS[rows[known]]
            if low == 1 and c < (x := chars[known - 1]):
                ahead = x
            if mid == 1 and c < (x := chars[known]) and (not ahead or x < ahead):
                ahead = x
            if high == 1 and c < (x := chars[known + 1]) and (not ahead or x < ahead):
                ahead = x
        at = bisect_left(words, prefix + ahead if ahead else after(prefix), at + 1, end)
        if at < end and not words[at].startswith(prefix):
            known = common_prefix(prefix, words[at])


def after(prefix: str) -> str:
    """The least text above all that begin with ``prefix``."""
    kept = prefix.rstrip("\U0010ffff")
    return kept[:-1] + chr(ord(kept[-1]) + 1) if kept else "\U0010ffff" * (len(prefix) + 1)


def vocabulary(
    docs: DataFrame, least: int = 6, seen: int = 5, damage: int | None = 199, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(word, n): lower-cased runs of Latin letters of at least ``least`` code points, seen at least
    ``seen`` times.

    ``damage`` d deletes one code point of every run whose CRC-32 with its document's id is divisible by d.
    """
    lowered = F.translate(F.col(text), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.split(lowered, BETWEEN)).alias("run")
    ).where(F.char_length("run") >= max(least, 1))
    word = F.col("run")
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.char_length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(h % damage == 0, shorter).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word")
    return counted.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= seen)


def near(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) of the words of (word, n) that have a word one edit away.

    ``best`` is the near word of largest n, of those the first in code-point order.
    """
    both = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn(
        "listed", F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word"))
    )
    block = max(block, -(-words.count() // MOST_BLOCKS))
    ranked = with_before(both, [F.col("listed")], within=["side"])
    blocks = pinned(ranked.select("side", F.floor(F.col("before") / block).alias("block"), "listed", "n"))
    ends = blocks.groupBy("side", "block").agg(F.min("listed"), F.max("listed"))
    bounds = {0: [], 1: []}  # at most 2 * MOST_BLOCKS rows
    for side, b, low, high in sorted(ends.collect()):
        bounds[side].append((b, low, high))
    lows = {side: [x[1] for x in found] for side, found in bounds.items()}
    highs = {side: [x[2] for x in found] for side, found in bounds.items()}

    def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for side, listed in zip(frame["side"], frame["listed"]):
                start = _start(listed, side)
                head = listed[:start]
                first = bisect_left(highs[side], head)
                last = bisect_right(lows[side], head, key=lambda w: w[:start])
                for b, low, high in bounds[side][first:last]:
                    if alive(low[: max(start, common_prefix(low, high))], listed, start):
                        out.append((side, b, listed))
            yield pd.DataFrame(out, columns=["side", "block", "listed"])

    queries = pinned(blocks.select("side", "listed").mapInPandas(visits, "side int, block long, listed string"))
    key = ["side", "block"]
    parts = queries.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))  # at most one row per block
    asked = queries.join(F.broadcast(parts), key).select(
        *key, F.pmod(F.xxhash64("listed"), F.col("parts")).alias("part"), "listed", F.lit(None).cast("bigint").alias("n")
    )
    held = blocks.join(F.broadcast(parts), key).select(
        *key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "listed", "n"
    )
    found = asked.unionByName(held).groupBy(*key, "part").applyInPandas(
        _matched, "word string, n_near long, best string, best_n long"
    )
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best"))).alias("_best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", F.col("_best.best").alias("best"), (-F.col("_best.m")).alias("best_n")
    )


def _start(listed: str, side: int) -> int:
    """Length of the half that a listed query shares: the first half, or in the reversed list the rest."""
    half = len(listed) // 2
    return len(listed) - half if side else half


def _matched(group: pd.DataFrame) -> pd.DataFrame:
    """One block and its queries: per query with near words in it their number and the best."""
    side = int(group["side"].iloc[0])
    held = group[group["n"].notna()].sort_values("listed")
    words, counts = held["listed"].tolist(), held["n"].astype("int64").tolist()
    shared = [0, *map(common_prefix, words, words[1:])]
    out = []
    for query in group.loc[group["n"].isna(), "listed"]:
        start = _start(query, side)
        half = query[start:] if side else None
        total, best = 0, None
        for i in near_words(words, shared, query, start):
            other = words[i]
            if side and other[len(other) - len(half) :] == half:
                continue  # shares the first half too, so it is found in the other list
            total += 1
            this = (-counts[i], other[::-1] if side else other)
            best = this if best is None else min(best, this)
        if total:
            out.append((query[::-1] if side else query, total, best[1], -best[0]))
    return pd.DataFrame(out, columns=["word", "n_near", "best", "best_n"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling the steps.

    A form is seen more often than its word, so chains end.
    """
    reach = pinned(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = pinned(reach.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"))
        reach = longer.select("word", "root")
        if longer.where(F.col("_next").isNotNull()).isEmpty():
            return reach


def variants(words: DataFrame, times: int = 5, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for (word, n).

    The form is the best near word if it is seen at least ``times`` as often as the word.
    """
    words = pinned(words.select("word", "n"))
    clear = F.col("best_n") >= F.col("n") * times
    found = pinned(
        words.join(near(words, block), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(clear, F.col("best")).alias("form"), F.when(clear, F.col("best_n")).alias("form_n"),
        )
    )
    last = roots(found.where(F.col("form").isNotNull()))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
