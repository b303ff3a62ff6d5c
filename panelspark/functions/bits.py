"""Sets of small whole numbers (days, weeks) as bits of BIGINT columns, and key filters of fixed size."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a set's word, and bits of a key filter (512 KB).
WORD, FILTER_BITS = 64, 2**22


def number_of_words(first: int, last: int) -> int:
    return (last - first) // WORD + 1


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def block_of(number: Column) -> Column:
    """First number of the block of ``WORD`` numbers that holds a BIGINT."""
    return number.bitwiseAND(F.lit(-WORD).cast("bigint"))


def bit_in_block(number: Column) -> Column:
    return _bit(number.bitwiseAND(F.lit(WORD - 1).cast("bigint")))


def block_ends(block: Column, bits: Column) -> tuple[Column, Column]:
    """Smallest and largest number of a block."""
    shown = F.bin(bits)
    return block + (F.instr(F.reverse(shown), "1") - 1), block + (F.length(shown) - 1)


def block_members(block: Column, bits: Column) -> Column:
    """All numbers of a block, as an array."""
    places = F.array(*[F.lit(i) for i in range(WORD)])
    return F.array_compact(F.transform(places, lambda i: F.when(F.getbit(bits, i) == 1, block + i)))


def bit_words(number, first: int, last: int) -> list[Column]:
    """Aggregates, one per word: which of ``first`` to ``last`` occur. Other numbers set no bit."""
    c = F.col(number) if isinstance(number, str) else number
    at = c.cast("bigint") - first
    inside = c.between(first, last)
    return [
        F.coalesce(F.bit_or(F.when(inside & (F.floor(at / WORD) == i), _bit(at % WORD))), F.lit(0).cast("bigint"))
        for i in range(number_of_words(first, last))
    ]


def merged_words(words: Sequence[str]) -> list[Column]:
    return [F.bit_or(w) for w in words]


def bits_set(words: Sequence[Column]) -> Column:
    """How many numbers a set holds."""
    total = F.lit(0).cast("bigint")
    for w in words:
        total = total + F.bit_count(w)
    return total


def key_filter(keys: DataFrame, *columns) -> Column:
    """A filter over the keys of a frame: an array of words with a bit per hashed key, as a scalar.

    Its size is fixed; more keys mean more false hits, never a missed one.
    """
    h = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    found = keys.select(F.floor(h / WORD).alias("at"), _bit(h % WORD).alias("word"))
    empty = keys.sparkSession.range(FILTER_BITS // WORD).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("word"))
    words = found.unionByName(empty).groupBy("at").agg(F.bit_or("word").alias("word"))
    return words.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda s: s["word"])
    ).scalar()


def may_hold(held: Column, *columns) -> Column:
    h = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    word = F.get(held, F.floor(h / WORD).cast("int"))
    return F.call_function("shiftright", word, (h % WORD).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
