"""A Bloom filter of a table's keys as a column expression, for use before a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key sets BITS bits of one 64-bit word. At KEYS_PER_WORD keys a word, about 1 in 60 foreign keys
# passes. The largest filter has 8 MB, for four million keys.
BITS = 4
KEYS_PER_WORD = 4
MOST_WORDS = 1 << 20


def _word(key: Column, words: int) -> Column:
    return key.bitwiseAND(F.lit(words - 1))


def _mask(key: Column) -> Column:
    """The key's bits in its word, from parts of the hash that do not choose the word."""
    places = [F.shiftrightunsigned(key, 64 - 6 * (k + 1)).cast("int") for k in range(BITS)]
    # Shifts of a BIGINT go by the last six bits of the distance.
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), place) for place in places]
    return reduce(Column.bitwiseOR, bits)


def words_for(keys: int) -> int | None:
    """64-bit words, a power of two, of a filter for so many keys; None if that is too large."""
    words = 1
    while words * KEYS_PER_WORD < keys:
        words *= 2
    return words if words <= MOST_WORDS else None


def filter_words(keys: DataFrame, columns: list[str], words: int) -> DataFrame:
    """One row with the filter's words, ``bits``. Keys are added up before the shuffle, and the one
    task that lines the words up sees at most ``MOST_WORDS`` of them."""
    key = F.xxhash64(*columns)
    filled = keys.groupBy(_word(key, words).alias("id")).agg(F.bit_or(_mask(key)).alias("bits"))
    every = keys.sparkSession.range(words).join(filled, "id", "left")
    lined = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return every.agg(lined.getField("bits").alias("bits"))


def possible_member(keys: DataFrame, columns: list[str]) -> Column | None:
    """Whether a row of another table, by columns of the same names and types, may be among ``keys``:
    true for every one that is, false for nearly all that are not. None, for no filter, if there are
    more keys than the largest filter holds; a join must follow either way.

    ``keys`` is counted, so it should be a table on storage. Nulls are a key like any other.
    """
    words = words_for(keys.count())
    if words is None:
        return None
    bits = filter_words(keys, columns, words).scalar()
    key = F.xxhash64(*columns)
    mask = _mask(key)
    return F.get(bits, _word(key, words).cast("int")).bitwiseAND(mask) == mask
