"""A Bloom filter of keys, made by aggregates and applied while scanning.

Rows whose key is certainly not among the wanted ones are dropped in the scan's own
stage, before they are grouped or shuffled; a few others pass (about 1 in 100 at the
default size) and are dropped by the exact test that follows. So the filter never
changes a result. It is one array of bounded size, in the plan as a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracestrata.session import materialize

HASHES = 4
BITS_PER_KEY = 10
# At most 2^24 bits, 2 MB; with more keys than that is worth, the filter passes more rows.
LEAST_BITS, MOST_BITS = 10, 24


def _places(key: Column, bits: int) -> list[Column]:
    """The bits of a key: two hashes and their sums."""
    a, b = F.xxhash64(key), F.xxhash64(F.lit(1), key).bitwiseOR(F.lit(1))
    mask = (1 << bits) - 1
    # Low halves, so that the sums cannot overflow.
    a, b = (h.bitwiseAND(0x7FFFFFFF) for h in (a, b))
    return [(a + b * k).bitwiseAND(mask) for k in range(HASHES)]


def bits_for(keys: int) -> int:
    """The size, as a power of two, that `keys` keys are worth."""
    return min(MOST_BITS, max(LEAST_BITS, (max(1, keys) * BITS_PER_KEY - 1).bit_length()))


def may_contain(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test of a key column: true for every key of `keys`, and for few others; null keys are none."""
    known = materialize(keys.select(F.col(column).alias("key")).where("key is not null").distinct())
    bits = bits_for(known.count())
    words = 1 << (bits - 6)
    set_bits = known.select(F.explode(F.array(*_places(F.col("key"), bits))).alias("bit"))
    filled = set_bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("set")
    )
    every = known.sparkSession.range(words).withColumnRenamed("id", "word").join(filled, "word", "left")
    word = F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set"))
    table = materialize(every.agg(F.sort_array(F.collect_list(word))["set"].alias("words")))

    def test(key: Column) -> Column:
        array = table.scalar()
        hits = None
        for place in _places(key, bits):
            at = F.get(array, F.shiftright(place, 6).cast("int"))
            one = F.call_function("shiftright", at, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
            hits = one if hits is None else hits & one
        return key.isNotNull() & hits

    return test
