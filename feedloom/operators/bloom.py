"""Key filters that reach the scan: a Bloom filter of one side's keys as a bounded value.

The filter is an array of 64-bit words, worked out by an aggregate of the small side and used
as a scalar in the plan of the large one, so rows that cannot match are dropped where they
are read, before any exchange. A key of the small side always passes; others pass rarely.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a filter, as powers of two; two bits a key are set. The largest is one megabyte.
FEWEST_BITS, MOST_BITS = 12, 23
#: Bits for each key, while there are enough.
BITS_A_KEY = 12
#: A filter with a larger share of set bits lets most rows pass and is left out.
FULL = 0.7


def _positions(keys: Sequence[str], bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1)
    return [F.xxhash64(*keys, F.lit(salt)).bitwiseAND(mask) for salt in (0, 1)]


class Bloom:
    """The filter of a frame's keys. NULL keys have none; ``words`` is a scalar of the plan."""

    def __init__(self, df: DataFrame, keys: Sequence[str], rows: int):
        """``rows`` is about how many rows ``df`` has; it sizes the filter only."""
        wanted = max(rows, 1) * BITS_A_KEY
        self.bits = min(max(wanted.bit_length(), FEWEST_BITS), MOST_BITS)
        known = df.select(*keys).na.drop()
        set_bits = known.select(F.explode(F.array(*_positions(keys, self.bits))).alias("p"))
        word = F.shiftright("p", 6).alias("w")
        bit = F.expr("shiftleft(1L, CAST(p & 63 AS INT))")
        words = set_bits.groupBy(word).agg(F.bit_or(bit).alias("v"))
        # one row a word, at most 2 ** (MOST_BITS - 6); words without a bit are filled in
        every = df.sparkSession.range(1 << (self.bits - 6)).select(F.col("id").alias("w"))
        dense = every.join(words, "w", "left").select("w", F.coalesce("v", F.lit(0).cast("bigint")).alias("v"))
        listed = dense.agg(F.array_sort(F.collect_set(F.struct("w", "v"))).alias("l"))
        self.frame = listed.select(F.transform("l", lambda x: x["v"]).alias("words"))

    def share(self) -> float:
        """Share of set bits (runs the aggregate)."""
        ones = F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))
        return self.frame.select(ones).first()[0] / (1 << self.bits)

    def may_contain(self, keys: Sequence[str]) -> Column:
        """Whether a row's key may be one of the filter's; never for NULL keys."""
        words = self.frame.scalar()

        def is_set(p: Column) -> Column:
            word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
            return F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1

        conditions = [*[F.col(k).isNotNull() for k in keys], *map(is_set, _positions(keys, self.bits))]
        return reduce(lambda a, b: a & b, conditions)


def semi_filtered(big: DataFrame, small: DataFrame, on: Sequence[str], rows: int) -> DataFrame:
    """``big`` without most of the rows whose key ``small`` does not have, and with all others.

    For inner and semi joins of a large table with few keys: put it before the exchange.
    ``rows`` is about how many rows ``small`` has. Where the filter would be too full to help
    the frame stays as it is.
    """
    if rows * 2 > FULL * (1 << MOST_BITS):
        return big
    return big.where(Bloom(small, on, rows).may_contain(list(on)))
