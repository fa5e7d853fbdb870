"""A membership filter of bounded size over 64-bit hashes, built on Spark and read by numpy in tasks.

It never denies a member; a wrong yes only costs work, never a result.  The size follows the number of members up to ``MOST_BITS``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

LEAST_BITS = 1 << 16
MOST_BITS = 1 << 28  # 32 MB
PAGE = 32768  # bits of one page of Spark's bitmap functions


class Filter:
    """Two places for every hash, from its lower and its upper half (not from the lowest four bits, where an owner may keep marks)."""

    def __init__(self, data: np.ndarray):
        self.data = data

    @property
    def mask(self) -> int:
        return len(self.data) * 8 - 1

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        found = np.ones(len(h), bool)
        for place in (h >> np.uint64(4) & np.uint64(self.mask), h >> np.uint64(36) & np.uint64(self.mask)):
            place = place.astype(np.int64)
            found &= (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
        return found


def build(members: DataFrame, column: str, count: int) -> Filter:
    """Filter of a column of longs with about so many rows.  The driver gets its pages, at most ``MOST_BITS`` bits in all."""
    bits = LEAST_BITS
    while bits < min(16 * count, MOST_BITS):
        bits *= 2
    h = F.col(column)
    places = members.select(F.explode(F.array(*(F.shiftrightunsigned(h, s).bitwiseAND(bits - 1) for s in (4, 36)))).alias("p"))
    # Spark numbers bits from 1
    pages = places.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    data = np.zeros(bits // 8, np.uint8)
    for row in pages.toLocalIterator():
        at = (row.page - 1) * PAGE // 8
        data[at:at + PAGE // 8] = np.frombuffer(row.bits, np.uint8)
    return Filter(data)
