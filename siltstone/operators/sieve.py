"""A bitmap of keys that thins rows where they are read, so that a join deals out only those that can find a partner.

Every key passes; of other values, about one in BITS does while there are fewer than 64 * MOST / BITS keys, and more beyond that. The bitmap has a
bounded size, so it may go to every task; a join after it decides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph as G

#: Bits for each key, and 64-bit words of the bitmap at the most: 4 MB.
BITS, MOST = 8, 1 << 19


def _size(keys: DataFrame) -> int:
    return max(64, min(MOST, 1 << (keys.count() * BITS // 64).bit_length()))


def bitmap(keys: DataFrame, name: str) -> np.ndarray:
    """The same bitmap for Python in tasks, as 64-bit words: a text's bit is its CRC-32 modulo their bits. The driver gets the bitmap only."""
    words = _size(keys)
    place = F.pmod(F.crc32(F.col(name).cast("binary")), F.lit(words * 64))
    bits = keys.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(words, np.int64)
    table[bits["id"].to_numpy()] = bits["bits"].to_numpy()
    return table


def sieve(keys: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test for columns of the type of ``keys[name]``: true for every value in it. ``keys`` is read twice, so it should be written."""
    words = _size(keys)
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(words * 64))
    bits = keys.select(place(F.col(name)).alias("at")).groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    filled = keys.sparkSession.range(words).join(bits, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))
    table = G.cut(filled.select(F.col("all.bits").alias("bits"))).scalar()

    def passes(key: Column) -> Column:
        at = place(key)
        return F.bit_get(F.element_at(table, (F.shiftright(at, 6) + 1).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1

    return passes
