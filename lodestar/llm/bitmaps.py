"""Bitmaps of hashes, of a bounded size whatever the input, that narrow a second reading of the texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 2 MB.
SLOTS = 1 << 24


def slots_for(n: int, most: int = 1 << 27, each: int = 16) -> int:
    """Bits for n hashes, a power of two: `each` for every hash, `most` (16 MB) at most."""
    return min(most, max(1 << 10, 1 << (each * n - 1).bit_length()))


def bitmap(hashes: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """A bitmap of `slots` bits (a power of two) with the slot of every hash (the only column, longs) set.

    It is made by grouping, so at most slots / 64 rows of two numbers reach the driver.
    Hashes that are not there may share a slot with one that is, the more the fuller it is:
    that costs the caller rows that it drops later, never results.
    """
    slot = F.col(hashes.columns[0]).bitwiseAND(F.lit(slots - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(slots // 64, dtype=np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash whether its slot is set."""
    slot = hashes & (64 * len(bits) - 1)
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1
