"""Fixed-size bit maps of hashes: a filter that a broadcast may carry whatever the size of the data behind it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22  # 4 M buckets: half a megabyte to send, 16 MB at most to gather


def bitmap(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Packed bits of the buckets that the hashes in `column` (long) fall into.

    Spark reduces the hashes to distinct bucket numbers first, so at most 2**bits integers reach the driver.
    """
    rows = (df.select(F.shiftrightunsigned(F.col(column), 64 - bits).cast("int").alias("b")).where("b is not null").distinct().toArrow())
    flags = np.zeros(1 << bits, np.uint8)
    flags[rows.column(0).to_numpy()] = 1
    return np.packbits(flags)


def member(packed: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether each hash may be in the set: never false for one that is."""
    bucket = hashes.astype(np.uint64) >> np.uint64(64 - bits)
    return (packed[bucket >> np.uint64(3)] >> (7 - (bucket & np.uint64(7)).astype(np.uint8))) & 1 == 1
