"""Sets of hashes as bitmaps of a fixed size: a hash outside is surely not in the set, so what a bitmap lets through is always checked exactly afterwards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.common import small_batches


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the top bits of each value (int64 or uint64) are set; the bitmap's length gives how many bits count."""
    bits = int(len(bitmap) * 64).bit_length() - 1
    at = values.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(values: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """Bitmap of the top bits of a column of longs: 2 ** (bits - 6) words at most reach the driver, whatever the size of the table."""
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    with small_batches(values.sparkSession):
        words = values.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out
