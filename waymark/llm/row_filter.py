"""A Bloom filter of rows, of a bounded size, that picks rows of a table without a shuffle of their texts.

Rows are told by a 64-bit id. The filter has 32 bits a row up to MAX_BITS (64 MB). What passes holds all wanted
rows and a few others (one in 1,200 up to 16 million rows, a quarter with 170 million, most of them with over 500
million): callers tell these apart by keys, so the results are exact at any number of rows, and only the time
depends on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import forgotten, written

#: 64 MB, however many rows.
MAX_BITS = 1 << 29
_FACTORS = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F], [0x165667B19E3779F9]], np.uint64)


def _slots(rids: np.ndarray, bits: int) -> np.ndarray:
    """Three places in the filter for each row."""
    return (rids.view(np.uint64) * _FACTORS >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def bits_for(n_rows: int) -> int:
    """32 bits a row, as a power of two from 2^16 to MAX_BITS."""
    return min(MAX_BITS, max(1 << 16, 1 << max(0, 32 * n_rows - 1).bit_length()))


class RowFilter:
    """The filter of rows (rid, a long), on all executors. bits: its size, a power of two of 64 or more, by default as bits_for() has it."""

    def __init__(self, rows: DataFrame, bits: int | None = None):
        rows = written(rows, "filter-rows")
        self.bits = bits = bits or bits_for(rows.count())

        def place(batches):
            for b in batches:
                slots = np.unique(_slots(b.column("rid").to_numpy(), bits))
                yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array((np.uint64(1) << (slots & 63).astype(np.uint64)).view(np.int64))], names=["word", "mask"])

        words = rows.mapInArrow(place, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # bits / 64 rows at most
        forgotten(rows)
        packed = np.zeros(bits // 64, np.uint64)
        packed[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
        self.words = rows.sparkSession.sparkContext.broadcast(packed)

    def holds(self, rids: np.ndarray) -> np.ndarray:
        slots = _slots(rids, self.bits)
        return (self.words.value[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool).all(axis=0)

    def column(self, rid: Column) -> Column:
        """Whether the filter holds a row's rid; only rid goes to Python."""

        @F.arrow_udf("boolean")
        def held(rids: pa.Array) -> pa.Array:
            return pa.array(self.holds(rids.to_numpy(zero_copy_only=False)))

        return held(rid)
