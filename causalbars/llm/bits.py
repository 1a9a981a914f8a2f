"""A set of long keys as bits of fixed number, to thin out a table before a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a table: 8 MB, whatever the number of keys, unless more are asked for.
BITS = 1 << 26
_BLOCK = 1 << 13  # words of 64 bits in one row on the way to the driver


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def bits_for(n_keys: int) -> int:
    """Eight bits for a key, as a power of two between 8 and 64 MB."""
    return min(max(1 << (8 * n_keys - 1).bit_length(), BITS), 8 * BITS) if n_keys else BITS


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    return mix64(keys.view(np.uint64)) % np.uint64(bits)


class BitTable:
    """``has`` is true for all keys put in, and for few others while they are fewer than the bits.

    If the keys outgrow the bits it lets more through, never fewer, so what follows must hold for any superset.
    """

    def __init__(self, shared):
        self.shared = shared

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = _bit(keys, len(self.shared.value) << 6).astype(np.int64)
        return (self.shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def test(self) -> Callable[[Column], Column]:
        """The same as a column function."""

        @F.pandas_udf("boolean")
        def known(key: pd.Series) -> pd.Series:
            return pd.Series(self.has(key.to_numpy(np.int64)))

        return known


def bit_table(keys: DataFrame, size: int = BITS) -> BitTable:
    """``size`` bits of the one long column of ``keys``, sent to every executor.

    Tasks send the words of their bits, which are merged, then packed into rows of 64 KB: 8 MB, or ``size`` bits, reach the driver.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), size)
            word, at = np.unique(bit >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, at, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], ["w", "x"])

    def pack(block: pa.Table) -> pa.Table:
        w = block.column("w").to_numpy()
        dense = np.zeros(_BLOCK, np.uint64)
        dense[w % _BLOCK] = block.column("x").to_numpy().view(np.uint64)
        return pa.table({"block": pa.array([int(w[0]) // _BLOCK], pa.int64()), "bits": pa.array([dense.tobytes()], pa.binary())})

    merged = keys.mapInArrow(words, "w bigint, x bigint").groupBy("w").agg(F.bit_or("x").alias("x"))
    packed = merged.groupBy(F.floor(F.col("w") / _BLOCK)).applyInArrow(pack, "block bigint, bits binary").collect()
    bits = np.zeros(size >> 6, np.uint64)
    for row in packed:
        bits[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.bits, np.uint64)
    return BitTable(keys.sparkSession.sparkContext.broadcast(bits))
