"""A set of hashes as a bitmap of fixed size, for thinning rows before they are shuffled.

The bitmap has BITS bits whatever it holds, so it may be broadcast; a hash that
is in the set is always found, one that isn't may be found too. What is kept by
mistake costs time only, as an exact step follows wherever it is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^26 bits are 8 MB.
LOG_BITS = 26
_LOG_BLOCK = 16


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = []
        for bits in batch.column("bits"):
            marks = np.zeros(1 << _LOG_BLOCK, bool)
            marks[bits.values.to_numpy(zero_copy_only=False)] = True
            blocks.append(np.packbits(marks).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(blocks, pa.binary())], ["block", "packed"])


def bitmap(hashes: DataFrame) -> Broadcast:
    """The set of the long column of ``hashes`` (nulls are left out) as a broadcast array of bytes."""
    (name,) = hashes.columns
    low = hashes.where(F.col(name).isNotNull()).select(F.col(name).bitwiseAND((1 << LOG_BITS) - 1).cast("int").alias("at")).distinct()
    parts = low.groupBy(F.shiftright("at", _LOG_BLOCK).alias("block")).agg(F.collect_list(F.col("at").bitwiseAND((1 << _LOG_BLOCK) - 1)).alias("bits"))
    packed = np.zeros(1 << (LOG_BITS - 3), np.uint8)
    size = 1 << (_LOG_BLOCK - 3)
    for row in parts.mapInArrow(_blocks, "block int, packed binary").collect():  # BITS bits in all
        packed[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["packed"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(packed)


def maybe_in(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (64-bit integers) may be in the set."""
    at = hashes.astype(np.uint64, copy=False) & np.uint64((1 << LOG_BITS) - 1)
    return (packed[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def maybe(found: Broadcast, hashes: Column) -> Column:
    """Whether a long column's value may be in the set."""

    @F.pandas_udf("boolean")
    def test(values):
        import pandas as pd

        return pd.Series(maybe_in(found.value, values.to_numpy(np.int64)))

    # Else the optimiser copies the test to the other side of a join by the same key, where it runs over all rows.
    return test.asNondeterministic()(hashes)
