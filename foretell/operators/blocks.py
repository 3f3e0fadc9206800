"""Rows of numbers as blocks of a matrix, over which many statistics and many fits advance in shared passes.

A block holds some thousands of rows: the raw columns (NaN where missing), the
label and the row's place in an order, by which folds are told apart: a fold
trains on the rows whose place is before its limit. A pass adds up one array
over all blocks: tasks sum theirs, sums are summed in groups, and the driver
gets as many as there are groups. What the driver holds grows with columns,
folds and models, never with rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in a block, and rows a task gets: a pass is a job, and small tables shouldn't pay for many tasks in each.
BLOCK_ROWS, TASK_ROWS = 4096, 8192
#: Task sums that are added up by one task before the driver sees them.
GROUP = 32
#: Bits of a value that one pass of a selection settles.
_BITS = 11


@dataclass
class Blocks:
    """A table's blocks; text columns are there as one indicator a value, NaN where the text is missing."""

    rows: DataFrame
    numeric: list[str]
    categories: dict[str, list[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[tuple[str, str | None]]:
        return [*[(c, None) for c in self.numeric], *[(c, v) for c, values in self.categories.items() for v in values]]

    def sums(self, add: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
        """The sum of ``add(x, y, place)`` over all blocks; None for an empty table."""
        width = len(self.names)

        def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for x, y, place in zip(*[batch.column(c) for c in ("x", "y", "place")], strict=True):
                    more = add(np.frombuffer(x.as_buffer()).reshape(-1, width), np.frombuffer(y.as_buffer(), np.int32), np.frombuffer(place.as_buffer()))
                    total = more if total is None else total + more
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())], ["sums"])

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for sums in batch.column("sums"):
                    more = np.frombuffer(sums.as_buffer())
                    total = more if total is None else total + more
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        found = self.rows.mapInArrow(per_task, "sums binary")
        tasks = self.rows.rdd.getNumPartitions()
        while tasks > GROUP:
            tasks = -(-tasks // GROUP)
            found = found.repartition(tasks).mapInArrow(together, "sums binary")
        parts = [np.frombuffer(r[0]) for r in found.collect()]
        return sum(parts[1:], parts[0]) if parts else None

    def release(self) -> None:
        self.rows.unpersist()


def make_blocks(data: DataFrame, columns: list[str], label: str = "target_label", place: Column | None = None, n: int | None = None) -> Blocks:
    """The blocks of ``columns`` of ``data``, kept until ``release``."""
    kinds = dict(data.dtypes)
    numeric = [c for c in columns if kinds[c] != "string"]
    text = [c for c in columns if kinds[c] == "string"]
    found = data.agg(F.count(F.lit(1)), *[F.sort_array(F.collect_set(c)) for c in text]).first()
    categories = dict(zip(text, found[1:], strict=True))
    nan = F.lit(math.nan)
    values = [F.coalesce(F.col(c).cast("double"), nan) for c in numeric] + [F.coalesce((F.col(c) == v).cast("double"), nan) for c, values in categories.items() for v in values]
    rows = data.select(F.array(*values).cast("array<double>").alias("x"), F.coalesce(F.col(label).cast("int"), F.lit(-1)).alias("y"), (F.lit(0.0) if place is None else place.cast("double")).alias("place"))
    width = len(values)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False) if width else np.zeros(0)
                columns = [x.astype(np.float64).tobytes(), part.column("y").to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), part.column("place").to_numpy(zero_copy_only=False).astype(np.float64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["x", "y", "place"])

    packed = rows.coalesce(max(1, -(-found[0] // TASK_ROWS))).mapInArrow(pack, "x binary, y binary, place binary")
    return Blocks(packed.persist(), numeric, categories)


def _keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; +0 and -0 are one."""
    bits = (x + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def _values(keys: np.ndarray) -> np.ndarray:
    bits = (keys ^ np.uint64(1 << 63)).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def counts(blocks: Blocks, limits: list[float]) -> np.ndarray:
    """(fold, column): how many values are there."""
    found = blocks.sums(lambda x, y, place: np.array([(~np.isnan(x[place < b])).sum(axis=0) for b in limits], np.float64))
    return np.zeros((len(limits), len(blocks.names))) if found is None else found.reshape(len(limits), -1)


def select(blocks: Blocks, limits: list[float], ranks: np.ndarray) -> np.ndarray:
    """(fold, column, k): the value at ``ranks[fold, column, k]`` in order, from 0; NaN for negative ranks.

    Exact, by counting: each pass counts the next _BITS bits of the values that
    agree so far with the wanted one, so six passes settle a double. No task
    sorts or holds a column.
    """
    folds, width, many = ranks.shape
    left = ranks.astype(np.int64).copy()
    prefix = np.zeros(ranks.shape, np.uint64)
    done = 0
    while done < 64:
        bits = min(_BITS, 64 - done)
        shift = np.uint64(64 - done - bits)
        size = 1 << bits
        wanted = [(f, c, np.unique(prefix[f, c][left[f, c] >= 0])) for f in range(folds) for c in range(width) if (left[f, c] >= 0).any()]

        def count(x: np.ndarray, y: np.ndarray, place: np.ndarray, wanted=wanted, shift=shift, size=size, bits=bits, done=done) -> np.ndarray:
            keys, there = _keys(x), ~np.isnan(x)
            inside = [place < b for b in limits]
            out = np.zeros((sum(len(p) for _, _, p in wanted), size))
            i = 0
            for f, c, prefixes in wanted:
                mine = keys[inside[f] & there[:, c], c]
                low = ((mine >> shift) & np.uint64(size - 1)).astype(np.int64)
                high = mine >> (shift + np.uint64(bits)) if done else np.zeros(len(mine), np.uint64)
                for p in prefixes:
                    out[i] = np.bincount(low[high == p], minlength=size)
                    i += 1
            return out.reshape(-1)

        if not wanted:
            break
        found = blocks.sums(count)
        found = found.reshape(-1, size)
        rows = {}
        for f, c, prefixes in wanted:
            for p in prefixes:
                rows[f, c, int(p)] = found[len(rows)]
        for f in range(folds):
            for c in range(width):
                for k in range(many):
                    if left[f, c, k] < 0:
                        continue
                    upto = np.cumsum(rows[f, c, int(prefix[f, c, k])])
                    at = int(np.searchsorted(upto, left[f, c, k], "right"))
                    left[f, c, k] -= int(upto[at - 1]) if at else 0
                    prefix[f, c, k] = (prefix[f, c, k] << np.uint64(bits)) | np.uint64(at)
        done += bits
    return np.where(ranks >= 0, _values(prefix), np.nan)


def quantile_ranks(n: np.ndarray) -> np.ndarray:
    """Ranks of the two values whose mean is the median; -1 where there is none."""
    n = n.astype(np.int64)
    return np.where(n[..., None] > 0, np.stack([(n - 1) // 2, n // 2], axis=-1), -1)


def medians(blocks: Blocks, limits: list[float], n: np.ndarray | None = None) -> np.ndarray:
    """(fold, column): exact medians, NaN where all is missing."""
    n = counts(blocks, limits) if n is None else n
    both = select(blocks, limits, quantile_ranks(n))
    return both.mean(axis=-1)


def extremes(blocks: Blocks, limits: list[float], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fold, column): least and largest values."""
    n = n.astype(np.int64)
    both = select(blocks, limits, np.where(n[..., None] > 0, np.stack([0 * n, n - 1], axis=-1), -1))
    return both[..., 0], both[..., 1]


def gram(blocks: Blocks, limits: list[float], fill: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sums, cross products) by fold of the columns with missing values filled, less ``centre``.

    All pairs of columns come from one product a block.
    """
    width = fill.shape[1]

    def add(x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = []
        for b, f, m in zip(limits, fill, centre, strict=True):
            part = x[place < b]
            part = np.where(np.isnan(part), f, part) - m
            out.append(np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).reshape(-1)]))
        return np.array(out)

    found = blocks.sums(add)
    found = np.zeros((len(limits), 1 + width + width * width)) if found is None else found.reshape(len(limits), -1)
    return found[:, 0], found[:, 1 : 1 + width], found[:, 1 + width :].reshape(-1, width, width)


def moments(blocks: Blocks, limits: list[float], fill: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, means, population deviations) by fold of the columns with missing values filled; sums are taken around ``fill``."""

    def add(x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = []
        for b, f in zip(limits, fill, strict=True):
            part = x[place < b]
            part = np.where(np.isnan(part), 0.0, part - f)
            out.append(np.concatenate([[len(part)], part.sum(axis=0), (part * part).sum(axis=0)]))
        return np.array(out)

    width = fill.shape[1]
    found = blocks.sums(add)
    found = np.zeros((len(limits), 1 + 2 * width)) if found is None else found.reshape(len(limits), -1)
    n = np.maximum(found[:, :1], 1)
    mean = found[:, 1 : 1 + width] / n
    spread = np.sqrt(np.maximum(found[:, 1 + width :] / n - mean * mean, 0))
    # What rounding leaves of a constant column is no spread.
    return found[:, 0], fill + mean, np.where(spread <= 1e-12 * np.maximum(np.abs(fill + mean), 1e-300), 0.0, spread)


def label_counts(blocks: Blocks, limits: list[float], labels: int = 3) -> np.ndarray:
    """(fold, label): rows of each label."""
    found = blocks.sums(lambda x, y, place: np.array([np.bincount(y[(place < b) & (y >= 0)], minlength=labels)[:labels] for b in limits], np.float64))
    return np.zeros((len(limits), labels)) if found is None else found.reshape(len(limits), labels)
