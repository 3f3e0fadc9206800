"""Places in a global order without a global task: range-partitioned sorts, completed by prefix sums over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import checkpointed


def numbered(rows: DataFrame, keys: list[str], tie: str) -> tuple[DataFrame, bool]:
    """``rows`` (longs without nulls) in the order of ``keys``, then ``tie``, with their places in it; and whether any keys are equal.

    Adds ``at`` (the row's place from 0), ``inner`` (place of the first row with
    equal keys), ``outer`` (with equal keys but for the last one), ``alone`` (no
    other row has its keys) and, for each column c of ``rows``, ``before_c`` of
    the row ahead (-1 for the first). Rows with equal keys and tie are one row.

    Rows are dealt by keys and tie together, so equal keys of any number of
    rows are spread over tasks. What a task can't know of its neighbours, a
    summary of one row a partition adds; only that passes through the driver.
    """
    columns, order = rows.columns, [*keys, tie]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, outer, inner = TaskContext.get().partitionId(), 0, -1, -1
        last: np.ndarray | None = None
        waiting: list[np.ndarray] | None = None

        def shaped(made: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names)

        names = [*columns, *[f"before_{c}" for c in columns], "part", "at", "outer", "inner", "alone"]
        for batch in batches:
            values = np.vstack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]) if batch.num_rows else np.empty((len(columns), 0), np.int64)
            previous = np.column_stack([values[:, :1] * 0 - 1 if last is None else last, values[:, :-1]]) if values.shape[1] else values
            where = {c: i for i, c in enumerate(columns)}
            same = np.vstack([values[where[c]] == previous[where[c]] for c in order])
            if last is None and values.shape[1]:
                same[:, 0] = False
            fresh = ~same.all(axis=0)
            values, previous, same = values[:, fresh], previous[:, fresh], same[:, fresh]
            n = values.shape[1]
            if not n:
                continue
            new_outer, new_inner = ~same[: len(keys) - 1].all(axis=0), ~same[: len(keys)].all(axis=0)
            if last is None:
                new_outer[0] = new_inner[0] = False  # may go on from the partition before
            at = np.arange(count, count + n)
            head_outer, head_inner = (np.maximum(np.maximum.accumulate(np.where(new, at, -1)), before) for new, before in ((new_outer, outer), (new_inner, inner)))
            alone = np.append(new_inner[1:], True) & ((head_inner == at) | (at == 0))
            if waiting is not None:
                waiting[-1][-1] &= new_inner[0]
                yield shaped(waiting)
            waiting = [*values, *previous, np.full(n, part), at, head_outer, head_inner, alone.astype(np.int64)]
            count, outer, inner, last = count + n, head_outer[-1], head_inner[-1], values[:, -1:]
        if waiting is not None:
            yield shaped(waiting)

    longs = ", ".join(f"{c} long" for c in [*columns, *[f"before_{c}" for c in columns], "part", "at", "outer", "inner", "alone"])
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = checkpointed(dealt.mapInArrow(number, longs))
    ends = local.groupBy("part").agg(F.count("*").alias("n"), F.sum("alone").alias("alone"), F.min(F.struct("at", *columns)).alias("first"), F.max(F.struct("at", *columns, "outer", "inner")).alias("last")).collect()
    ends.sort(key=lambda row: row.part)
    known, offset, last, heads = {}, 0, None, (0, 0)
    for k, row in enumerate(ends):
        held = 0 if last is None else next((d for d, c in enumerate(keys) if row.first[c] != last[c]), len(keys))
        incoming = [heads[0] if held >= len(keys) - 1 and last is not None else offset, heads[1] if held == len(keys) else offset]
        goes_on = k + 1 < len(ends) and all(ends[k + 1].first[c] == row.last[c] for c in keys)
        known[row.part] = (offset, *incoming, row.n - 1, held == len(keys), goes_on, [-1 if last is None else last[c] for c in columns])
        heads = tuple(offset + row.last[h] if row.last[h] >= 0 else incoming[d] for d, h in enumerate(("outer", "inner")))
        offset, last = offset + row.n, row.last
    equal = any(row.alone < row.n for row in ends) or any(continues for *_, continues, _, _ in known.values())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {c: batch.column(c).to_numpy(zero_copy_only=False).copy() for c in batch.schema.names}
            part = made.pop("part")
            # A task may read several parts: each is a stretch of rows.
            cuts = np.flatnonzero(np.diff(part)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]) if len(part) else []:
                offset, from_outer, from_inner, final, continues, goes_on, ahead = known[int(part[i])]
                at, alone = made["at"][i:j], made["alone"][i:j]
                first, end = at == 0, at == final
                alone[(first & continues) | (end & goes_on)] = 0
                for c, x in zip(columns, ahead):
                    made[f"before_{c}"][i:j][first] = x
                for head, incoming in (("outer", from_outer), ("inner", from_inner)):
                    values = made[head][i:j]
                    values[:] = np.where(values >= 0, values + offset, incoming)
                at += offset
            yield pa.RecordBatch.from_arrays([pa.array(x == 1 if c == "alone" else x) for c, x in made.items()], list(made))

    # Placed in Python, where a join would broadcast a row for each part in every plan that reads the result.
    kinds = ", ".join(f"{c} {'boolean' if c == 'alone' else 'long'}" for c in [*columns, *[f"before_{c}" for c in columns], "at", "outer", "inner", "alone"])
    return local.mapInArrow(place, kinds), equal
