"""Running sums over an order that no single task sorts.

Rows are cut into ranges of the order, about equally many in each over all
keys. A range is summed up by itself; what the ranges before it hold comes from
a table of one row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranged(rows: DataFrame, at: str, ranges: int | None = None, descending: bool = False) -> DataFrame:
    """``rows`` with ``part``, the number of its range of ``at`` (a double, not null), from 0 in order."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(at, [k / ranges for k in range(1, ranges)])).first()[0] if ranges > 1 else None
    if not cuts:
        return rows.withColumn("part", F.lit(0))
    below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < F.col(at)))
    return rows.withColumn("part", F.lit(len(set(cuts))) - below if descending else below)


def running_sums(rows: DataFrame, keys: list[str], at: str, values: list[str], descending: bool = False) -> DataFrame:
    """``rows`` of ``ranged`` with ``{value}_before``: the sum over the rows of its keys that come before it by ``at``; 0 for the first."""
    order = F.desc(at) if descending else F.asc(at)
    inside = Window.partitionBy(*keys, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "part").agg(*[F.sum(v).alias(v) for v in values])
    upto = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "part", *[F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"__{v}") for v in values])
    own = rows.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = _joined(own, offsets, [*keys, "part"])
    return joined.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"__{v}") for v in values}).drop(*[f"__{v}" for v in values])


def followers(rows: DataFrame, keys: list[str], at: str, what: Column, name: str, descending: bool = False) -> DataFrame:
    """``rows`` of ``ranged`` with ``what`` of the next row of its keys by ``at`` as ``name``; null for the last."""
    order = F.desc(at) if descending else F.asc(at)
    inside = Window.partitionBy(*keys, "part").orderBy(order)
    heads = rows.groupBy(*keys, "part").agg((F.max_by if descending else F.min_by)(what, F.col(at)).alias("head"))
    onward = heads.select(*keys, "part", F.lead("head").over(Window.partitionBy(*keys).orderBy("part")).alias("__onward"))
    own = rows.withColumns({"__next": F.lead(F.struct(what.alias("v"))).over(inside)})
    return _joined(own, onward, [*keys, "part"]).withColumn(name, F.when(F.col("__next").isNotNull(), F.col("__next.v")).otherwise(F.col("__onward"))).drop("__next", "__onward")


def _joined(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """An equal join that also matches nulls in the keys."""
    other = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(other[f"__k{i}"])
    return rows.join(other, same).drop(*[f"__k{i}" for i in range(len(keys))])
