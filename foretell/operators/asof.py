"""The last row before: an as-of join by union, sort and the last value seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str | None = None, values: list[str] | None = None, ties: list[str] | None = None, strict: bool = True, ranges: int | None = None) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the last row of ``right`` that has its keys and comes before it.

    ``at`` is the left rows' place in time and ``right_at`` (the same name if
    not given) the right ones'; any type that sorts and casts to double.
    ``strict`` takes rows before, not at, the left row's time. Of several right
    rows at one time the last by ``ties`` counts; values that are null there
    stay null. Rows without such a row get nulls, as do null keys and times.
    Left rows come back as often as they are given.

    A key's rows are cut into ranges of time, about equally many of them in
    each over all keys (``ranges``, by default the session's shuffle
    partitions), so a key that has most rows isn't one task's work. What the
    last right row of a range is, is found apart and passed to the later ranges
    of its key: one small row for each key and range that it has.
    """
    right_at = right_at or at
    values = values or [c for c in right.columns if c not in (*keys, right_at)]
    if clash := sorted(set(values) & set(left.columns)):
        raise ValueError(f"both sides have {clash}")
    spark = left.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"k{i}" for i in range(len(keys))]
    order = F.struct(*[F.col(_quoted(c)).alias(f"t{i}") for i, c in enumerate([right_at, *(ties or [])])])
    own = left.select(*[F.col(_quoted(k)).alias(n) for k, n in zip(keys, names, strict=True)], F.col(_quoted(at)).alias("t"), F.struct(*[F.col(_quoted(c)) for c in left.columns]).alias("own"))
    given = right.select(*[F.col(_quoted(k)).alias(n) for k, n in zip(keys, names, strict=True)], F.col(_quoted(right_at)).alias("t"), order.alias("o"), F.struct(*[F.col(_quoted(c)) for c in values]).alias("found"))
    known = F.lit(True)
    for n in (*names, "t"):
        known = known & F.col(n).isNotNull()
    rest = own.where(~known).select("own", F.lit(None).cast(given.schema["found"].dataType).alias("found"))
    own, given = own.where(known), given.where(known)

    both = own.withColumns({"o": F.lit(None).cast(given.schema["o"].dataType), "found": F.lit(None).cast(given.schema["found"].dataType)}).unionByName(given.withColumn("own", F.lit(None).cast(own.schema["own"].dataType)))
    place = F.col("t").cast("double") if dict(own.dtypes)["t"] != "date" else F.unix_date("t").cast("double")
    cuts = both.select(place.alias("x")).agg(F.percentile_approx("x", [k / ranges for k in range(1, ranges)])).first()[0] if ranges > 1 else None
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < place)) if cuts else F.lit(0)
    both = both.withColumn("part", part)
    # At one time the side that doesn't see the other comes first; right rows in the order of their ties.
    side = F.col("o").isNotNull() if strict else F.col("o").isNull()
    before = Window.partitionBy(*names, "part").orderBy("t", side, F.col("o").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("last", F.last(F.when(F.col("o").isNotNull(), F.struct("found")), ignorenulls=True).over(before)).where("own IS NOT NULL")
    ends = both.where("o IS NOT NULL").groupBy(*names, "part").agg(F.max_by(F.struct("found"), F.col("o")).alias("end"))
    # A range's carry is the end of the last range before it that has one.
    upto = ends.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("part", "end"))).alias("ends"))
    spread = seen.select(*names, "part").distinct().join(upto, names)
    carry = spread.select(*names, "part", F.get(F.filter("ends", lambda e: e["part"] < F.col("part")), F.size(F.filter("ends", lambda e: e["part"] < F.col("part"))) - 1)["end"].alias("carry"))
    met = seen.join(carry, [*names, "part"], "left").select("own", F.coalesce("last", "carry")["found"].alias("found"))
    return met.unionByName(rest).select("own.*", *[F.col("found")[c].alias(c) for c in values])
