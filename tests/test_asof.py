"""The as-of join against looking through all rows."""

import datetime as dt
import random

import pytest
from foretell.operators.asof import asof_join


def brute(left, right, strict):
    out = []
    for row in left:
        best = None
        for r in right:
            if None not in (row[0], row[1], row[2], r[0], r[1], r[2]) and r[:2] == row[:2] and (r[2] < row[2] or not strict and r[2] == row[2]) and (best is None or (r[2], r[3]) > best[2:4]):
                best = r
        out.append((*row, *(best[3:] if best else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_like_brute_force(spark, strict, ranges):
    rng = random.Random(ranges)
    day = lambda: None if rng.random() < 0.05 else dt.date(2020, 1, 1) + dt.timedelta(days=int(rng.random() ** 2 * 60))
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = [(key(), rng.choice("xy"), day(), i) for i in range(150)]
    left += left[:3]
    right = [(key(), rng.choice("xy"), day(), i, None if rng.random() < 0.2 else i * 1.5) for i in range(60)]
    a = spark.createDataFrame(left, "League string, Team string, day date, own int").repartition(3)
    b = spark.createDataFrame(right, "League string, Team string, seen date, number int, value double").repartition(3)
    found = asof_join(a, b, ["League", "Team"], "day", "seen", ["number", "value"], ["number"], strict, ranges)
    assert found.columns == ["League", "Team", "day", "own", "number", "value"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(left, right, strict)


def test_edges(spark):
    a = spark.createDataFrame([("k", 1.0, "x")], "k string, t double, `a.b` string")
    b = spark.createDataFrame([("k", 1.0, 5), ("k", 0.5, 4)], "k string, t double, v int")
    assert [tuple(r) for r in asof_join(a, b, ["k"], "t").collect()] == [("k", 1.0, "x", 4)]
    assert [tuple(r) for r in asof_join(a, b.limit(0), ["k"], "t").collect()] == [("k", 1.0, "x", None)]
    assert asof_join(a.limit(0), b, ["k"], "t").collect() == []
    with pytest.raises(ValueError):
        asof_join(a.withColumnRenamed("a.b", "v"), b, ["k"], "t")
