"""Running sums by ranges against plain loops."""

import random

import numpy as np
import pytest
from foretell.operators import metrics
from foretell.operators.running import followers, ranged, running_sums
from pyspark.sql import functions as F


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [1, 2, 5])
def test_like_a_loop(spark, ranges, descending):
    rng = random.Random(ranges)
    rows = [(k, float(x), rng.randrange(9)) for k in ("a", "b", None) for x in rng.sample(range(-50, 50), 30 if k else 1)]
    table = ranged(spark.createDataFrame(rows, "k string, x double, v int").repartition(3), "x", ranges, descending)
    both = followers(running_sums(table, ["k"], "x", ["v"], descending), ["k"], "x", F.col("v"), "next", descending)
    got = {(r.k, r.x): (r.v_before, r.next) for r in both.collect()}
    assert len(got) == len(rows)
    for k in ("a", "b", None):
        mine, total = sorted((r for r in rows if r[0] == k), key=lambda r: r[1], reverse=descending), 0
        for i, (_, x, v) in enumerate(mine):
            assert got[k, x] == (total, mine[i + 1][2] if i + 1 < len(mine) else None)
            total += v


def test_gini_and_roc_of_random_scores(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 3, 400), np.round(rng.dirichlet([1, 1, 1], 400), 2)
    rows = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, p)], "y int, p0 double, p1 double, p2 double")
    found = metrics.gini(rows).first()
    curves = metrics.roc_points(rows, points=10_000).collect()
    for k, outcome in enumerate(metrics.OUTCOMES):
        hit, other = p[y == k, k], p[y != k, k]
        auc = ((hit[:, None] > other).sum() + (hit[:, None] == other).sum() / 2) / (len(hit) * len(other))
        assert found[f"gini_{outcome}"] == pytest.approx(2 * auc - 1)
        points = sorted((r.fpr, r.tpr) for r in curves if r.outcome == outcome)
        assert points[0] == (0, 0) and points[-1] == (1, 1)
        assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:])) == pytest.approx(auc)
    assert len([r for r in metrics.roc_points(rows, points=20).collect() if r.outcome == "home"]) == 20
    assert metrics.roc_points(rows.where("y = 0")).count() == 0
