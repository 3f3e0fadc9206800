"""Places over partitions, and plans that stay small for the driver."""

import random

from foretell.llm import robust_rules
from foretell.llm.order import numbered


def _joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Join")


def test_places_across_partitions_without_a_join(spark):
    draw = random.Random(5)
    rows = sorted((draw.randrange(3), draw.randrange(4), i) for i in range(400))
    frame = spark.createDataFrame(draw.sample(rows, len(rows)), "a long, b long, tie long").repartition(7)
    placed, equal = numbered(frame, ["a", "b"], "tie")
    assert equal and _joins(placed) == 0
    first = lambda n, r: next(i for i, x in enumerate(rows) if x[:n] == r[:n])
    alone = lambda r: sum(x[:2] == r[:2] for x in rows) == 1
    want = [(*r, *(rows[i - 1] if i else (-1, -1, -1)), i, first(1, r), first(2, r), alone(r)) for i, r in enumerate(rows)]
    names = ["a", "b", "tie", "before_a", "before_b", "before_tie", "at", "outer", "inner", "alone"]
    assert sorted(tuple(r) for r in placed.select(names).collect()) == want
    _, equal = numbered(frame.select("tie", "a"), ["tie", "a"], "a")
    assert not equal
    empty, equal = numbered(frame.where("false"), ["a", "b"], "tie")
    assert not equal and empty.count() == 0


def test_starts_read_the_histogram_once(spark):
    columns = robust_rules._D
    vectors = spark.createDataFrame([(c, *[float(i * (k + 1)) for k in range(len(columns))]) for c in (1, 2) for i in range(9)], ["cell", *columns])
    starts = robust_rules._starts(vectors)
    assert _joins(starts) == 1
    got = {(r.cell, r.start): r for r in starts.collect()}
    assert sorted(got) == [(c, s) for c in (1, 2) for s in range(3)] and {r.n for r in got.values()} == {9}
    for k, (name, floor) in enumerate(robust_rules.COORDINATES.items()):
        # Of 0, 1, ... 8 the third, fifth and seventh hold a quarter, a half and three quarters.
        low, mid, high = ((k + 1) * i * 32 for i in (2, 4, 6))
        quartiles, floors, whole = (got[1, s] for s in range(3))
        assert quartiles[f"m{k}"] == floors[f"m{k}"] == (mid + 0.5) / 32
        assert abs(quartiles[f"v{k}{k}"] - ((high - low) / 32 / 1.349) ** 2 - floor**2) < 1e-9
        assert floors[f"v{k}{k}"] == floor**2 and whole[f"m{k}"] == 4 * (k + 1)
