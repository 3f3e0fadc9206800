"""Forecast quality as DataFrame aggregates: nothing is collected, every metric is one or two grouped passes.

Predictions have ``y`` (0, 1, 2) and the probabilities ``p0, p1, p2``; ``by``
names the columns that separate several sets of predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.functions.scalars import first_largest, probability_bin
from foretell.operators.running import followers, ranged, running_sums

#: Log losses clip probabilities here: the spacing of doubles at 1.
EPSILON = 2.220446049250313e-16
OUTCOMES = ["home", "draw", "away"]
_P = ["p0", "p1", "p2"]


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))


def probability_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """log_loss, accuracy (the first of equal probabilities wins), brier_score (0 to 2) and rows."""
    own = F.get(F.array(*_P), F.col("y"))
    squares = sum((F.pow(F.col(p) - (F.col("y") == k).cast("double"), 2) for k, p in enumerate(_P)), F.lit(0.0))
    right = (first_largest([F.col(p) for p in _P]) == F.col("y")).cast("double")
    return predictions.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.avg(-F.log(_clip(own))).alias("log_loss"), F.avg(right).alias("accuracy"), F.avg(squares).alias("brier_score"))


def one_against_rest(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by, k, p, hit)``: three rows a prediction."""
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.col(p).alias("p"), (F.col("y") == k).cast("int").alias("hit")) for k, p in enumerate(_P)])
    return predictions.select(*(by or []), F.inline(parts))


def _score_counts(predictions: DataFrame, by: list[str]) -> DataFrame:
    """``(by, k, p, hits, misses)``: a row for each distinct score."""
    return one_against_rest(predictions, by).groupBy(*by, "k", "p").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))


def gini(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """gini_home, gini_draw, gini_away and gini_macro; null where an outcome is never or always there.

    2 AUC - 1 from counts by distinct score: ties count half. The running count
    goes over distinct scores, after a map-side aggregate, by ranges of scores.
    """
    by = by or []
    scores = ranged(_score_counts(predictions, by), "p")
    below = running_sums(scores, [*by, "k"], "p", ["misses"])
    pairs = below.withColumn("won", F.col("hits") * (F.col("misses_before") + F.col("misses") / 2))
    areas = pairs.groupBy(*by, "k").agg(F.sum("won").alias("won"), F.sum("hits").alias("h"), F.sum("misses").alias("m"))
    value = F.when((F.col("h") > 0) & (F.col("m") > 0), 2 * F.col("won") / (F.col("h") * F.col("m")) - 1)
    wide = areas.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, value)).alias(f"gini_{o}") for k, o in enumerate(OUTCOMES)])
    return wide.withColumn("gini_macro", (F.col("gini_home") + F.col("gini_draw") + F.col("gini_away")) / 3)


def binary_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """log_loss_* and brier_* of each outcome against the rest."""
    out = []
    for k, (p, o) in enumerate(zip(_P, OUTCOMES)):
        hit = F.col("y") == k
        out += [F.avg(-F.log(_clip(F.when(hit, F.col(p)).otherwise(1 - F.col(p))))).alias(f"log_loss_{o}"), F.avg(F.pow(F.col(p) - hit.cast("double"), 2)).alias(f"brier_{o}")]
    return predictions.groupBy(*(by or [])).agg(*out)


def all_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    parts = [f(predictions, by) for f in (probability_metrics, binary_metrics, gini)]
    joined = parts[0]
    for more in parts[1:]:
        joined = joined.join(more, by) if by else joined.crossJoin(F.broadcast(more))  # one row each
    return joined


def class_priors(labels: DataFrame, y: str = "y") -> DataFrame:
    """Relative frequency of each class as prior_0 to prior_2; 0 for absent ones."""
    return labels.agg(*[F.avg((F.col(y) == k).cast("double")).alias(f"prior_{k}") for k in range(3)])


def calibration(predictions: DataFrame, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Count, mean probability and observed frequency by outcome and bin; empty bins are left out."""
    by = by or []
    rows = one_against_rest(predictions, by).withColumn("bin", probability_bin(F.col("p"), bins))
    outcome = F.get(F.array(*map(F.lit, "HDA")), F.col("k"))
    return rows.groupBy(*by, outcome.alias("outcome"), "bin").agg(F.count("*").alias("count"), F.avg("p").alias("mean_probability"), F.avg("hit").alias("observed_frequency"))


def roc_points(predictions: DataFrame, by: list[str] | None = None, points: int = 300) -> DataFrame:
    """``(by, outcome, fpr, tpr)``: the curve's corners, thinned evenly to ``points``; the starting point (0, 0) included.

    Scores are cut into ranges, so no task holds a curve.
    """
    by = by or []
    keys = [*by, "k"]
    scores = _score_counts(predictions, by)
    both = scores.groupBy(*keys).agg(F.sum("hits").alias("h"), F.sum("misses").alias("m")).where("h > 0 AND m > 0")
    curve = running_sums(ranged(scores, "p", descending=True), keys, "p", ["hits", "misses"], descending=True)
    bend = followers(curve, keys, "p", F.struct("hits", "misses"), "more", descending=True)
    # A point in the middle of a straight piece says nothing and goes, as ties and runs of one kind make them.
    corner = F.col("more").isNull() | (F.col("more.hits") * F.col("misses") != F.col("more.misses") * F.col("hits"))
    corners = bend.where(corner).withColumn("one", F.lit(1).cast("long"))
    numbered = running_sums(corners, keys, "p", ["one"], descending=True)
    sizes = numbered.groupBy(*keys).agg((F.count(F.lit(1)) + 1).alias("n"))
    totals = both.join(sizes, keys) if not by else both.alias("b").join(sizes.alias("s"), [F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]).select("b.*", "s.n")
    places = numbered.select(*keys, (F.col("one_before") + 1).alias("i"), (F.col("hits") + F.col("hits_before")).alias("tp"), (F.col("misses") + F.col("misses_before")).alias("fp"))
    places = places.unionByName(totals.select(*keys, *[F.lit(0).cast("long").alias(c) for c in ("i", "tp", "fp")]))
    met = places.alias("p").join(totals.alias("t"), [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]).select("p.*", "t.h", "t.m", "t.n")
    keep = F.least(F.col("n"), F.lit(points))
    # Point i stays if it is the whole part of j (n - 1) / (keep - 1) for some j.
    j = F.ceil(F.col("i") * (keep - 1) / (F.col("n") - 1))
    kept = met.where((F.col("n") <= points) | (F.floor(j * (F.col("n") - 1) / (keep - 1)) == F.col("i")))
    return kept.select(*by, F.get(F.array(*map(F.lit, OUTCOMES)), F.col("k")).alias("outcome"), (F.col("fp") / F.col("m")).alias("fpr"), (F.col("tp") / F.col("h")).alias("tpr"))


def outcome_summary(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean probability, observed frequency and share of predictions for each outcome."""
    by = by or []
    named = predictions.withColumn("__best", first_largest([F.col(p) for p in _P]))
    parts = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(p).alias("p"), (F.col("y") == k).cast("double").alias("hit"), (F.col("__best") == k).cast("double").alias("chosen")) for k, (p, o) in enumerate(zip(_P, OUTCOMES))])
    return named.select(*by, F.inline(parts)).groupBy(*by, "outcome").agg(F.avg("p").alias("model_probability"), F.avg("hit").alias("observed_frequency"), F.avg("chosen").alias("predicted_share"))


def _sure(threshold: float, enabled: bool) -> Column:
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return F.greatest(*_P) >= threshold if enabled else F.lit(True)


def confident(predictions: DataFrame, threshold: float = 0.6, enabled: bool = True) -> DataFrame:
    """Predictions whose largest probability reaches ``threshold``; all of them unless ``enabled``."""
    return predictions.where(_sure(threshold, enabled))


def confidence_outcomes(predictions: DataFrame, by: list[str], threshold: float = 0.6, enabled: bool = True) -> DataFrame:
    """Mean probability and observed frequency of each outcome over the confident predictions; null where none is."""
    kept = _sure(threshold, enabled)
    parts = F.array(*[F.struct(F.lit(o).alias("outcome"), F.when(kept, F.col(p)).alias("p"), F.when(kept, (F.col("y") == k).cast("double")).alias("hit")) for k, (p, o) in enumerate(zip(_P, OUTCOMES))])
    return predictions.select(*by, F.inline(parts)).groupBy(*by, "outcome").agg(F.avg("p").alias("model_probability"), F.avg("hit").alias("observed_frequency"))


def confidence_coverage(predictions: DataFrame, by: list[str], threshold: float = 0.6, enabled: bool = True) -> DataFrame:
    """How many predictions are confident enough, and how often they are right; null where none is."""
    kept = _sure(threshold, enabled)
    right = (first_largest([F.col(p) for p in _P]) == F.col("y")).cast("double")
    counted = predictions.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.avg(F.when(kept, right)).alias("accuracy_kept"))
    return counted.withColumns({"filtered_out": F.col("total") - F.col("kept"), "share_kept": F.col("kept") / F.col("total")})


def weighted_summary(folds: DataFrame, by: str, metrics: list[str], rows: str = "rows") -> DataFrame:
    """Row-weighted means of fold metrics, best log loss first."""
    return folds.groupBy(by).agg(F.sum(rows).alias(rows), *[(F.sum(F.col(m) * F.col(rows)) / F.sum(rows)).alias(m) for m in metrics]).orderBy(metrics[0], by)
