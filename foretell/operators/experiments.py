"""Chronological experiments: walk-forward comparison, univariate diagnostics, screening, subset search, season refits."""

from __future__ import annotations

import datetime as dt
import math
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.operators.betting import pooled
from foretell.operators.metrics import OUTCOMES, all_metrics, calibration, class_priors, confidence_coverage, confidence_outcomes, confident, outcome_summary, probability_metrics, roc_points
from foretell.operators.blocks import counts, extremes, make_blocks
from foretell.operators.models import PROBABILITIES, Model, distinct_dates, fit_blocks, fit_logistic, fit_logistics, fit_models, fit_team_logistics, modeling_data, predict_many, time_split, with_team_label, with_team_predictions
from foretell.schema import FEATURE_GROUPS, canonical

PARTITIONS = ["train", "validation", "test"]


def _as_predictions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", F.col("target_label"))


def _rows(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in records], schema)


def walk_forward_blocks(dates: list, n_splits: int = 3) -> tuple[list[tuple], object]:
    """``(first, last)`` date of each evaluation block, and the first date of the untouched last 15 %."""
    if n_splits < 1:
        raise ValueError("at least one fold is needed")
    holdout = min(int(len(dates) * 0.85), len(dates) - 1)
    development = dates[:holdout]
    if len(development) < 2 * (n_splits + 1):
        raise ValueError("there are fewer days than the folds need")
    rest = development[len(development) // 2 :]
    size, longer = divmod(len(rest), n_splits)
    cuts = np.cumsum([0] + [size + (k < longer) for k in range(n_splits)])
    return [(rest[a], rest[z - 1]) for a, z in zip(cuts, cuts[1:])], dates[holdout]


def fold_table(data: DataFrame, n_splits: int = 3) -> DataFrame:
    """The folds of ``walk_forward`` over ``modeling_data``: training and evaluation rows and days, and the first day held out."""
    blocks, holdout = walk_forward_blocks(distinct_dates(data), n_splits)
    day = F.col("MatchDate")
    counted = data.agg(*[F.struct(F.count_if(day < first).alias("train"), F.max(F.when(day < first, day)).alias("until"), F.count_if(day.between(first, last)).alias("eval")) for first, last in blocks]).first()
    folds = [{"fold": f + 1, "train_rows": counted[f].train, "train_end": counted[f].until, "eval_start": first, "eval_end": last, "eval_rows": counted[f].eval, "holdout_start": holdout} for f, (first, last) in enumerate(blocks)]
    return _rows(data.sparkSession, folds, "fold int, train_rows long, train_end date, eval_start date, eval_end date, eval_rows long, holdout_start date")


def walk_forward(engineered: DataFrame, groups: dict[str, list[str]] | None = None, n_splits: int = 3) -> tuple[DataFrame, DataFrame]:
    """Fold metrics by feature group, and the groups' calibration, on expanding date folds with equal rows.

    All groups' models of all folds are fitted in the same passes.
    """
    groups = FEATURE_GROUPS if groups is None else groups
    groups = {group: canonical(columns) for group, columns in groups.items()}
    data, _ = modeling_data(engineered, [c for columns in groups.values() for c in columns])
    blocks, holdout = walk_forward_blocks(distinct_dates(data), n_splits)
    day = F.unix_date("MatchDate")
    limits = [float((first - dt.date(1970, 1, 1)).days) for first, _ in blocks]
    models = fit_models(data, {(group, f): (f, columns) for f in range(len(blocks)) for group, columns in groups.items()}, limits, day)
    counted = data.agg(*[F.struct(F.count_if(day < b).alias("n"), F.max(F.when(day < b, F.col("MatchDate"))).alias("last")) for b in limits]).first()
    evaluated, folds = None, []
    for f, (first, last) in enumerate(blocks):
        block = _as_predictions(data.where(F.col("MatchDate").between(first, last))).withColumn("fold", F.lit(f + 1))
        part = predict_many(block, {group: models[group, f] for group in groups}, "feature_group", ["fold", "y"])
        evaluated = part if evaluated is None else evaluated.union(part)
        folds += [{"feature_group": group, "fold": f + 1, "features": len(columns), "train_rows": counted[f].n, "train_end": counted[f].last, "eval_start": first, "eval_end": last, "holdout_start": holdout, "converged": models[group, f].converged} for group, columns in groups.items()]
    evaluated = evaluated.select("feature_group", "fold", "y", *PROBABILITIES).persist()  # each metric reads them
    details = _rows(engineered.sparkSession, folds, "feature_group string, fold int, features int, train_rows long, train_end date, eval_start date, eval_end date, holdout_start date, converged boolean")
    keys = ["feature_group", "fold"]
    # A row for each group and fold.
    return probability_metrics(evaluated, keys).join(F.broadcast(details), keys), calibration(evaluated, ["feature_group"])


def univariate_models(train: DataFrame, columns: list[str], c: float = 1.0) -> tuple[dict[str, str], dict[str, Model]]:
    """(status, model) by column: for each column the logistic model on it alone, a text column by its indicators.

    All columns' models are fitted in the same passes. Constant and missing
    columns get a status and no model.
    """
    blocks = make_blocks(train, columns)
    try:
        n = counts(blocks, [math.inf])
        least, most = extremes(blocks, [math.inf], n)
        places = {name: i for i, name in enumerate(blocks.names)}
        status = {}
        for column in columns:
            if column in blocks.categories:
                values = len(blocks.categories[column])
                status[column] = "OK" if values > 1 else "constant in train" if values else "missing in train"
            else:
                i = places[column, None]
                status[column] = "missing in train" if not n[0, i] else "OK" if least[0, i] < most[0, i] else "constant in train"
        models = fit_blocks(blocks, {x: (0, [x]) for x, s in status.items() if s == "OK"}, c=c)
    finally:
        blocks.release()
    return {x: s if s != "OK" or models[x].converged else "not converged" for x, s in status.items()}, models


def univariate_predictions(rows: DataFrame, models: dict[str, Model], columns: list[str], priors: list[float]) -> DataFrame:
    """``(feature, y, p0, p1, p2)``: a row for each row and column; columns without a model predict the training priors."""
    labelled = _as_predictions(rows)
    flat = F.array(*[F.struct(F.lit(x).alias("feature"), *[F.lit(float(p)).alias(n) for n, p in zip(PROBABILITIES, priors)]) for x in columns if x not in models])
    parts = [predict_many(labelled, models, "feature", ["y"]).select("feature", "y", *PROBABILITIES)] if models else []
    if len(models) < len(columns):
        parts.append(labelled.select("y", F.inline(flat)).select("feature", "y", *PROBABILITIES))
    return reduce(DataFrame.union, parts)


def _priors(train: DataFrame) -> list[float]:
    priors = list(class_priors(train, "target_label").first())
    if sum(p > 0 for p in priors) < 2:
        raise ValueError("all training rows have one outcome")
    return priors


def _score_columns(train: DataFrame, scored: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str], list[float]]:
    priors = _priors(train)
    status, models = univariate_models(train, columns)
    return all_metrics(univariate_predictions(scored, models, columns, priors).persist(), ["feature"]), status, priors  # each metric reads them


def _dummy(rows: DataFrame, priors: list[float]) -> DataFrame:
    return rows.select(F.col("target_label").alias("y"), *[F.lit(p).alias(f"p{k}") for k, p in enumerate(priors)])


def individual_features(engineered: DataFrame, columns: list[str] | None = None, train_end_year: int = 2022, validation_end_year: int = 2024) -> dict[str, DataFrame]:
    """One logistic model for each feature on the same test rows: ``scores`` with gains over the training priors, best first, ``outcomes``, ``dummy`` and ``split``."""
    data, columns = modeling_data(engineered, columns)
    if not columns:
        raise ValueError("at least one feature is needed")
    spark = engineered.sparkSession
    parts = dict(zip(PARTITIONS, time_split(data, train_end_year, validation_end_year)))
    train, test = parts["train"], parts["test"]
    scores, status, priors = _score_columns(train, test, columns)
    flat = all_metrics(_dummy(test, priors))
    dummy = flat.first()
    lacking = "; an outcome is missing in train" if min(priors) == 0 else ""
    statuses = _rows(spark, [{"feature": c, "status": s + lacking} for c, s in status.items()], "feature string, status string")
    span = lambda name, rows: rows.agg(F.lit(name).alias("partition"), F.min("MatchDate").alias("start"), F.max("MatchDate").alias("end"), F.count(F.lit(1)).alias("rows"))
    split = reduce(DataFrame.union, [span(name, rows) for name, rows in parts.items()])
    sizes = {r.partition: r.rows for r in split.collect()}
    missing = lambda rows, name: rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias(name)) for c in columns])))
    out = statuses.join(F.broadcast(scores), "feature").join(F.broadcast(missing(train, "train_missing")), "feature").join(F.broadcast(missing(test, "test_missing")), "feature")  # a row for each column
    gains = {"train_rows": F.lit(sizes["train"]), "test_rows": F.lit(sizes["test"]), "log_loss_gain": dummy.log_loss - F.col("log_loss"), "brier_gain": dummy.brier_score - F.col("brier_score"), "accuracy_gain": F.col("accuracy") - dummy.accuracy}
    gains |= {f"{m}_gain_{o}": dummy[f"{m}_{o}"] - F.col(f"{m}_{o}") for m in ("log_loss", "brier") for o in OUTCOMES}
    seen = lambda name, rows: rows.agg(*[F.count_if(F.col("target_label") == k).alias(o) for k, o in enumerate(OUTCOMES)]).select(F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias(name)) for o in OUTCOMES])))
    priors_of = _rows(spark, [{"outcome": o, "dummy_probability": p, "dummy_gini": dummy[f"gini_{o}"], "dummy_log_loss": dummy[f"log_loss_{o}"], "dummy_brier": dummy[f"brier_{o}"]} for o, p in zip(OUTCOMES, priors)], "outcome string, dummy_probability double, dummy_gini double, dummy_log_loss double, dummy_brier double")
    outcomes = seen("train_count", train).join(seen("test_count", test), "outcome").join(priors_of, "outcome").withColumn("test_frequency", F.col("test_count") / sizes["test"])
    return {"scores": out.withColumns(gains).orderBy(F.desc("log_loss_gain"), "feature"), "outcomes": outcomes, "dummy": flat, "split": split}


def screen(train: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, screen_gini, screen_log_loss_gain, screen_status)``: fitted on the first 80 % of the training dates, scored on the rest."""
    dates = distinct_dates(train)
    if len(dates) < 5:
        raise ValueError("screening needs at least five distinct training dates")
    cutoff = dates[min(len(dates) - 1, max(1, int(len(dates) * 0.8)))]
    early, late = train.where(F.col("MatchDate") < cutoff), train.where(F.col("MatchDate") >= cutoff)
    columns = canonical(columns)
    scores, status, priors = _score_columns(early, late, columns)
    dummy = all_metrics(_dummy(late, priors)).first()
    statuses = _rows(train.sparkSession, [{"feature": c, "screen_status": s} for c, s in status.items()], "feature string, screen_status string")
    return statuses.join(F.broadcast(scores), "feature").select("feature", F.col("gini_macro").alias("screen_gini"), (dummy.log_loss - F.col("log_loss")).alias("screen_log_loss_gain"), "screen_status")


def eligible(screening: DataFrame, threshold: float = 0.02) -> DataFrame:
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return screening.where((F.col("screen_gini") > threshold) & (F.col("screen_status") == "OK")).select("feature")


def feature_subsets(features: list[str], n: int = 50, least: int = 5, most: int = 20, seed: int = 42) -> list[tuple[str, ...]]:
    """``n`` different random subsets, the same for the same seed; all possible ones are listed first where there are few."""
    names = sorted(canonical(features))
    if n < 1 or not 1 <= least <= most <= len(names):
        raise ValueError(f"need n >= 1 and 1 <= least <= most <= {len(names)}")
    total = sum(comb(len(names), k) for k in range(least, most + 1))
    rng = np.random.default_rng(seed)
    if total <= 10_000:
        listed = [x for k in range(least, most + 1) for x in combinations(names, k)]
        return [listed[i] for i in rng.choice(total, size=min(n, total), replace=False)]
    found: dict[tuple[str, ...], None] = {}
    while len(found) < min(n, total):
        size = int(rng.integers(least, most + 1))
        found.setdefault(tuple(sorted(rng.choice(names, size=size, replace=False).tolist())))
    return list(found)


def subset_search(engineered: DataFrame, features: list[str], n: int = 50, least: int = 5, most: int = 20, seed: int = 42, progress=None) -> DataFrame:
    """A row for each simulation and partition: the subset, its metrics and its gain over the training priors."""
    subsets = feature_subsets(features, n, least, most, seed)
    data, _ = modeling_data(engineered, features)
    parts = dict(zip(PARTITIONS, time_split(data)))
    priors = _priors(parts["train"])
    dummies = {name: probability_metrics(_dummy(part, priors)).first().log_loss for name, part in parts.items()}
    fitted = fit_logistics(parts["train"], {number: list(subset) for number, subset in enumerate(subsets, 1)}, progress=progress)
    scored = None
    for name, part in parts.items():
        one = predict_many(_as_predictions(part).withColumn("partition", F.lit(name)), fitted, "simulation", ["partition", "y"])
        scored = one if scored is None else scored.union(one)
    details = [{"simulation": k, "features": m.columns, "n_features": len(m.columns), "status": "OK" if m.converged else "not converged"} for k, m in fitted.items()]
    spark = engineered.sparkSession
    details = _rows(spark, details, "simulation int, features array<string>, n_features int, status string")
    priors_loss = _rows(spark, [{"partition": name, "prior_log_loss": loss} for name, loss in dummies.items()], "partition string, prior_log_loss double")
    # A row for each subset, and for each partition.
    out = all_metrics(scored, ["simulation", "partition"]).join(F.broadcast(details), "simulation").join(F.broadcast(priors_loss), "partition")
    return out.withColumn("log_loss_gain", F.col("prior_log_loss") - F.col("log_loss")).drop("prior_log_loss")


def rank_subsets(results: DataFrame, partition: str = "test", metric: str = "gini_macro") -> DataFrame:
    if partition not in PARTITIONS or metric not in ("gini_macro", "log_loss", "brier_score"):
        raise ValueError("unknown ranking")
    best = F.desc(metric) if metric == "gini_macro" else F.asc(metric)
    return results.where((F.col("partition") == partition) & (F.col("status") == "OK") & F.col(metric).isNotNull()).orderBy(best, "simulation")


def logistic_report(engineered: DataFrame, features: list[str], threshold: float = 0.6) -> dict[str, DataFrame]:
    """One model's metrics, outcome summaries, calibration, ROC curves, predictions and confident shares, by partition."""
    columns = canonical(features)
    if not columns:
        raise ValueError("the model needs at least one feature")
    data, _ = modeling_data(engineered, columns)
    parts = dict(zip(PARTITIONS, time_split(data)))
    model, priors = fit_logistic(parts["train"], columns), _priors(parts["train"])
    rows = None
    for name, part in parts.items():
        one = _as_predictions(model.predict(part)).select(F.lit(name).alias("partition"), "MatchDate", "League", "HomeTeam", "AwayTeam", "y", *PROBABILITIES)
        rows = one if rows is None else rows.union(one)
    rows, by = rows.persist(), ["partition"]  # each metric reads them
    dummy = rows.withColumns({f"p{k}": F.lit(p) for k, p in enumerate(priors)})
    metrics = all_metrics(rows, by).withColumn("model", F.lit("logistic")).unionByName(all_metrics(dummy, by).withColumn("model", F.lit("dummy"))).withColumn("converged", F.lit(model.converged))
    splits = rows.groupBy("partition").agg(F.min("MatchDate").alias("start"), F.max("MatchDate").alias("end"), F.count(F.lit(1)).alias("rows"))
    given = rows.withColumns({f"dummy_{k}": F.lit(p) for k, p in enumerate(priors)})
    return {"predictions": given, "metrics": metrics, "outcomes": outcome_summary(rows, by), "calibration": calibration(rows, by), "roc": roc_points(rows, by), "confidence": confidence_coverage(rows, by, threshold), "splits": splits}


def confidence_report(report: dict[str, DataFrame], threshold: float = 0.6, enabled: bool = True) -> dict[str, DataFrame]:
    """``logistic_report`` over its confident predictions: ``outcomes``, ``coverage`` and the rows ``selected``, by partition.

    The priors beside each outcome's means stay those of all training rows,
    whatever the filter leaves.
    """
    rows, by = report["predictions"], ["partition"]
    priors = rows.agg(*[F.max(f"dummy_{k}").alias(o) for k, o in enumerate(OUTCOMES)]).select(F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("prior")) for o in OUTCOMES])))
    means = confidence_outcomes(rows, by, threshold, enabled)
    return {"outcomes": means.join(F.broadcast(priors), "outcome"), "coverage": confidence_coverage(rows, by, threshold, enabled), "selected": confident(rows, threshold, enabled)}  # priors: a row for each outcome


def season_walk_forward(team: DataFrame, first_test_season: str) -> DataFrame:
    """Each season predicted by a model of the seasons before it, one H/D/A distribution a match.

    All seasons' models are fitted in the same passes; a season's place in order tells the folds apart.
    """
    rows = with_team_label(team)
    found = rows.where("Season IS NOT NULL").groupBy("Season").agg(F.collect_set("target_label").alias("labels")).collect()  # a row a season
    labels = {r.Season: set(r.labels) for r in found}
    seasons = sorted(labels)
    ready = [s for s in seasons if s >= first_test_season and len(set().union(*[labels[x] for x in seasons if x < s])) > 1]
    if not ready:
        raise ValueError("no season has both earlier results and its own")
    place = F.array_position(F.array(*map(F.lit, seasons)), F.col("Season")).cast("double")  # null: in no fold
    models = fit_team_logistics(rows, {s: seasons.index(s) + 1.0 for s in ready}, F.coalesce(place, F.lit(math.inf)))
    return reduce(DataFrame.union, [pooled(with_team_predictions(models[s], rows.where(F.col("Season") == s))) for s in ready])
