"""Three-outcome models under chronological splits; all preprocessing is learned from training rows only."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.functions.scalars import first_largest
from foretell.operators.blocks import Blocks, counts, gram, label_counts, make_blocks, medians, moments
from foretell.operators.many_fits import MAX_PASSES, Fit, fit_many
from foretell.schema import BEST_LOGISTIC, CLASS_ORDER, FEATURE_GROUPS, FEATURE_SETS, canonical

PRUNE_AT = 0.90
PROBABILITIES = ["p0", "p1", "p2"]
#: Training rows a task of a forest gets at least; a level of its trees is a job, so that small tables shouldn't pay for many tasks in each.
ROWS_A_TASK = 5_000


def modeling_data(engineered: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Rows with a result and a date, and the canonical feature columns; missing statistics stay missing."""
    columns = canonical(FEATURE_GROUPS["all_features"] if columns is None else columns)
    if missing := sorted(set(columns) - set(engineered.columns)):
        raise ValueError(f"the frame lacks the features {missing}")
    rows = engineered.where(F.col("target_label").isin(0, 1, 2) & F.col("MatchDate").isNotNull())
    return rows.withColumn("target_label", F.col("target_label").cast("int")), columns


def distinct_dates(data: DataFrame) -> list:
    """All match dates in order: a list of days, however many rows there are."""
    return [r[0] for r in data.select("MatchDate").distinct().orderBy("MatchDate").collect()]


def time_split(data: DataFrame, train_end_year: int = 2022, validation_end_year: int = 2024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test by year; by 65 % and 85 % of the dates if one of them would be empty."""
    if train_end_year >= validation_end_year:
        raise ValueError("validation has to end after training")
    year = F.year("MatchDate")
    found = data.agg(F.count_if(F.col("MatchDate").isNull()), F.count_if(year <= train_end_year), F.count_if((year > train_end_year) & (year <= validation_end_year)), F.count_if(year > validation_end_year)).first()
    if found[0]:
        raise ValueError("rows without a date can't be split by time")
    if all(found[1:]):
        return data.where(year <= train_end_year), data.where((year > train_end_year) & (year <= validation_end_year)), data.where(year > validation_end_year)
    dates = distinct_dates(data)
    if len(dates) < 3:
        raise ValueError(f"{len(dates)} days are too few for three parts")
    first = min(max(1, int(len(dates) * 0.65)), len(dates) - 2)
    second = min(max(first + 1, int(len(dates) * 0.85)), len(dates) - 1)
    day = F.col("MatchDate")
    return data.where(day < dates[first]), data.where((day >= dates[first]) & (day < dates[second])), data.where(day >= dates[second])


@dataclass
class Encoder:
    """Numeric columns: median for missing values, then mean 0 and (population) deviation 1. Text columns: the mode for missing values, then indicators; unknown values have none."""

    numeric: list[str]
    medians: list[float]
    means: list[float]
    scales: list[float]
    categories: dict[str, list[str]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}_{v}" for c, values in self.categories.items() for v in values]]

    def values(self) -> list[Column]:
        out = [(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) - a) / s for c, m, a, s in zip(self.numeric, self.medians, self.means, self.scales)]
        return out + [(F.coalesce(F.col(c), F.lit(self.modes.get(c))) == v).cast("double") for c, values in self.categories.items() for v in values]

    def places(self, columns: list[str]) -> list[int]:
        """Where the values of ``columns`` lie among all values."""
        owners = [*self.numeric, *[c for c, values in self.categories.items() for _ in values]]
        return [i for i, c in enumerate(owners) if c in set(columns)]

    def only(self, columns: list[str]) -> Encoder:
        """The encoder of some of the columns; what it learned of one doesn't depend on the others."""
        at = [i for i, c in enumerate(self.numeric) if c in set(columns)]
        pick = lambda x: [x[i] for i in at]
        inside = lambda d: {c: v for c, v in d.items() if c in set(columns)}
        return Encoder(pick(self.numeric), pick(self.medians), pick(self.means), pick(self.scales), inside(self.categories), inside(self.modes))

    def vector(self) -> Column:
        return array_to_vector(F.array(*[F.coalesce(x, F.lit(0.0)) for x in self.values()]))


def fit_encoders(blocks: Blocks, columns: list[str], limits: list[float], prune_at: float | None = None, drop_if_binary: bool = False) -> list[Encoder]:
    """An encoder for each fold: exact medians, modes, then means and deviations of the filled columns, in passes over all columns and folds.

    With ``prune_at``, a numeric column goes if its absolute correlation with an
    earlier kept one reaches it; constant columns correlate with none.
    """
    names = blocks.names
    n = counts(blocks, limits)
    plain = np.array([v is None for _, v in names])
    middle = medians(blocks, limits, np.where(plain, n, 0))
    shown = blocks.sums(lambda x, y, place: np.array([np.nansum(x[place < b], axis=0) for b in limits]))
    shown = np.zeros(n.shape) if shown is None else shown.reshape(n.shape)
    modes, seen = [], []
    for f in range(len(limits)):
        by = {c: [v for v in values if shown[f, names.index((c, v))] > 0] for c, values in blocks.categories.items() if c in columns}
        seen.append(by)
        modes.append({c: max(values, key=lambda v, c=c, f=f: shown[f, names.index((c, v))]) for c, values in by.items() if values})  # of equals the first
    fill = np.where(np.isnan(middle), 0.0, middle)
    for f, mode in enumerate(modes):
        for i, (c, v) in enumerate(names):
            if v is not None:
                fill[f, i] = float(mode.get(c) == v)
    _, mean, scale = moments(blocks, limits, fill)
    related = np.zeros((len(limits), len(names), len(names)))
    if prune_at is not None:
        rows, _, products = gram(blocks, limits, fill, mean)
        spread = scale[:, :, None] * scale[:, None, :] * np.maximum(rows, 1)[:, None, None]
        related = np.where(spread > 0, np.abs(products) / np.where(spread > 0, spread, 1.0), 0.0)
    out = []
    for f in range(len(limits)):
        kept: list[int] = []
        for c in [c for c in columns if c in blocks.numeric]:
            j = names.index((c, None))
            if prune_at is None or all(related[f, i, j] < prune_at for i in kept):
                kept.append(j)
        pick = lambda x, f=f, kept=kept: [float(x[f, j]) for j in kept]
        categories = {c: v[1:] if drop_if_binary and len(v) == 2 else v for c, v in seen[f].items()}
        scales = [s if s else 1.0 for s in pick(scale)]
        out.append(Encoder([names[j][0] for j in kept], pick(fill), pick(mean), scales, categories, modes[f]))
    return out


def fit_encoder(train: DataFrame, columns: list[str], prune_at: float | None = None, drop_if_binary: bool = False, label: str = "target_label") -> Encoder:
    """The encoder of one training table."""
    blocks = make_blocks(train, columns, label)
    try:
        return fit_encoders(blocks, columns, [math.inf], prune_at, drop_if_binary)[0]
    finally:
        blocks.release()


@dataclass
class Linear:
    """Weights and intercepts of each class, or of the second of two."""

    weights: list[list[float]]
    intercepts: list[float]
    passes: int = 0


def _chances(x: Column, given: Column) -> list[Column]:
    """p0, p1, p2 of encoded values under weights ``w``, intercepts ``b`` and the ``known`` classes."""
    logit = lambda k: given["b"][k] + F.aggregate(F.zip_with(x, given["w"][k], lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)
    scores = [F.when(given["known"][k], logit(k)) for k in range(3)]
    top = F.greatest(*scores)
    grown = [F.coalesce(F.exp(s - top), F.lit(0.0)) for s in scores]
    return [g / (grown[0] + grown[1] + grown[2]) for g in grown]


@dataclass
class Model:
    """A fitted classifier over encoded columns; ``classes`` are the labels (0, 1, 2) that training had."""

    encoder: Encoder
    classes: list[int]
    fitted: Linear | RandomForestClassificationModel
    columns: list[str]
    #: Whether the gradient vanished before the last pass; forests always come to rest.
    converged: bool = True

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` and p0, p1, p2; 0 for classes that training lacked."""
        if isinstance(self.fitted, Linear):
            table = dict(zip(("w", "b", "known"), self.by_class(), strict=True))
            given = F.from_json(F.lit(json.dumps(table)), "struct<w: array<array<double>>, b: array<double>, known: array<boolean>>")
            x = F.array(*[F.coalesce(v, F.lit(0.0)) for v in self.encoder.values()]).cast("array<double>")
            out = rows.withColumns({"__x": x, "__m": given})
            return out.withColumns(dict(zip(PROBABILITIES, _chances(F.col("__x"), F.col("__m")), strict=True))).drop("__x", "__m")
        out = self.fitted.transform(rows.drop("probability", "rawPrediction", "prediction", "features").withColumn("features", self.encoder.vector()))
        chance = vector_to_array("probability")
        return out.withColumns({p: F.get(chance, self.classes.index(k)) if k in self.classes else F.lit(0.0) for k, p in enumerate(PROBABILITIES)}).drop("features", "rawPrediction", "probability", "prediction")

    def by_class(self) -> tuple[list[list[float]], list[float], list[bool]]:
        """(weights, intercepts, whether training had it) of the labels 0, 1 and 2; of two classes the first has zeros."""
        none = [0.0] * len(self.encoder.names)
        free = dict(zip(self.classes if len(self.classes) > 2 else self.classes[1:], zip(self.fitted.weights, self.fitted.intercepts, strict=True), strict=True))
        return [list(free[k][0]) if k in free else none for k in range(3)], [float(free[k][1]) if k in free else 0.0 for k in range(3)], [k in self.classes for k in range(3)]

    def coefficients(self, label: int) -> tuple[np.ndarray, float]:
        """Weights and intercept of a class's log odds; for two classes those of the second are the model's, the first has their negatives."""
        k = self.classes.index(label)
        if len(self.classes) > 2:
            return np.array(self.fitted.weights[k]), float(self.fitted.intercepts[k])
        sign = 1.0 if k == 1 else -1.0
        return sign * np.array(self.fitted.weights[0]), sign * float(self.fitted.intercepts[0])


def _labelled(train: DataFrame, label: str) -> tuple[DataFrame, list[int], int, dict[int, int]]:
    counts = {r[0]: r[1] for r in train.groupBy(F.col(label).cast("int")).count().collect() if r[0] is not None}
    classes = sorted(counts)
    if len(classes) < 2:
        raise ValueError("all training rows have one outcome")
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("int")) - 1
    return train.withColumn("__label", place.cast("double")), classes, sum(counts.values()), counts


def _fit(blocks: Blocks, encoder: Encoder, limit: float, found: np.ndarray, c: float, balanced: bool) -> Fit:
    classes = [k for k in range(3) if found[k] > 0]
    if len(classes) < 2:
        raise ValueError("all training rows have one outcome")
    places = {name: i for i, name in enumerate(blocks.names)}
    text = [(x, v) for x, values in encoder.categories.items() for v in values]
    at = np.array([places[x, None] for x in encoder.numeric] + [places[x] for x in text], int)
    fill = np.array([*encoder.medians, *[float(encoder.modes.get(x) == v) for x, v in text]])
    mean, scale = np.array([*encoder.means, *[0.0] * len(text)]), np.array([*encoder.scales, *[1.0] * len(text)])
    own = found[classes]
    return Fit(at, fill, mean, scale, limit, classes, own, c, own.sum() / (len(classes) * own) if balanced else None)


def fit_models(data: DataFrame, wanted: dict, limits: list[float] | None = None, place: Column | None = None, c: float = 1.0, label: str = "target_label", prune_at: float | None = None, drop_if_binary: bool = False, balanced: bool = False, max_iter: int = MAX_PASSES, progress=None) -> dict:
    """L2-penalised multinomial logistic regressions, all fitted in the same passes; each minimises C x the summed loss + half the squared weights (intercepts free).

    ``wanted`` maps a key to (fold, columns); fold f trains on the rows whose
    ``place`` is below ``limits[f]``, with an encoder of its own. Without
    folds all rows train.
    """
    columns = list(dict.fromkeys(x for _, given in wanted.values() for x in given))
    blocks = make_blocks(data, columns, label, place)
    try:
        return fit_blocks(blocks, wanted, limits, c, prune_at, drop_if_binary, balanced, max_iter, progress)
    finally:
        blocks.release()


def fit_blocks(blocks: Blocks, wanted: dict, limits: list[float] | None = None, c: float = 1.0, prune_at: float | None = None, drop_if_binary: bool = False, balanced: bool = False, max_iter: int = MAX_PASSES, progress=None) -> dict:
    """``fit_models`` over blocks that are there already."""
    limits = [math.inf] if limits is None else limits
    found = label_counts(blocks, limits)
    if prune_at is None:  # what an encoder learned of a column doesn't depend on the others
        whole = fit_encoders(blocks, list(dict.fromkeys(x for _, given in wanted.values() for x in given)), limits)
        encoders = {key: whole[f].only(given) for key, (f, given) in wanted.items()}
    else:
        by = {given: fit_encoders(blocks, list(given), limits, prune_at, drop_if_binary) for given in {tuple(given) for _, given in wanted.values()}}
        encoders = {key: by[tuple(given)][f] for key, (f, given) in wanted.items()}
    fits = {key: _fit(blocks, encoders[key], limits[f], found[f], c, balanced) for key, (f, _) in wanted.items()}
    fit_many(blocks, fits, max_iter, progress)
    return {key: Model(encoders[key], fit.classes, Linear(fit.w[:, :-1].tolist(), fit.w[:, -1].tolist(), fit.passes), list(wanted[key][1]), fit.converged) for key, fit in fits.items()}


def fit_logistic(train: DataFrame, columns: list[str], c: float = 1.0, label: str = "target_label", prune_at: float | None = None, drop_if_binary: bool = False, balanced: bool = False, max_iter: int = MAX_PASSES) -> Model:
    """One model of ``fit_models`` on all rows of ``train``."""
    return fit_models(train, {0: (0, columns)}, None, None, c, label, prune_at, drop_if_binary, balanced, max_iter)[0]


def _sized(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, which are ``n``, in no more tasks than their number asks for."""
    return rows.coalesce(-(-n // ROWS_A_TASK))


def fit_logistics(train: DataFrame, groups: dict, c: float = 1.0, label: str = "target_label", max_iter: int = MAX_PASSES, progress=None) -> dict:
    """``fit_logistic`` for each of several lists of columns over the same rows, by the keys of ``groups``."""
    return fit_models(train, {key: (0, columns) for key, columns in groups.items()}, c=c, label=label, max_iter=max_iter, progress=progress)


def predict_many(rows: DataFrame, models: dict, name: str, carry: list[str]) -> DataFrame:
    """``(carry, name, p0, p1, p2)``: a row for each row and model, in one pass.

    The models, of ``fit_logistics``, share what their encoders learned, so each row
    is encoded once; a model is a short list of places and weights, carried
    as one literal.
    """
    whole: dict[str, Column] = {}
    table = []
    for key, model in models.items():
        for value, column in zip(model.encoder.names, model.encoder.values()):
            whole.setdefault(value, F.coalesce(column, F.lit(0.0)))
        places = {value: i for i, value in enumerate(whole)}
        weights, starts, known = model.by_class()
        table.append({name: key, "at": [places[v] for v in model.encoder.names], "w": weights, "b": starts, "known": known})
    kind = "int" if all(isinstance(key, int) for key in models) else "string"
    given = F.from_json(F.lit(json.dumps(table)), f"array<struct<`{name}`: {kind}, at: array<int>, w: array<array<double>>, b: array<double>, known: array<boolean>>>")
    each = rows.select(*carry, F.array(*whole.values()).alias("__x")).select(*carry, "__x", F.inline(given))
    own = each.withColumn("__x", F.transform("at", lambda i: F.get("__x", i)))
    return own.select(*carry, name, *[p.alias(n) for n, p in zip(PROBABILITIES, _chances(F.col("__x"), F.struct("w", "b", "known")), strict=True)])


def fit_forest(train: DataFrame, columns: list[str], label: str = "target_label", trees: int = 300, depth: int = 8, leaf: int = 5, seed: int = 42) -> Model:
    """A forest over balanced classes."""
    rows, classes, n, counts = _labelled(train, label)
    encoder = fit_encoder(train, columns, label=label)
    weight = F.lit(1.0)
    for k, x in enumerate(classes):
        weight = F.when(F.col("__label") == k, n / (len(classes) * counts[x])).otherwise(weight)
    rows = _sized(rows.select("__label", encoder.vector().alias("features"), weight.alias("__weight")), n)
    fitted = RandomForestClassifier(labelCol="__label", weightCol="__weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(rows)
    return Model(encoder, classes, fitted, list(columns))


def importances(spark: SparkSession, model: Model) -> DataFrame:
    """``(feature, importance)``, largest first; empty for models without importances."""
    rows = []
    if isinstance(model.fitted, RandomForestClassificationModel):
        rows = list(zip(model.encoder.names, map(float, model.fitted.featureImportances.toArray())))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# Team models: classes in the order of CLASS_ORDER.


def team_columns(feature_set: str | None = None) -> list[str]:
    return ["Venue", *FEATURE_SETS[feature_set or BEST_LOGISTIC["feature_set"]]]


def with_team_label(team: DataFrame) -> DataFrame:
    """Rows with a target, and its place in CLASS_ORDER as ``target_label``."""
    return team.where(F.col("Target").isin(CLASS_ORDER)).withColumn("target_label", F.array_position(F.array(*map(F.lit, CLASS_ORDER)), F.col("Target")).cast("int") - 1)


def split_by_season(team: DataFrame, test_season: str) -> tuple[DataFrame, DataFrame]:
    """All seasons before ``test_season``, and that season."""
    rows = with_team_label(team)
    train, test = rows.where(F.col("Season") < test_season), rows.where(F.col("Season") == test_season)
    found = rows.agg(F.count_if(F.col("Season") < test_season), F.count_if(F.col("Season") == test_season), F.count_distinct(F.when(F.col("Season") < test_season, F.col("Target")))).first()
    for bad, text in ((not found[0], f"No training data before season {test_season}"), (not found[1], f"No test data for season {test_season}"), (found[2] < 2, "Training data needs at least two outcomes")):
        if bad:
            raise ValueError(text)
    return train, test


def fit_team_logistics(rows: DataFrame, limits: dict, place: Column, feature_set: str | None = None, c: float | None = None) -> dict:
    """Team models of several folds, by the keys of ``limits``, fitted in the same passes: each on the labelled rows whose ``place`` is below its limit."""
    columns = team_columns(feature_set)
    if missing := [x for x in columns if x not in rows.columns]:
        raise ValueError(f"the team frame lacks {missing}")
    return fit_models(rows, {key: (f, columns) for f, key in enumerate(limits)}, list(limits.values()), place, c or BEST_LOGISTIC["C"], prune_at=PRUNE_AT, drop_if_binary=True)


def fit_team_logistic(train: DataFrame, feature_set: str | None = None, c: float | None = None, balanced: bool = False) -> Model:
    columns = team_columns(feature_set)
    if missing := [x for x in columns if x not in train.columns]:
        raise ValueError(f"the team frame lacks {missing}")
    rows = train if "target_label" in train.columns else with_team_label(train)
    return fit_logistic(rows, columns, c or BEST_LOGISTIC["C"], prune_at=PRUNE_AT, drop_if_binary=True, balanced=balanced)


def with_team_predictions(model: Model, rows: DataFrame) -> DataFrame:
    """ProbabilityLoss/Draw/Win, Predicted, ProbabilityPredicted and Correct."""
    p = [F.col(x) for x in PROBABILITIES]
    out = model.predict(rows).withColumns({"Predicted": F.get(F.array(*map(F.lit, CLASS_ORDER)), first_largest(p)), "ProbabilityPredicted": F.greatest(*p)})
    out = out.withColumns(dict(zip(["ProbabilityLoss", "ProbabilityDraw", "ProbabilityWin"], p)))
    return out.withColumn("Correct", F.coalesce(F.col("Target") == F.col("Predicted"), F.lit(False))).drop(*PROBABILITIES)


def explain(model: Model, rows: DataFrame, label: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """``(keys, outcome, feature, scaled_value, coefficient, contribution, intercept, logit)``: what adds up to an outcome's log odds.

    A row for each row and feature, largest contributions first; without
    ``label`` the outcome that each row's model calls likeliest.
    """
    keys = keys or []
    predicted = model.predict(rows).withColumn("__k", first_largest([F.col(p) for p in PROBABILITIES]) if label is None else F.lit(label))
    names = F.array(*map(F.lit, model.encoder.names))
    by_class = {k: model.coefficients(k) for k in model.classes}
    weights, intercept = F.array().cast("array<double>"), F.lit(0.0)
    for k, (w, b) in by_class.items():
        weights = F.when(F.col("__k") == k, F.array(*[F.lit(float(x)) for x in w])).otherwise(weights)
        intercept = F.when(F.col("__k") == k, F.lit(b)).otherwise(intercept)
    parts = predicted.select(*keys, "__k", intercept.alias("intercept"), F.arrays_zip(names.alias("feature"), F.array(*[F.coalesce(x, F.lit(0.0)) for x in model.encoder.values()]).alias("scaled_value"), weights.alias("coefficient")).alias("z"))
    logit = F.col("intercept") + F.aggregate(F.transform("z", lambda s: s["scaled_value"] * s["coefficient"]), F.lit(0.0), lambda a, x: a + x)
    rows = parts.withColumn("logit", logit).select(*keys, F.col("__k").alias("outcome"), "intercept", "logit", F.inline("z"))
    return rows.withColumn("contribution", F.col("scaled_value") * F.col("coefficient")).orderBy(*keys, F.desc(F.abs("contribution")), "feature")


def save_model(model: Model, path: str, config: dict) -> None:
    """The fitted model, and what else it needs as one line of JSON, in a folder all executors can reach."""
    linear = isinstance(model.fitted, Linear)
    if not linear:
        model.fitted.write().overwrite().save(f"{path}/fitted")
    line = json.dumps({"linear": asdict(model.fitted) if linear else None, "converged": model.converged, "encoder": asdict(model.encoder), "classes": model.classes, "columns": model.columns, "config": config, "kind": type(model.fitted).__name__})
    SparkSession.getActiveSession().createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str, config: dict | None = None) -> Model:
    """A saved model; ValueError if it was saved under another ``config`` or lacks a part."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if not {"encoder", "classes", "columns", "config", "kind"} <= set(meta):
        raise ValueError("the saved model lacks a part")
    if config is not None and meta["config"] != config:
        raise ValueError("the model was saved under another configuration")
    fitted = Linear(**meta["linear"]) if meta["kind"] == Linear.__name__ else RandomForestClassificationModel.load(f"{path}/fitted")
    return Model(Encoder(**meta["encoder"]), meta["classes"], fitted, meta["columns"], meta.get("converged", True))
