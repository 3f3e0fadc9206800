"""Training in one call: split, fit, score, and keep what came of it."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.operators.catalog import search
from foretell.operators.metrics import gini, probability_metrics
from foretell.operators.models import PROBABILITIES, Model, fit_forest, fit_logistic, fit_team_logistic, importances, load_model, save_model, split_by_season, time_split, with_team_predictions
from foretell.schema import BEST_LOGISTIC, CLASS_ORDER

TEAM_PROBABILITIES = ["ProbabilityLoss", "ProbabilityDraw", "ProbabilityWin"]


def class_shares(rows: DataFrame, target: str = "Target") -> list[float]:
    """Shares of the team outcomes in CLASS_ORDER; 0 for absent ones, nulls where there is no row."""
    return list(rows.agg(*[F.avg((F.col(target).eqNullSafe(k)).cast("double")) for k in CLASS_ORDER]).first())


def evaluate_predictions(predicted: DataFrame, priors: list[float] | None = None) -> DataFrame:
    """One row of ``with_team_predictions``' quality: rows, accuracy, log_loss, gini by outcome and macro, and what constant ``priors`` would reach.

    Without ``priors`` the outcomes' own shares serve. A Gini is null where its
    outcome is never or always there, and so is the macro Gini then.
    """
    shares = class_shares(predicted) if priors is None else list(map(float, priors))
    best = int(np.argmax([s or 0.0 for s in shares]))
    y = F.array_position(F.array(*map(F.lit, CLASS_ORDER)), F.col("Target")).cast("int") - 1
    rows = predicted.select(y.alias("y"), (F.col("Target") == F.col("Predicted")).alias("right"), *[F.col(c).cast("double").alias(p) for c, p in zip(TEAM_PROBABILITIES, PROBABILITIES)])
    flat = rows.select("y", *[F.lit(s).cast("double").alias(p) for s, p in zip(shares, PROBABILITIES)])
    own = probability_metrics(rows).select("rows", "log_loss")
    exact = rows.agg(F.avg(F.coalesce(F.col("right"), F.lit(False)).cast("double")).alias("accuracy"), F.avg((F.col("y") == best).cast("double")).alias("dummy_accuracy"))
    ranked = gini(rows).select(*[F.col(f"gini_{o}").alias(f"gini_{k}") for o, k in zip(("home", "draw", "away"), ("loss", "draw", "win"))], "gini_macro")
    dummy = probability_metrics(flat).select(F.col("log_loss").alias("dummy_log_loss"))
    out = own.crossJoin(F.broadcast(exact)).crossJoin(F.broadcast(ranked)).crossJoin(F.broadcast(dummy))  # one row each
    return out.withColumns({f"dummy_prior_{k}": F.lit(s).cast("double") for k, s in zip(("loss", "draw", "win"), shares)})


@dataclass
class Trained:
    """A team model with the rows it was trained and tested on."""

    model: Model
    team_data: DataFrame
    test: DataFrame
    metrics: DataFrame
    config: dict
    test_season: str
    train_start: str
    train_end: str
    train_rows: int


def train_all_history(team: DataFrame, test_season: str) -> Trained:
    """The chosen team model on all seasons before ``test_season``, scored on that season against the training seasons' shares."""
    train, test = split_by_season(team, test_season)
    model = fit_team_logistic(train)
    predicted = with_team_predictions(model, test)
    span = train.agg(F.min("Season"), F.max("Season"), F.count(F.lit(1))).first()
    return Trained(model, team, predicted, evaluate_predictions(predicted, class_shares(train)), dict(BEST_LOGISTIC), test_season, *span)


def save_trained(trained: Trained, path: str) -> None:
    """Model, team rows and a line of JSON in a folder that all executors can reach."""
    save_model(trained.model, f"{path}/model", trained.config)
    trained.team_data.write.mode("overwrite").parquet(f"{path}/team_data")
    trained.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    about = {k: getattr(trained, k) for k in ("config", "test_season", "train_start", "train_end", "train_rows")}
    trained.team_data.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_trained(spark: SparkSession, path: str) -> Trained:
    """A saved team model; ValueError if it was made under another configuration than BEST_LOGISTIC or lacks a part."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if not {"config", "test_season", "train_start", "train_end", "train_rows"} <= set(about):
        raise ValueError("the saved team model lacks a part")
    model = load_model(spark, f"{path}/model", dict(BEST_LOGISTIC))
    team = spark.read.parquet(f"{path}/team_data")
    _, test = split_by_season(team, about["test_season"])
    return Trained(model, team, with_team_predictions(model, test), spark.read.parquet(f"{path}/metrics"), **about)


def _scored(model: Model, parts: dict[str, DataFrame]) -> tuple[Model, DataFrame, dict[str, DataFrame]]:
    test = model.predict(parts["test"]).withColumn("y", F.col("target_label"))
    return model, probability_metrics(test), parts


def train_baseline(data: DataFrame, columns: list[str], train_end_year: int = 2022, validation_end_year: int = 2024) -> tuple[Model, DataFrame, dict[str, DataFrame]]:
    """(model, test metrics, parts): logistic regression on the training years of ``modeling_data``."""
    parts = dict(zip(("train", "validation", "test"), time_split(data, train_end_year, validation_end_year)))
    return _scored(fit_logistic(parts["train"], columns), parts)


def train_ml_model(data: DataFrame, columns: list[str], train_end_year: int = 2022, validation_end_year: int = 2024, **forest) -> tuple[Model, DataFrame, dict[str, DataFrame]]:
    """(model, test metrics, parts): the forest on the training years; its ``importances`` come from the model."""
    parts = dict(zip(("train", "validation", "test"), time_split(data, train_end_year, validation_end_year)))
    return _scored(fit_forest(parts["train"], columns, **forest), parts)


def feature_view(scores: DataFrame, screening: DataFrame, catalog: DataFrame, threshold: float = 0.02, chosen: list[str] | None = None, text: str = "") -> DataFrame:
    """Univariate scores with each feature's group, whether its Gini in the screening is too small, and whether a model has ``chosen`` it: a row a feature.

    With ``text`` only features that hold it in name, group or description.
    """
    found = scores if not text else scores.join(F.broadcast(search(catalog, text).select("feature")), "feature", "left_semi")
    named = found.withColumn("in_model", F.col("feature").isin(list(chosen or []))).join(F.broadcast(catalog.select("feature", "group")), "feature", "left")
    seen = named.join(F.broadcast(screening.select("feature", "screen_gini", "screen_status")), "feature", "left")
    return seen.withColumn("weak", ~F.coalesce((F.col("screen_gini") > threshold) & (F.col("screen_status") == "OK"), F.lit(False))).drop("screen_status")


def test_preview(engineered: DataFrame, start, end, feature: str, n: int = 100) -> DataFrame:
    """The last ``n`` labelled matches between two days with one feature, latest first."""
    columns = list(dict.fromkeys(["MatchDate", "League", "HomeTeam", "AwayTeam", feature, "target"]))
    rows = engineered.where(F.col("MatchDate").between(start, end) & F.col("target_label").isNotNull())
    return rows.select(columns).orderBy(F.desc("MatchDate"), "League", "HomeTeam", "AwayTeam").limit(n)


test_preview.__test__ = False

__all__ = ["Trained", "class_shares", "evaluate_predictions", "feature_view", "importances", "load_trained", "save_trained", "test_preview", "train_all_history", "train_baseline", "train_ml_model"]
