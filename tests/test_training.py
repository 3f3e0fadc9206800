"""Training in one call, persistence, stages and commands."""

import datetime as dt
import random

import numpy as np
import pytest
from foretell import cli
from foretell.functions.scalars import match_id
from foretell.operators import models, training
from foretell.operators.stages import FeatureEncoder, OutcomeLogistic
from foretell.schema import BEST_LOGISTIC, CLASS_ORDER, FEATURE_GROUPS
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def team(spark):
    rng = np.random.default_rng(0)
    names = [c for c in models.team_columns() if c != "Venue"]
    rows = []
    for season in ("2019/20", "2020/21", "2021/22"):
        for i in range(80):
            strength = rng.normal()
            target = CLASS_ORDER[int(np.clip(np.round(1 + strength + rng.normal(0, 0.7)), 0, 2))]
            values = [float(strength + rng.normal()) if rng.random() > 0.1 else None for _ in names]
            rows.append((f"{season}-{i}", season, "Hemma" if i % 2 else "Borta", i % 2, target, *values))
    return spark.createDataFrame(rows, "MatchId string, Season string, Venue string, IsHome int, Target string, " + ", ".join(f"{n} double" for n in names)).persist()


def test_evaluation_against_plain_numbers(spark, team):
    trained = training.train_all_history(team, "2021/22")
    got = trained.metrics.first()
    rows = trained.test.collect()
    p = np.array([[r.ProbabilityLoss, r.ProbabilityDraw, r.ProbabilityWin] for r in rows])
    y = np.array([CLASS_ORDER.index(r.Target) for r in rows])
    train = [r.Target for r in team.collect() if r.Season < "2021/22"]
    priors = np.array([train.count(k) / len(train) for k in CLASS_ORDER])
    assert (got.rows, got.accuracy) == (80, pytest.approx((p.argmax(axis=1) == y).mean()))
    assert got.log_loss == pytest.approx(-np.log(p[np.arange(80), y]).mean())
    assert got.dummy_log_loss == pytest.approx(-np.log(priors[y]).mean()) and got.dummy_accuracy == pytest.approx((y == priors.argmax()).mean())
    assert got.log_loss < got.dummy_log_loss and got.gini_macro > 0.2
    assert (trained.train_start, trained.train_end, trained.train_rows) == ("2019/20", "2020/21", 160)
    only = training.evaluate_predictions(trained.test.where(F.col("Target") != CLASS_ORDER[0])).first()
    assert only.gini_loss is None and only.gini_macro is None and only.dummy_prior_loss == 0


def test_later_seasons_change_no_coefficient(team):
    one = training.train_all_history(team, "2021/22").model
    wrong = team.withColumn("Target", F.when(F.col("Season") == "2021/22", F.lit(CLASS_ORDER[2])).otherwise(F.col("Target")))
    assert np.allclose(one.fitted.weights, training.train_all_history(wrong, "2021/22").model.fitted.weights, atol=1e-8)


def test_save_and_load(spark, team, tmp_path):
    trained = training.train_all_history(team, "2021/22")
    training.save_trained(trained, str(tmp_path / "m"))
    again = training.load_trained(spark, str(tmp_path / "m"))
    columns = ["MatchId", "Predicted", *training.TEAM_PROBABILITIES]
    assert sorted(map(tuple, again.test.select(columns).collect())) == sorted(map(tuple, trained.test.select(columns).collect()))
    assert again.team_data.count() == 240 and again.config == dict(BEST_LOGISTIC) and again.metrics.first() == trained.metrics.first()
    models.save_model(trained.model, str(tmp_path / "m" / "model"), {"feature_set": "form", "C": 1.0})
    with pytest.raises(ValueError, match="another configuration"):
        training.load_trained(spark, str(tmp_path / "m"))


def test_stages_in_a_pipeline_survive_saving(spark, team, tmp_path):
    rows = models.with_team_label(team)
    columns = models.team_columns()
    fitted = Pipeline(stages=[FeatureEncoder(inputCols=columns, pruneAt=0.9, dropIfBinary=True), OutcomeLogistic(inputCols=columns, pruneAt=0.9, dropIfBinary=True, c=0.03)]).fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    out = lambda m: sorted((r.MatchId, r.features, r.p0, r.p1, r.p2) for r in m.transform(rows).collect())
    assert out(again) == out(fitted)
    alone = models.fit_team_logistic(rows)
    assert np.allclose(alone.fitted.weights, again.stages[1].model.fitted.weights, atol=1e-9)
    assert again.stages[0].encoder.names == alone.encoder.names


def season_table(spark):
    rng, rows = random.Random(3), []
    for year in (2019, 2020, 2021):
        for week in range(30):
            clubs = list("ABCDEF")
            rng.shuffle(clubs)
            for h, a in zip(clubs[:3], clubs[3:]):
                goals = [float(rng.randint(0, 3)) for _ in range(2)]
                result = "H" if goals[0] > goals[1] else "A" if goals[0] < goals[1] else "D"
                rows.append((dt.date(year, 8, 1) + dt.timedelta(days=7 * week), "L", f"{year}/{(year + 1) % 100}", h, a, *goals, result, *[float(rng.randint(1, 9)) for _ in range(10)], *[1.5 + 4 * rng.random() for _ in range(6)]))
    stats = [f"{side}{c}" for c in ("Shots", "ShotsOnTarget", "Corners", "YellowCards", "RedCards") for side in ("Home", "Away")]
    return spark.createDataFrame(rows, "MatchDate date, League string, Season string, HomeTeam string, AwayTeam string, FullTimeHomeGoals double, FullTimeAwayGoals double, FullTimeResult string, " + ", ".join(f"{c} double" for c in [*stats, "B365H", "B365D", "B365A", "PSCH", "PSCD", "PSCA"]))


def test_commands(spark, tmp_path):
    raw = season_table(spark).withColumn("MatchId", match_id()).persist()
    noise = lambda n: F.rand(n) + F.when(F.col("FullTimeResult") == "H", 0.5).otherwise(0.0)
    label = F.when(F.col("FullTimeResult") == "H", 0).when(F.col("FullTimeResult") == "D", 1).otherwise(2)
    engineered = raw.select("MatchDate", "League", label.alias("target_label"), *[noise(i).alias(c) for i, c in enumerate(FEATURE_GROUPS["baseline_form"]) if c != "League"]).persist()
    tables = cli.evaluate_features(engineered, ["baseline_form"], 2, str(tmp_path / "f"))
    folds = tables["fold_metrics"].collect()
    assert {(r.feature_group, r.fold) for r in folds} == {("baseline_form", 1), ("baseline_form", 2)}
    assert all(r.train_end < r.eval_start <= r.eval_end < r.holdout_start and r.converged and r.features == 12 for r in folds)
    assert spark.read.csv(str(tmp_path / "f" / "summary"), header=True).count() == 1
    names = [c for c in models.team_columns() if c != "Venue"]
    sides = [raw.select("MatchId", "Season", F.lit(v).alias("Venue"), F.lit(h).alias("IsHome"), F.when(F.col("FullTimeResult") == "D", CLASS_ORDER[1]).when(F.col("FullTimeResult") == w, CLASS_ORDER[2]).otherwise(CLASS_ORDER[0]).alias("Target"), *[noise(i).alias(c) for i, c in enumerate(names)]) for v, h, w in (("Hemma", 1, "H"), ("Borta", 0, "A"))]
    team = sides[0].unionByName(sides[1]).persist()
    bets = cli.backtest(raw, team, "2020/21", str(tmp_path / "b"))
    assert {r.Season for r in bets["by_season"].collect()} <= {"2020/21", "2021/22"} and bets["summary"].count() > 0
    assert cli.train_team_model(team, "2021/22", str(tmp_path / "t")).metrics.first().rows == 180
    assert cli.league_history(raw, "L", "2020/21").count() == 180
    with pytest.raises(ValueError):
        cli.league_history(raw, "M", "2021/22")
    with pytest.raises(SystemExit):
        cli.main(["backtest"])


def test_baseline_and_forest(spark, team):
    data = models.with_team_label(team).withColumn("MatchDate", F.to_date(F.concat(F.substring("Season", 1, 4), F.lit("-09-01"))))
    columns = models.team_columns()[:4]
    model, metrics, parts = training.train_baseline(data, columns, 2019, 2020)
    assert model.converged and metrics.first().rows == 80 and parts["train"].count() == 80
    forest, scored, _ = training.train_ml_model(data, columns, 2019, 2020, trees=5, depth=3)
    assert scored.first().rows == 80 and training.importances(spark, forest).count() == len(forest.encoder.names)
    assert training.importances(spark, model).count() == 0


def test_view_and_preview(spark):
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3)], "feature string, log_loss_gain double")
    screening = spark.createDataFrame([("a", 0.5, 0.1, "OK"), ("b", 0.5, 0.1, "constant in train")], "feature string, screen_gini double, screen_log_loss_gain double, screen_status string")
    catalog = spark.createDataFrame([("a", "Form"), ("c", "Elo")], "feature string, group string")
    got = {r.feature: (r.group, r.screen_gini, r.weak) for r in training.feature_view(scores, screening, catalog).collect()}
    assert got == {"a": ("Form", 0.5, False), "b": (None, 0.5, True), "c": ("Elo", None, True)}
    rows = season_table(spark).withColumns({"target": F.col("FullTimeResult"), "target_label": F.lit(1)})
    shown = training.test_preview(rows, dt.date(2020, 8, 1), dt.date(2020, 12, 31), "HomeShots", 5).collect()
    assert len(shown) == 5 and shown[0].MatchDate == max(r.MatchDate for r in shown) and shown[0].MatchDate.year == 2020
