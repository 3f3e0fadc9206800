"""Commands for spark-submit: ``evaluate-features``, ``backtest`` and ``train-team-model``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.operators import betting, experiments, metrics
from foretell.operators.features import engineer_features
from foretell.operators.team import team_frame
from foretell.operators.training import Trained, save_trained, train_all_history
from foretell.schema import FEATURE_GROUPS
from foretell.sources.season_files import DIVISIONS, cache_root, http_fetch, load_csv, load_matches, write_report


def evaluate_features(engineered: DataFrame, groups: list[str], folds: int, output: str) -> dict[str, DataFrame]:
    """Fold metrics, calibration and their row-weighted summary by feature group, as CSV files under ``output``."""
    results, calibration = experiments.walk_forward(engineered, {name: FEATURE_GROUPS[name] for name in groups}, folds)
    results = results.persist()
    tables = {"fold_metrics": results, "calibration": calibration, "summary": metrics.weighted_summary(results, "feature_group", ["log_loss", "brier_score", "accuracy"])}
    for name, table in tables.items():
        write_report(table, f"{output}/{name}")
    return tables


def backtest(raw: DataFrame, team: DataFrame, first_test_season: str, output: str, threshold: float = 0.05) -> dict[str, DataFrame]:
    """Bets by threshold, bets by season and the random control of a walk forward over seasons, as CSV files under ``output``."""
    predictions = experiments.season_walk_forward(team, first_test_season)
    joined = betting.join_market(predictions, betting.build_market(raw)).persist()
    tables = {"summary": betting.summarize(joined), "by_season": betting.by_season(betting.simulate(joined, threshold)), "control": betting.random_bet_control(joined)}
    for name, table in tables.items():
        write_report(table, f"{output}/{name}")
    return tables


def league_history(raw: DataFrame, league: str, test_season: str) -> DataFrame:
    """One league's matches up to ``test_season``."""
    history = raw.where((F.col("League") == league) & (F.col("Season") <= test_season))
    if history.limit(1).count() == 0:
        raise ValueError(f"no matches of {league} up to {test_season}")
    return history


def train_team_model(team: DataFrame, test_season: str, output: str) -> Trained:
    """The team model of a league's team rows up to ``test_season``, saved under ``output``."""
    trained = train_all_history(team, test_season)
    save_trained(trained, output)
    return trained


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("evaluate-features")
    one.add_argument("--data", required=True)
    one.add_argument("--rows", type=int)
    one.add_argument("--folds", type=int, default=3)
    one.add_argument("--groups", nargs="+", choices=list(FEATURE_GROUPS), default=list(FEATURE_GROUPS))
    one.add_argument("--output", default="reports/feature_benchmark")
    two = commands.add_parser("backtest")
    two.add_argument("--base-url", required=True, help="where the season files lie")
    two.add_argument("--cache", default=str(cache_root()))
    two.add_argument("--first-test-season", default="2013/14")
    two.add_argument("--divisions", nargs="+", choices=list(DIVISIONS))
    two.add_argument("--output", default="reports/backtest")
    three = commands.add_parser("train-team-model")
    three.add_argument("--data", required=True)
    three.add_argument("--league", default="Premier League")
    three.add_argument("--test-season", required=True)
    three.add_argument("--output", default="data/team_model")
    return parser


def main(argv: list[str] | None = None) -> None:
    given = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if given.command == "evaluate-features":
        engineered = engineer_features(load_csv(spark, given.data, given.rows)).persist()
        evaluate_features(engineered, given.groups, given.folds, given.output)["summary"].show(truncate=False)
    elif given.command == "backtest":
        raw = load_matches(spark, given.cache, http_fetch(given.base_url), divisions=given.divisions).persist()
        for table in backtest(raw, team_frame(raw, engineer_features(raw)).persist(), given.first_test_season, given.output).values():
            table.show(50, truncate=False)
    else:
        history = league_history(load_csv(spark, given.data), given.league, given.test_season).persist()
        train_team_model(team_frame(history, engineer_features(history)).persist(), given.test_season, given.output).metrics.show(truncate=False)


if __name__ == "__main__":
    main()
