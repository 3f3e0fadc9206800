"""The registered queries: each applies one operator to the derived match table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.functions.scalars import first_largest, match_id, season_code, season_label
from foretell.operators import betting, catalog, experiments, metrics, models, training
from foretell.operators.features import elo_form, engineer_features
from foretell.operators.prepare import long_form, prepare
from foretell.operators.ratings import count_ratings, elo
from foretell.operators.standings import positions
from foretell.operators.team import team_frame, team_history
from foretell.operators.windows import league_level, match_windows
from foretell.plans import oracles
from foretell.plans.keep import kept, shared_folder
from foretell.schema import CLASS_ORDER, CONTEXT, EWM, FEATURE_GROUPS, FEATURES, GOAL_FEATURES, MOMENTA, RATES, RESULTS, SCOPES, SHOT_FEATURES, TEAM_METRICS, VENUE_MEANS, VENUE_SUMS, WINDOW_MEANS, WINDOW_SUMS
from foretell.sources.derived import matches
from foretell.sources.ragged import read_ragged
from foretell.sources.season_files import ODDS_COLUMNS, RENAMED, RESULT_COLUMNS, typed_matches

Query = Callable[[SparkSession, str], DataFrame]
#: Features of the model queries.
MODEL_FEATURES = FEATURE_GROUPS["all_features"]
FIRST_SEASON = "1996"
_TEAM_KEYS = ["League", "MatchDate", "Team"]


def rounded(rows: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that engines that add up in another order agree."""
    return rows.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


def _windows(names: list[str]) -> Query:
    return lambda spark, sf: rounded(match_windows(long_form(prepare(matches(spark, sf), check=False))).select(*_TEAM_KEYS, *names))


def _team(names: list[str]) -> Query:
    return lambda spark, sf: rounded(team_history(matches(spark, sf)).select("MatchId", "Team", *names))


def _played(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions to measure: the bookmaker's probabilities of played matches."""
    rows = betting.bookmaker_probabilities(prepare(matches(spark, sf), check=False)).where("target IS NOT NULL")
    return rows.select("MatchKey", "League", "Season", "MatchDate", F.col("target_label").alias("y"), *[F.col(f"market_prob_{s}").alias(f"p{k}") for k, s in enumerate(("home", "draw", "away"))])


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions to bet on: one bookmaker's probabilities against another's prices."""
    rows = matches(spark, sf)
    model = betting.bookmaker_probabilities(rows).select(match_id().alias("MatchId"), "Season", *[F.col(f"market_prob_{s}").alias(r) for s, r in zip(("home", "draw", "away"), RESULTS)])
    return betting.join_market(model, betting.build_market(rows))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "matches", lambda: matches(spark, sf))


def _engineered(spark: SparkSession, sf: str) -> DataFrame:
    """Made once a session, as fits read it again and again; so is the match table behind it."""
    return kept(spark, sf, "features", lambda: engineer_features(_matches(spark, sf), check=False))


def _team_frame(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "team", lambda: team_frame(_matches(spark, sf), _engineered(spark, sf)))


def s8_matches(spark, sf):
    return rounded(matches(spark, sf))


def s6_ragged_files(spark, sf):
    """The match table written as season files, one a league and season, and read back.

    Files of different seasons have other columns, date forms and surplus
    fields, as files of different years do.
    """
    folder = f"{shared_folder(spark)}/season-files-{uuid.uuid4().hex}"
    rows = matches(spark, sf).withColumn("even", F.year("MatchDate") % 2 == 0).withColumn("file", F.concat_ws("_", F.translate("League", " ", "-"), F.year("MatchDate")))
    day = F.when(F.col("even"), F.date_format("MatchDate", "dd/MM/yy")).otherwise(F.date_format("MatchDate", "dd/MM/yyyy"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # Even years: an old name, no shots, and surplus fields in some rows.
    narrow = ["Div", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "BbAvH"]
    wide = [*narrow[:6], "HS", "AS", "B365H", "AvgH"]
    price = text("B365H")
    fields = [F.concat(F.lit('"'), F.col("League"), F.lit('"')), day, text("HomeTeam"), text("AwayTeam"), text("FullTimeHomeGoals"), text("FullTimeAwayGoals")]
    line = F.when(F.col("even"), F.concat_ws(",", *fields, price, F.when(F.col("MatchKey") % 3 == 0, F.lit("surplus,,more")))).otherwise(F.concat_ws(",", *fields, text("HomeShots"), text("AwayShots"), price, price))
    lines = rows.select("file", F.lit(1).alias("at"), line.alias("value"))
    heads = rows.select("file", "even").distinct().select("file", F.lit(0).alias("at"), F.when(F.col("even"), ",".join(narrow)).otherwise(",".join(wide)).alias("value"))
    ordered = lines.union(heads).repartition("file").sortWithinPartitions("file", "at")
    ordered.select("file", "value").write.partitionBy("file").text(folder)
    read = read_ragged(spark, [f"{folder}/file=*/*.txt"], [*RESULT_COLUMNS, *ODDS_COLUMNS, "Div"], renamed=RENAMED)
    found = typed_matches(read, ["Div"])
    return found.select("Div", "MatchDate", "HomeTeam", "AwayTeam", "FullTimeHomeGoals", "FullTimeAwayGoals", "HomeShots", "AwayShots", F.round("B365H", 6).alias("B365H"), F.round("AvgH", 6).alias("AvgH"))


def p1_prepared(spark, sf):
    return prepare(matches(spark, sf).drop("Season")).select("MatchKey", "League", "Season", "MatchDate", "HomeTeam", "AwayTeam", "target", "target_label")


def p5_modeling_rows(spark, sf):
    return models.modeling_data(prepare(matches(spark, sf), check=False), ["League"])[0].select("MatchKey", "target_label")


def p6_time_split(spark, sf):
    data = models.modeling_data(prepare(matches(spark, sf), check=False), ["League"])[0]
    rows = [part.agg(F.lit(name).alias("part"), F.count("*").alias("rows"), F.min("MatchDate").alias("first"), F.max("MatchDate").alias("last")) for name, part in zip(experiments.PARTITIONS, models.time_split(data, 1996, 1998))]
    return rows[0].union(rows[1]).union(rows[2])


def p6_date_split(spark, sf):
    """Years that leave no training row, so that 65 % and 85 % of the days cut the parts."""
    data = models.modeling_data(prepare(matches(spark, sf), check=False), ["League"])[0]
    parts = zip(experiments.PARTITIONS, models.time_split(data, 1900, 1901))
    rows = [part.agg(F.lit(name).alias("part"), F.count("*").alias("rows"), F.min("MatchDate").alias("first"), F.max("MatchDate").alias("last")) for name, part in parts]
    return rows[0].union(rows[1]).union(rows[2])


def p13_preview(spark, sf):
    """The last hundred labelled matches of 1997 with their home shots."""
    rows = prepare(matches(spark, sf), check=False)
    return training.test_preview(rows, "1997-01-01", "1997-12-31", "HomeShots")


def e1_folds(spark, sf):
    return experiments.fold_table(models.modeling_data(prepare(matches(spark, sf), check=False), ["League"])[0])


def p17_match_ids(spark, sf):
    return matches(spark, sf).select("MatchKey", match_id().alias("MatchId"), season_label(F.year("MatchDate")).alias("season_label"), season_code(F.year("MatchDate")).alias("season_code"))


def u1_long_form(spark, sf):
    return long_form(prepare(matches(spark, sf), check=False)).drop("match", "day")


def u3_repeated_appearances(spark, sf):
    rows = matches(spark, sf).select("MatchDate", F.explode(F.array("HomeTeam", "AwayTeam")).alias("Team"))
    return rows.groupBy("MatchDate", "Team").agg(F.count("*").alias("n")).where("n > 1")


def a12_league_level(spark, sf):
    return rounded(league_level(prepare(matches(spark, sf), check=False)))


def w8_strengths(spark, sf):
    prepared = prepare(matches(spark, sf), check=False)
    rows = match_windows(long_form(prepared)).join(league_level(prepared), ["League", "Season", "MatchDate"])
    level = F.when(F.col("league_level") > 0, F.col("league_level"))
    return rounded(rows.select(*_TEAM_KEYS, (F.col("goals_for_mean_l10") / level).alias("attack_strength_l10"), (F.col("goals_against_mean_l10") / level).alias("defensive_strength_l10")))


def w13_opponent_elo(spark, sf):
    prepared = prepare(matches(spark, sf), check=False)
    return rounded(elo_form(prepared, elo(prepared)).drop("elo"))


def w17_standings(spark, sf):
    return positions(long_form(prepare(matches(spark, sf), check=False)))


def w18_elo(spark, sf):
    return rounded(elo(prepare(matches(spark, sf), check=False)))


def c1_count_ratings(spark, sf):
    return rounded(count_ratings(prepare(matches(spark, sf), check=False)))


def features(spark, sf):
    return engineer_features(_matches(spark, sf), check=False)


def features_without_counts(spark, sf):
    """The engineered frame's features but for those of the count models, whose fits SQL can't express."""
    return rounded(_engineered(spark, sf).select("MatchKey", *[c for c in FEATURES if c not in GOAL_FEATURES + SHOT_FEATURES]))


def _some_features(names: list[str]) -> Query:
    return lambda spark, sf: rounded(_engineered(spark, sf).select("MatchKey", *names))


def t6_strengths(spark, sf):
    """The team frame's standing and Elo columns."""
    names = [f"{who}_{n}" for who in ("team", "opponent") for n in ("position", "season_points", "season_ppg", "elo")]
    return rounded(_team_frame(spark, sf).select("MatchId", "Team", *[F.col(c).cast("double") for c in [*names, "team_elo_expected", "position_advantage", "elo_difference"]]))


def j1_team_frame(spark, sf):
    return team_frame(_matches(spark, sf), _engineered(spark, sf))


def a4_priors(spark, sf):
    return rounded(metrics.class_priors(_played(spark, sf)))


def a5_calibration(spark, sf):
    return rounded(metrics.calibration(_played(spark, sf)))


def a6_metrics(spark, sf):
    return rounded(metrics.probability_metrics(_played(spark, sf), ["League"]))


def a7_gini(spark, sf):
    return rounded(metrics.gini(_played(spark, sf), ["League"]))


def a7_binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(_played(spark, sf), ["League"]))


def a8_roc(spark, sf):
    return rounded(metrics.roc_points(_played(spark, sf), ["League"]))


def a9_outcomes(spark, sf):
    return rounded(metrics.outcome_summary(_played(spark, sf), ["League"]))


def a13_missing_rates(spark, sf):
    rows = prepare(matches(spark, sf), check=False)
    return rounded(rows.groupBy("League").agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in ("FullTimeHomeGoals", "HomeShots", "HomeShotsOnTarget", "PSCH")]))


def p9_confidence(spark, sf):
    return rounded(metrics.confidence_coverage(_played(spark, sf), ["League"], 0.5))


def p9_outcomes(spark, sf):
    return rounded(metrics.confidence_outcomes(_played(spark, sf), ["League"], 0.5))


def p9_unfiltered(spark, sf):
    return rounded(metrics.confidence_coverage(_played(spark, sf), ["League"], 0.5, enabled=False))


def a3_market_summary(spark, sf):
    """The bookmaker's quality by league, from its seasons weighted by their matches."""
    return rounded(metrics.weighted_summary(metrics.probability_metrics(_played(spark, sf), ["League", "Season"]), "League", ["log_loss", "brier_score", "accuracy"]))


def m9_evaluation(spark, sf):
    """The bookmaker's probabilities as a team model's predictions, both sides of each match."""
    rows = _played(spark, sf)
    side = lambda loss, win, flip: rows.select(F.get(F.array(*map(F.lit, CLASS_ORDER)), (F.col("y") if flip else 2 - F.col("y"))).alias("Target"), F.col(loss).alias("ProbabilityLoss"), F.col("p1").alias("ProbabilityDraw"), F.col(win).alias("ProbabilityWin"))
    both = side("p2", "p0", False).union(side("p0", "p2", True))
    best = first_largest([F.col(c) for c in training.TEAM_PROBABILITIES])
    return rounded(training.evaluate_predictions(both.withColumn("Predicted", F.get(F.array(*map(F.lit, CLASS_ORDER)), best))))


def e9_market(spark, sf):
    return rounded(betting.build_market(matches(spark, sf)))


def e10_bets(spark, sf):
    return rounded(betting.simulate(_priced(spark, sf), 0.05))


def e12_edges(spark, sf):
    rows = betting.bookmaker_probabilities(matches(spark, sf)).withColumns({f"prob_{s}": F.lit(p) for s, p in (("home", 0.45), ("draw", 0.25), ("away", 0.3))})
    return rounded(betting.edges(rows).select("MatchKey", "edge_home", "edge_draw", "edge_away", "best_edge"))


def o4_best_edges(spark, sf):
    return e12_edges(spark, sf).where("best_edge >= 0.05").orderBy(F.desc("best_edge"), "MatchKey").limit(50)


def a10_roi(spark, sf):
    return rounded(betting.roi_summary(_priced(spark, sf)))


def a10_roi_intervals(spark, sf):
    """a10_roi with the bootstrap interval by threshold, which has no SQL twin."""
    return betting.summarize(_priced(spark, sf))


def a2_by_season(spark, sf):
    return rounded(betting.by_season(betting.simulate(_priced(spark, sf), 0.05)))


def a11_bootstrap(spark, sf):
    return betting.bootstrap_roi(betting.simulate(_priced(spark, sf), 0.05))


def e11_random_control(spark, sf):
    return betting.random_bet_control(_priced(spark, sf))


def a1_pooled(spark, sf):
    """Two opinions a match, the away one a little off, pooled."""
    rows = _priced(spark, sf).select("MatchId", "Season", "H", "D", "A")
    home = rows.select("MatchId", "Season", F.lit(1).alias("IsHome"), F.col("A").alias("ProbabilityLoss"), F.col("D").alias("ProbabilityDraw"), F.col("H").alias("ProbabilityWin"))
    away = rows.select("MatchId", "Season", F.lit(0).alias("IsHome"), (F.col("H") * 0.9).alias("ProbabilityLoss"), F.col("D").alias("ProbabilityDraw"), F.col("A").alias("ProbabilityWin"))
    return rounded(betting.pooled(home.union(away)))


def _model_frame(spark, sf) -> DataFrame:
    return models.modeling_data(_engineered(spark, sf), MODEL_FEATURES)[0]


def m3_logistic(spark, sf):
    train, _, test = models.time_split(_model_frame(spark, sf), 1996, 1997)
    return models.fit_logistic(train, MODEL_FEATURES).predict(test).select("MatchKey", "p0", "p1", "p2")


def m4_forest(spark, sf):
    train, _, test = models.time_split(_model_frame(spark, sf), 1996, 1997)
    return models.fit_forest(train, MODEL_FEATURES).predict(test).select("MatchKey", "p0", "p1", "p2")


def m11_baseline(spark, sf):
    return training.train_baseline(_model_frame(spark, sf), MODEL_FEATURES, 1996, 1997)[1]


def m12_all_history(spark, sf):
    return training.train_all_history(_team_frame(spark, sf), FIRST_SEASON).metrics


def m8_team_model(spark, sf):
    train, test = models.split_by_season(_team_frame(spark, sf), FIRST_SEASON)
    return models.with_team_predictions(models.fit_team_logistic(train), test).select("MatchId", "Team", "Target", "Predicted", "ProbabilityLoss", "ProbabilityDraw", "ProbabilityWin", "Correct")


def m10_explanation(spark, sf):
    train, test = models.split_by_season(_team_frame(spark, sf), FIRST_SEASON)
    return models.explain(models.fit_team_logistic(train), test, keys=["MatchId", "Team"])


def e1_walk_forward(spark, sf):
    return experiments.walk_forward(_engineered(spark, sf))[0]


def a3_weighted_summary(spark, sf):
    return metrics.weighted_summary(e1_walk_forward(spark, sf), "feature_group", ["log_loss", "brier_score", "accuracy"])


def e2_individual_features(spark, sf):
    return experiments.individual_features(_engineered(spark, sf), None, 1996, 1997)["scores"]


def e3_screening(spark, sf):
    return experiments.screen(_model_frame(spark, sf), MODEL_FEATURES)


def j3_feature_view(spark, sf):
    """Each feature's own scores beside its screening and its group."""
    scores, screening = e2_individual_features(spark, sf), e3_screening(spark, sf)
    return training.feature_view(scores, screening, catalog.feature_catalog(spark), chosen=FEATURE_GROUPS["baseline_form"])


def e6_subset_search(spark, sf):
    return experiments.rank_subsets(experiments.subset_search(_engineered(spark, sf), MODEL_FEATURES))


def e7_report_metrics(spark, sf):
    return experiments.logistic_report(_engineered(spark, sf), MODEL_FEATURES)["metrics"]


def e8_season_walk_forward(spark, sf):
    return experiments.season_walk_forward(_team_frame(spark, sf), "1997")


def e13_catalog(spark, sf):
    return catalog.feature_catalog(spark)


def p12_catalog_search(spark, sf):
    return catalog.search(catalog.feature_catalog(spark), "elo")


_here = dict(globals())
QUERIES: dict[str, Query] = {
    name: _here[name]
    for name in """s8_matches s6_ragged_files p1_prepared p5_modeling_rows p6_time_split p6_date_split p13_preview p17_match_ids u1_long_form u3_repeated_appearances a12_league_level w8_strengths
    w13_opponent_elo w17_standings w18_elo c1_count_ratings features features_without_counts t6_strengths j1_team_frame a1_pooled a2_by_season a3_weighted_summary a4_priors a5_calibration a6_metrics a7_gini
    a7_binary_metrics a8_roc a9_outcomes a10_roi a10_roi_intervals a11_bootstrap a13_missing_rates a3_market_summary p9_confidence p9_outcomes p9_unfiltered e1_folds e1_walk_forward e2_individual_features e3_screening j3_feature_view e6_subset_search
    e7_report_metrics e8_season_walk_forward e9_market e10_bets e11_random_control e12_edges e13_catalog m3_logistic m4_forest m9_evaluation m11_baseline m12_all_history m8_team_model m10_explanation
    o4_best_edges p12_catalog_search""".split()
}
# The engineered frame in three parts, each with a twin: together they are all features but those of the count models.
QUERIES |= {
    "features_form": _some_features(oracles.FORM_FEATURES),
    "features_calendar": _some_features(oracles.CALENDAR_FEATURES),
    "features_strength": _some_features(oracles.STRENGTH_FEATURES),
    "w1_window_sums": _windows(list(WINDOW_SUMS)),
    "w3_window_means": _windows([*WINDOW_MEANS, *RATES, *MOMENTA]),
    "w6_venue_windows": _windows([f"venue_{n}" for n in [*VENUE_SUMS, *VENUE_MEANS]]),
    "w7_efficiency": _windows(["shot_accuracy_l5", "sot_conversion_l5"]),
    "w9_context": _windows([c for c in CONTEXT if "elo" not in c and "overperformance" not in c and not c.endswith("_ewm")]),
    "w15_decayed_means": _windows([f"{m}_ewm" for m in EWM]),
    "w16_season_points": _windows(["season_points", "points_per_game"]),
    "t1_team_history": _team([f"history_matches_{s}" for s in SCOPES] + [f"matches_{s}_l{k}" for s in SCOPES for k in (5, 10)]),
    "t3_team_sums": _team([f"{m}_{s}_l{k}" for s in SCOPES for k in (5, 10) for m in TEAM_METRICS]),
    "t4_team_rates": _team([f"{m}_{s}_l{k}" for s in SCOPES for k in (5, 10) for m in ("ppg", "win_rate", "draw_rate", "loss_rate")]),
}
