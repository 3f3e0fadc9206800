"""The engineered match frame: all strictly-prior features of both sides in one row a match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretell.functions.scalars import elo_expectation, safe_ratio
from foretell.operators.prepare import long_form, prepare
from foretell.operators.ratings import HOME_ADVANTAGE, count_ratings, elo
from foretell.operators.standings import positions
from foretell.operators.windows import league_level, match_windows
from foretell.schema import ALIASES, CONTEXT, DELTAS, FEATURES, MOMENTA, RATES, SIDES, VENUE_MEANS, VENUE_SUMS, WINDOW_MEANS, WINDOW_SUMS

_KEYS = ["League", "MatchDate", "HomeTeam", "AwayTeam"]


def elo_form(prepared: DataFrame, ratings: DataFrame, home_advantage: float = HOME_ADVANTAGE) -> DataFrame:
    """``(League, MatchDate, Team, elo, opponent_elo_mean_l5, result_overperformance_l5)`` for both rows of each match."""
    score = F.when(F.col("target") == "H", 1.0).when(F.col("target") == "D", 0.5).when(F.col("target") == "A", 0.0)
    rated = prepared.select(*_KEYS, score.alias("score")).join(ratings, _KEYS)
    expected = elo_expectation(F.col("home_elo") + home_advantage - F.col("away_elo"))
    played = F.col("score").isNotNull()
    sides = F.array(
        F.struct(F.col("HomeTeam").alias("Team"), F.col("home_elo").alias("elo"), F.when(played, F.col("away_elo")).alias("other"), (F.col("score") - expected).alias("over")),
        F.struct(F.col("AwayTeam").alias("Team"), F.col("away_elo").alias("elo"), F.when(played, F.col("home_elo")).alias("other"), ((1 - F.col("score")) - (1 - expected)).alias("over")),
    )
    rows = rated.select("League", "MatchDate", F.inline(sides))
    before = Window.partitionBy("League", "Team").orderBy(F.unix_date("MatchDate"))
    rows = rows.withColumn("seq", F.count("other").over(before.rangeBetween(Window.unboundedPreceding, -1)))
    last = Window.partitionBy("League", "Team").orderBy("seq").rangeBetween(-5, -1)
    return rows.select("League", "MatchDate", "Team", "elo", F.avg("other").over(last).alias("opponent_elo_mean_l5"), F.avg("over").over(last).alias("result_overperformance_l5"))


def engineer_features(matches: DataFrame, season_start_month: int = 7, elo_home_advantage: float = HOME_ADVANTAGE, check: bool = True) -> DataFrame:
    """The regular match table and all 181 features, each from completed matches on strictly earlier dates.

    Form and Elo carry over seasons within a league; standings start anew.
    Unplayed fixtures get features and count as no history. Columns of
    ``matches`` with a feature's name are replaced; others pass through.
    """
    matches = matches.drop(*[c for c in FEATURES if c in matches.columns])
    prepared = prepare(matches, season_start_month, check)
    own = prepared.columns
    ratings = elo(prepared, elo_home_advantage)
    rows = match_windows(long_form(prepared, carry=own))
    rows = rows.join(positions(long_form(prepared)), ["League", "MatchDate", "Team"]).join(elo_form(prepared, ratings, elo_home_advantage), ["League", "MatchDate", "Team"])
    rows = rows.join(league_level(prepared), ["League", "Season", "MatchDate"])
    rows = rows.withColumns({"attack_strength_l10": safe_ratio(F.col("goals_for_mean_l10"), F.col("league_level")), "defensive_strength_l10": safe_ratio(F.col("goals_against_mean_l10"), F.col("league_level"))})

    plain = [*WINDOW_SUMS, *WINDOW_MEANS, *RATES, *MOMENTA, *CONTEXT, "shot_accuracy_l5", "sot_conversion_l5", "attack_strength_l10", "defensive_strength_l10", "position", "elo", "points_per_game"]
    pack = F.struct(*plain, F.col("season_points").alias("points"), *[F.col(f"venue_{n}") for n in [*VENUE_SUMS, *VENUE_MEANS]])
    home, away = F.when(F.col("IsHome"), F.col("Team")).otherwise(F.col("Opponent")), F.when(F.col("IsHome"), F.col("Opponent")).otherwise(F.col("Team"))
    paired = rows.groupBy("League", "MatchDate", home.alias("HomeTeam"), away.alias("AwayTeam")).agg(
        F.first("match", ignorenulls=True).alias("match"),
        F.first(F.when(F.col("IsHome"), pack), ignorenulls=True).alias("home"),
        F.first(F.when(~F.col("IsHome"), pack), ignorenulls=True).alias("away"),
    )
    counts = count_ratings(prepared)
    fields = [c for c in counts.columns if c not in [*_KEYS, "stat"]]
    models = counts.groupBy(*_KEYS).agg(*[F.first(F.when(F.col("stat") == s, F.struct(*fields)), ignorenulls=True).alias(s) for s in ("goals", "shots", "sot")])

    made = {f"{side}_{n}": F.col(f"{side}.{n}") for side in SIDES for n in [*plain, "points"]}
    made |= {f"{side}_{side}_{n}": F.col(f"{side}.venue_{n}") for side in SIDES for n in [*VENUE_SUMS, *VENUE_MEANS]}
    lead = F.col("home.elo") + elo_home_advantage - F.col("away.elo")
    made |= {f"{c}_diff": F.col(f"home.{c}") - F.col(f"away.{c}") for c in ("position", "points_per_game", "elo", "rest_days")}
    made |= {"home_adjusted_elo_diff": lead, "home_elo_expected": elo_expectation(lead), "away_elo_expected": 1 - elo_expectation(lead)}
    made |= {f"expected_{side}_{s}": F.col(f"{s}.expected_{side}") for s in ("goals", "shots", "sot") for side in SIDES}
    made |= {"expected_total_goals": F.col("goals.expected_home") + F.col("goals.expected_away"), "expected_goal_diff": F.col("goals.expected_home") - F.col("goals.expected_away")}
    made |= {f"poisson_prob_{o}": F.col(f"goals.p_{o}") for o in ("home", "draw", "away")}
    made |= {f"{side}_{name}_{kind}_rating": F.exp(F.col(f"{s}.{side}_{kind}")) for side in SIDES for s, name in (("shots", "shot"), ("sot", "sot")) for kind in ("attack", "defence")}
    made |= {name: F.col(f"home.{m}") - F.col(f"away.{m}") for name, m in DELTAS.items()}
    made |= {alias: made[name] for alias, name in ALIASES.items()}
    return paired.join(models, _KEYS).select(*[F.col(f"match.`{c}`").alias(c) for c in own], *[made[c].cast("double").alias(c) for c in FEATURES])
