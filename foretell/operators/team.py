"""The team frame: a row for each team and match, with its own and its opponent's strictly-prior features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.functions.scalars import match_id
from foretell.operators.windows import team_windows
from foretell.schema import AWAY_VENUE, DRAW, HOME_VENUE, LOSS, TEAM_IDENTIFIERS, TEAM_METRICS, WIN

_COLUMNS = {"shots": "Shots", "sot": "ShotsOnTarget", "corners": "Corners"}


def perspectives(matches: DataFrame) -> DataFrame:
    """Two rows a match with identifiers, target, and the raw metrics with "_" in front."""
    rows = matches.withColumn("MatchId", match_id())

    def side(own: str, other: str) -> DataFrame:
        home = own == "Home"
        win, loss = ("H", "A") if home else ("A", "H")
        result = F.col("FullTimeResult")
        by_result = lambda a, b, c: F.when(result == win, a).when(result == "D", b).when(result == loss, c)
        gf, ga = F.col(f"FullTime{own}Goals"), F.col(f"FullTime{other}Goals")
        metrics = {"points": by_result(3, 1, 0), "goals_for": gf, "goals_against": ga, "goal_diff": gf - ga}
        metrics |= {f"{n}_{w}": F.col(s + c) for n, c in _COLUMNS.items() for w, s in (("for", own), ("against", other))}
        metrics |= {"yellow_cards": F.col(f"{own}YellowCards"), "red_cards": F.col(f"{own}RedCards")}
        flags = {"win": win, "draw": "D", "loss": loss}
        return rows.select(
            "MatchId", "Season", "League", F.col(f"{own}Team").alias("Team"), "MatchDate", F.col(f"{other}Team").alias("Opponent"),
            F.lit(HOME_VENUE if home else AWAY_VENUE).alias("Venue"), F.lit(int(home)).alias("IsHome"), by_result(WIN, DRAW, LOSS).alias("Target"),
            *[metrics[m].cast("double").alias(f"_{m}") for m in TEAM_METRICS], *[F.coalesce((result == r).cast("int"), F.lit(0)).alias(f"_{f}") for f, r in flags.items()],
        )

    return side("Home", "Away").unionByName(side("Away", "Home"))


def joined_perspectives(engineered: DataFrame) -> DataFrame:
    """``(MatchId, Team)`` and the match features as that team sees them."""
    rows = engineered.withColumn("MatchId", match_id())

    def side(own: str, other: str) -> DataFrame:
        shared = {f"{who}_{new}": F.col(f"{s}_{old}") for who, s in (("team", own), ("opponent", other)) for new, old in (("position", "position"), ("season_points", "points"), ("season_ppg", "points_per_game"), ("elo", "elo"))}
        shared |= {"team_elo_expected": F.col(f"{own}_elo_expected"), "expected_team_goals": F.col(f"expected_{own}_goals"), "expected_opponent_goals": F.col(f"expected_{other}_goals")}
        shared |= {"poisson_prob_win": F.col(f"poisson_prob_{own}"), "poisson_prob_draw": F.col("poisson_prob_draw"), "poisson_prob_loss": F.col(f"poisson_prob_{other}")}
        return rows.select("MatchId", F.col(f"{own.capitalize()}Team").alias("Team"), *[c.alias(n) for n, c in shared.items()])

    return side("home", "away").unionByName(side("away", "home"))


def with_relative_strength(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "position_advantage": F.col("opponent_position") - F.col("team_position"),
        "elo_difference": F.col("team_elo") - F.col("opponent_elo"),
        "expected_goal_difference": F.col("expected_team_goals") - F.col("expected_opponent_goals"),
    })


def team_history(matches: DataFrame) -> DataFrame:
    """Identifiers and the 105 window columns."""
    rows = team_windows(perspectives(matches))
    return rows.select(*TEAM_IDENTIFIERS, *[c for c in rows.columns if c not in TEAM_IDENTIFIERS and not c.startswith("_")])


def team_frame(matches: DataFrame, engineered: DataFrame, season: str | None = None) -> DataFrame:
    """The whole team frame. ``season`` selects rows after the windows, so their history stays whole."""
    seen = joined_perspectives(engineered)
    rows = team_history(matches)
    if season is not None:
        rows = rows.where(F.col("Season") == season)
    return with_relative_strength(rows.join(seen, ["MatchId", "Team"], "left"))
