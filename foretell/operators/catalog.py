"""Definitions of every exported feature as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.schema import ALIASES, DELTAS, EWM, FEATURES, GOAL_FEATURES, MOMENTA, SIDES, VENUE_MEANS, VENUE_SUMS, WINDOW_MEANS, WINDOW_SUMS

PRIOR = "Only completed matches of the league on strictly earlier dates count."
STANDING = "As of the season's table before the match day; points start anew every season."
COUNTS = "Poisson model of league and statistic: 180-day half-life, three years of history, refitted after 28 days at the earliest, at least 20 matches."

_GROUPS = {
    "position": ("Standings", "rank by points, goal difference, goals, name", STANDING),
    "points": ("Standings", "points of the season so far", STANDING),
    "points_per_game": ("Standings", "points of the season / completed matches", STANDING),
    "elo": ("Elo", "R + 32 (S - E) after each match, from 1500", PRIOR),
    "elo_expected": ("Elo", "1 / (1 + 10^(-lead / 400)), 60 points for home", PRIOR),
    "shot_accuracy_l5": ("Efficiency", "shots on target / shots, last 5", PRIOR),
    "sot_conversion_l5": ("Efficiency", "goals / shots on target, last 5", PRIOR),
    "attack_strength_l10": ("Relative strength", "mean goals, last 10 / goals by team and match of the league's season", PRIOR),
    "defensive_strength_l10": ("Relative strength", "mean goals conceded, last 10 / goals by team and match of the league's season", PRIOR),
    "history_matches": ("Context", "completed matches so far", PRIOR),
    "history_matches_l10": ("Context", "min(10, completed matches)", PRIOR),
    "shot_observations_l10": ("Context", "matches of the last 10 with known shots", PRIOR),
    "rest_days": ("Context", "days since the last completed match", PRIOR),
    "matches_last_14_days": ("Context", "completed matches in the 14 days before", PRIOR),
    "shot_share_l10": ("Context", "own shots / all shots, last 10, where both are known", PRIOR),
    "sot_share_l10": ("Context", "own / all shots on target, last 10, where both are known", PRIOR),
    "sot_diff_per_match_l10": ("Context", "mean lead in shots on target, last 10, where both are known", PRIOR),
    "opponent_elo_mean_l5": ("Context", "mean Elo of the last 5 opponents before those matches", PRIOR),
    "result_overperformance_l5": ("Context", "mean of result - Elo expectation, last 5", PRIOR),
    "goal_diff_std_l10": ("Context", "sample deviation of goal difference, last 10", PRIOR),
}
_GROUPS |= {f"{r}_rate_l5": ("Form", f"{text} / matches, last 5", PRIOR) for r, text in (("win", "wins"), ("draw", "draws"), ("loss", "losses"))}


def _definition(name: str) -> tuple[str, str, str]:
    """Group, formula and note of a canonical feature."""
    for side in SIDES:
        inner = name.removeprefix(f"{side}_{side}_")
        if inner != name and inner in [*VENUE_SUMS, *VENUE_MEANS]:
            return "Venue form", f"{'mean points' if inner in VENUE_MEANS else f'sum of {VENUE_SUMS[inner]}'} over the last {inner.rpartition('l')[2]} {side} matches", PRIOR
    bare = next((name.removeprefix(f"{s}_") for s in SIDES if name.startswith(f"{s}_")), name)
    if name == "League":
        return "League", "the league's name, as indicators", ""
    if name in DELTAS:
        return "Difference", f"home_{DELTAS[name]} - away_{DELTAS[name]}", PRIOR
    if name == "home_adjusted_elo_diff":
        return "Difference", "home_elo + 60 - away_elo", PRIOR
    if name.endswith("_diff") and not name.startswith(SIDES) and not name.startswith("expected"):
        return "Difference", f"home_{name[:-5]} - away_{name[:-5]}", STANDING if "po" in name[:3] else PRIOR
    if name in GOAL_FEATURES:
        return "Goal model", "chance of the result for independent Poisson counts" if name.startswith("poisson") else "means of the goal model", COUNTS
    if name.endswith("_rating") or name.startswith("expected_"):
        return "Shot rating", "exp of the team's parameter" if name.endswith("_rating") else "mean of the model", COUNTS
    if bare in WINDOW_SUMS:
        metric, k = WINDOW_SUMS[bare]
        return ("Discipline" if "cards" in bare else "Form" if metric in ("points", "form_score") else "Match statistics"), f"sum of {metric} over the last {k}; missing if any of them is", PRIOR
    if bare in WINDOW_MEANS:
        return "Form", f"mean {WINDOW_MEANS[bare][0]} over the last {WINDOW_MEANS[bare][1]}", PRIOR
    if bare in MOMENTA:
        return "Momentum", f"mean {MOMENTA[bare]}, last 3 - last 10", PRIOR
    if bare.endswith("_ewm") and bare[:-4] in EWM:
        return "Decayed form", f"mean of {EWM[bare[:-4]]} weighted 2^(-days / 60), three years", PRIOR
    if bare in _GROUPS:
        return _GROUPS[bare]
    raise ValueError(f"Feature without definition: {name}")


def feature_catalog(spark: SparkSession) -> DataFrame:
    """``(feature, description, formula, group, notes, canonical)`` for League and all features; a feature without a definition is an error."""
    rows = []
    for name in sorted({"League", *FEATURES}):
        canonical = ALIASES.get(name, name)
        group, formula, note = _definition(canonical)
        description = canonical.replace("_", " ").replace(" l5", ", last 5").replace(" l10", ", last 10") + (f" (another name of {canonical})" if canonical != name else "")
        rows.append((name, description, formula, group, note, canonical))
    return spark.createDataFrame(rows, "feature string, description string, formula string, group string, notes string, canonical string")


def search(catalog: DataFrame, text: str) -> DataFrame:
    """Features whose name, group or description holds ``text``, whatever its case; it is no pattern."""
    wanted = F.lower(F.lit(text))
    return catalog.where(F.lower("feature").contains(wanted) | F.lower("group").contains(wanted) | F.lower("description").contains(wanted))
