"""Column names of match tables, of the features made from them, and of the groups that models select."""

from __future__ import annotations

#: Columns every match table must have, and the counts it may have (absent ones become nulls).
REQUIRED = ["MatchDate", "League", "HomeTeam", "AwayTeam", "FullTimeHomeGoals", "FullTimeAwayGoals"]
TEAM_COUNTS = ["Shots", "ShotsOnTarget", "Corners", "Fouls", "YellowCards", "RedCards"]
COUNTS = [f"{half}{side}Goals" for half in ("FullTime", "HalfTime") for side in ("Home", "Away")] + [f"{side}{c}" for c in TEAM_COUNTS for side in ("Home", "Away")]
RESULTS = ["H", "D", "A"]
#: Opening and closing prices that bets are settled at.
BOOKMAKER_ODDS, CLOSING_ODDS, OPENING_ODDS = (["B365H", "B365D", "B365A"], ["PSCH", "PSCD", "PSCA"], ["PSH", "PSD", "PSA"])

SIDES = ("home", "away")
#: A team's metrics in one match.
METRICS = ["points", "form_score", "goal_diff", "goals_for", "goals_against", "shots", "sot", "corners", "yellow_cards", "red_cards", "shots_against", "sot_against", "corners_against"]


def _both(names: list[str]) -> list[str]:
    return [f"{side}_{name}" for name in names for side in SIDES]


#: Names of a team's features in match frames, before the side is put in front.
WINDOW_SUMS = {
    f"{name}_l{k}": (metric, k)
    for k in (5, 10)
    for name, metric in {"goals_for": "goals_for", "goals_against": "goals_against", "goal_diff": "goal_diff", "shots_for": "shots", "shots_against": "shots_against", "sot_for": "sot", "sot_against": "sot_against", "corners_for": "corners", "corners_against": "corners_against"}.items()
} | {f"points_last_{k}": ("points", k) for k in (5, 10)} | {f"{m}_last_5": (m, 5) for m in ("yellow_cards", "red_cards")} | {"recent_form_5": ("form_score", 5), "recent_form_8": ("form_score", 8), "recent_goal_diff_8": ("goal_diff", 8)}
WINDOW_MEANS = {"recent_form_5_avg": ("form_score", 5), "recent_form_8_avg": ("form_score", 8), "ppg_l5": ("points", 5), "ppg_l10": ("points", 10)}
RATES = {"win_rate_l5": 1, "draw_rate_l5": 0, "loss_rate_l5": -1}
MOMENTA = {"ppg_momentum_l3_l10": "points", "shot_momentum_l3_l10": "shots", "sot_momentum_l3_l10": "sot", "corner_momentum_l3_l10": "corners"}
VENUE_SUMS = {"goals_for_l5": "goals_for", "goals_against_l5": "goals_against", "shots_for_l5": "shots", "sot_for_l5": "sot", "corners_for_l5": "corners"}
VENUE_MEANS = {"ppg_l5": 5, "ppg_l10": 10}
EWM = {"goals_for": "goals_for", "goals_against": "goals_against", "shots_for": "shots", "shots_against": "shots_against", "sot_for": "sot", "sot_against": "sot_against"}
CONTEXT = [
    "history_matches", "history_matches_l10", "shot_observations_l10", "rest_days", "matches_last_14_days", "shot_share_l10", "sot_share_l10",
    "sot_diff_per_match_l10", "opponent_elo_mean_l5", "result_overperformance_l5", "goal_diff_std_l10", *[f"{m}_ewm" for m in EWM],
]
#: Second names that some features are also exported under.
ALIASES = {
    f"{side}_{alias}": f"{side}_{name}"
    for side in SIDES
    for alias, name in {"form_points_last_5": "points_last_5", "goals_last_5": "goals_for_l5", "goals_against_last_5": "goals_against_l5", "shots_last_5": "shots_for_l5", "shots_on_target_last_5": "sot_for_l5", "corners_last_5": "corners_for_l5", "recent_goal_diff_5": "goal_diff_l5"}.items()
}
CONTEXT_FEATURES = _both(CONTEXT) + ["home_adjusted_elo_diff", "rest_days_diff"]
GOAL_FEATURES = ["expected_home_goals", "expected_away_goals", "expected_total_goals", "expected_goal_diff", "poisson_prob_home", "poisson_prob_draw", "poisson_prob_away"]
SHOT_FEATURES = _both([f"{stat}_{kind}_rating" for stat in ("shot", "sot") for kind in ("attack", "defence")]) + [f"expected_{side}_{stat}" for stat in ("shots", "sot") for side in SIDES]
DELTAS = {"team_strength_delta": "points_last_5", "goal_delta_last_5": "goals_for_l5", "shot_delta_last_5": "shots_for_l5", "recent_form_delta_5": "recent_form_5", "recent_form_delta_8": "recent_form_8"}
_FORM = _both([*WINDOW_SUMS, *WINDOW_MEANS, *RATES, *MOMENTA, "shot_accuracy_l5", "sot_conversion_l5", "attack_strength_l10", "defensive_strength_l10"])
_VENUE = [f"{side}_{side}_{name}" for name in [*VENUE_MEANS, *VENUE_SUMS] for side in SIDES]
_SEASON = [*_both(["position"]), "position_diff", *_both(["points", "points_per_game"]), "points_per_game_diff", *_both(["elo"]), "elo_diff", *_both(["elo_expected"])]
#: All 181 exported features, aliases included.
FEATURES = list(ALIASES) + _FORM + _VENUE + _SEASON + CONTEXT_FEATURES + GOAL_FEATURES + SHOT_FEATURES + list(DELTAS)


def canonical(columns: list[str]) -> list[str]:
    """Columns with aliases resolved, each once, in order."""
    return list(dict.fromkeys(ALIASES.get(c, c) for c in columns))


_BASE = ["League", *_both(["recent_form_5", "recent_form_8", "recent_goal_diff_5", "recent_goal_diff_8", "elo"]), "elo_diff"]
_EXTENDED = [
    *_BASE, *_both(["recent_form_5_avg", "recent_form_8_avg", "form_points_last_5", "goals_last_5", "goals_against_last_5", "shots_last_5", "shots_on_target_last_5", "ppg_l5", "ppg_l10", "shot_accuracy_l5", "sot_conversion_l5", "position"]),
    "position_diff",
]
_NEW = CONTEXT_FEATURES + GOAL_FEATURES + SHOT_FEATURES
FEATURE_GROUPS = {
    name: canonical(columns)
    for name, columns in {
        "baseline_form": _BASE,
        "extended_stats": _EXTENDED,
        "all_features": ["League", *FEATURES],
        "baseline_context": _BASE + CONTEXT_FEATURES,
        "baseline_poisson": _BASE + GOAL_FEATURES,
        "baseline_shot_ratings": _BASE + SHOT_FEATURES,
        "corrected_legacy": ["League", *[c for c in FEATURES if c not in _NEW]],
    }.items()
}

#: Team frames: identifiers, and the metrics that are summed over a team's earlier matches. Results are fixed values.
TEAM_IDENTIFIERS = ["MatchId", "Season", "League", "Team", "MatchDate", "Opponent", "Venue", "IsHome", "Target"]
LOSS, DRAW, WIN = CLASS_ORDER = ["Förlust", "Oavgjort", "Vinst"]
HOME_VENUE, AWAY_VENUE = "Hemma", "Borta"
TEAM_METRICS = ["points", "goals_for", "goals_against", "goal_diff", "shots_for", "shots_against", "sot_for", "sot_against", "corners_for", "corners_against", "yellow_cards", "red_cards"]
SCOPES = ("total", "home", "away")
_FORM10 = [f"{m}_{s}_l5" for m in ("ppg", "goal_diff") for s in SCOPES] + [f"{m}_total_l5" for m in ("shots_for", "shots_against", "sot_for", "sot_against")]
FEATURE_SETS = {
    "form": _FORM10,
    "form_strength": [*_FORM10, "position_advantage", "elo_difference"],
    "form_strength_model": [*_FORM10, "position_advantage", "elo_difference", "team_elo_expected", "expected_goal_difference", "poisson_prob_win", "poisson_prob_loss"],
}
BEST_LOGISTIC = {"feature_set": "form_strength_model", "C": 0.03, "class_weight": None}
