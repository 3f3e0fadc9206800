"""Strictly earlier window features of teams, as window frames that end before the current row.

Two policies that must not be mixed: match features count completed matches of
a team in its league and need complete windows for totals; team frames count
every earlier row of a team, whatever its league, and skip missing values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from foretell.functions.scalars import safe_ratio
from foretell.schema import EWM, MOMENTA, RATES, SCOPES, TEAM_METRICS, VENUE_MEANS, VENUE_SUMS, WINDOW_MEANS, WINDOW_SUMS

HALF_LIFE_DAYS, HISTORY_DAYS = 60, 1095
#: Day 0 of the decay weights; the weight of a day cancels out of the mean, so any near day does.
_EPOCH = 14_610


def _last(keys: list[str], k: int, order: str = "seq") -> WindowSpec:
    """The last k completed matches: completed ones are numbered, so unplayed fixtures in between take no place."""
    return Window.partitionBy(*keys).orderBy(order).rangeBetween(-k, -1)


def _whole_sum(metric: str, frame: WindowSpec) -> Column:
    n = F.count(metric).over(frame)
    return F.when((n > 0) & (n == F.count("played").over(frame)), F.sum(metric).over(frame))


def match_windows(long: DataFrame) -> DataFrame:
    """``long`` with every window feature of the row's team before its date, under the names of ``schema`` (no side in front)."""
    team, venue, season = ["League", "Team"], ["League", "Team", "IsHome"], ["League", "Season", "Team"]
    before = lambda keys, days: Window.partitionBy(*keys).orderBy("day").rangeBetween(days, -1)
    ever = before(team, Window.unboundedPreceding)
    rows = long.withColumns({
        "seq": F.count("played").over(ever),
        "rest_days": F.col("day") - F.max(F.when(F.col("played") == 1, F.col("day"))).over(ever),
        "matches_last_14_days": F.count("played").over(before(team, -14)),
        "__weight": F.pow(F.lit(2.0), (F.col("day") - _EPOCH) / HALF_LIFE_DAYS),
        "__shot_pair": F.when(F.col("shots_against").isNotNull(), F.col("shots")), "__shot_both": F.col("shots") + F.col("shots_against"),
        "__sot_pair": F.when(F.col("sot_against").isNotNull(), F.col("sot")), "__sot_both": F.col("sot") + F.col("sot_against"),
        "__sot_lead": F.col("sot") - F.col("sot_against"),
    })
    # Running sums as of yesterday less those as of HISTORY_DAYS ago: both frames only grow, so a team's rows are added up once.
    # What is taken away weighs less than 2^-18 of what stays of the same size, so no digits are lost.
    older = before(team, Window.unboundedPreceding).rangeBetween(Window.unboundedPreceding, -HISTORY_DAYS - 1)
    recent = lambda x: F.coalesce(F.sum(x).over(ever), F.lit(0.0)) - F.coalesce(F.sum(x).over(older), F.lit(0.0))
    seen = lambda m: F.count(m).over(ever) > F.count(m).over(older)
    rows = rows.withColumns({f"{name}_ewm": F.when(seen(m), recent(F.col(m) * F.col("__weight")) / recent(F.when(F.col(m).isNotNull(), F.col("__weight")))) for name, m in EWM.items()})
    f = {k: _last(team, k) for k in (3, 5, 8, 10)}
    mean = lambda m, k: F.avg(m).over(f[k])
    rows = rows.withColumns(
        {name: _whole_sum(m, f[k]) for name, (m, k) in WINDOW_SUMS.items()}
        | {name: mean(m, k) for name, (m, k) in WINDOW_MEANS.items()}
        | {name: F.avg((F.col("form_score") == score).cast("double")).over(f[5]) for name, score in RATES.items()}
        | {name: mean(m, 3) - mean(m, 10) for name, m in MOMENTA.items()}
        | {
            "history_matches": F.col("seq"),
            "history_matches_l10": F.least(F.col("seq"), F.lit(10)),
            "shot_observations_l10": F.count("shots").over(f[10]),
            "goals_for_mean_l10": mean("goals_for", 10),
            "goals_against_mean_l10": mean("goals_against", 10),
            "goal_diff_std_l10": F.when(F.count("goal_diff").over(f[10]) >= 2, F.stddev_samp("goal_diff").over(f[10])),
            "shot_share_l10": safe_ratio(F.sum("__shot_pair").over(f[10]), F.sum("__shot_both").over(f[10])),
            "sot_share_l10": safe_ratio(F.sum("__sot_pair").over(f[10]), F.sum("__sot_both").over(f[10])),
            "sot_diff_per_match_l10": mean("__sot_lead", 10),
        }
    )
    rows = rows.withColumns({"shot_accuracy_l5": safe_ratio(F.col("sot_for_l5"), F.col("shots_for_l5")), "sot_conversion_l5": safe_ratio(F.col("goals_for_l5"), F.col("sot_for_l5"))})
    # At the venue: home matches for home rows, away matches for away rows.
    rows = rows.withColumn("__venue_seq", F.count("played").over(before(venue, Window.unboundedPreceding)))
    rows = rows.withColumns({f"venue_{name}": _whole_sum(m, _last(venue, 5, "__venue_seq")) for name, m in VENUE_SUMS.items()} | {f"venue_{name}": F.avg("points").over(_last(venue, k, "__venue_seq")) for name, k in VENUE_MEANS.items()})
    this_season = before(season, Window.unboundedPreceding)
    rows = rows.withColumns({"season_points": F.coalesce(F.sum("points").over(this_season), F.lit(0.0)), "points_per_game": F.avg("points").over(this_season)})
    return rows.drop("__weight", "__shot_pair", "__shot_both", "__sot_pair", "__sot_both", "__sot_lead", "__venue_seq")


def league_level(prepared: DataFrame) -> DataFrame:
    """``(League, Season, MatchDate, league_level)``: goals by team and match of the season before each date."""
    daily = prepared.groupBy("League", "Season", "MatchDate").agg(F.sum(F.when(F.col("target").isNotNull(), F.col("FullTimeHomeGoals") + F.col("FullTimeAwayGoals"))).alias("goals"), F.count("target").alias("n"))
    earlier = Window.partitionBy("League", "Season").orderBy("MatchDate").rowsBetween(Window.unboundedPreceding, -1)
    return daily.select("League", "Season", "MatchDate", safe_ratio(F.sum("goals").over(earlier), 2 * F.sum("n").over(earlier)).alias("league_level"))


def team_windows(rows: DataFrame) -> DataFrame:
    """Window features of team frames for ``rows (Team, MatchDate, MatchId, IsHome, _metric..., _win, _draw, _loss)``.

    Every earlier row of the team counts, by date and match id, unplayed ones
    included; sums skip missing values and are null where none is observed.
    """
    flags = {"total": F.lit(1), "home": F.col("IsHome"), "away": 1 - F.col("IsHome")}
    earlier = Window.partitionBy("Team").orderBy("MatchDate", "MatchId").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"history_matches_{s}": F.coalesce(F.sum(flags[s]).over(earlier), F.lit(0)) for s in SCOPES})
    new, ratios = {}, {}
    for s in SCOPES:
        inside = F.lit(True) if s == "total" else F.col("IsHome") == (1 if s == "home" else 0)
        for k in (5, 10):
            frame = Window.partitionBy("Team").orderBy(f"history_matches_{s}").rangeBetween(-k, -1)
            total = lambda m: F.sum(F.when(inside, F.col(f"_{m}"))).over(frame)  # noqa: B023, E731
            new |= {f"{m}_{s}_l{k}": total(m) for m in TEAM_METRICS}
            new[f"matches_{s}_l{k}"] = F.least(F.col(f"history_matches_{s}"), F.lit(k))
            new |= {f"{o}_rate_{s}_l{k}": total(o) for o in ("win", "draw", "loss")}
            n = F.col(f"matches_{s}_l{k}")
            ratios[f"ppg_{s}_l{k}"] = safe_ratio(F.col(f"points_{s}_l{k}"), n)
            ratios |= {f"{o}_rate_{s}_l{k}": safe_ratio(F.col(f"{o}_rate_{s}_l{k}"), n) for o in ("win", "draw", "loss")}
    return rows.withColumns(new).withColumns(ratios)
