"""League tables as they stood before each date: a grid of dates and known clubs, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SEASON = ["League", "Season"]


def positions(long: DataFrame) -> DataFrame:
    """``(League, MatchDate, Team, position)`` for every row of ``long``, among the clubs known by then and both opponents.

    A club is known on a day if it completed a match of the season before it.
    Clubs rank by points, goal difference, goals, then name. A club that isn't
    known stands with nothing won. One grid of days and clubs is summed and
    ranked, with the unknown clubs that play that day in it, who count for
    nobody's rank but their own.
    """
    played = long.where("played = 1").select(*_SEASON, "day", "Team", F.col("points").alias("p"), F.col("goal_diff").alias("d"), F.col("goals_for").alias("g"))
    clubs = played.groupBy(*_SEASON, "Team").agg(F.min("day").alias("first_day"))
    rows = long.select(*_SEASON, "MatchDate", "day", "Team", "Opponent").join(clubs, [*_SEASON, "Team"], "left")
    rows = rows.join(clubs.select(*_SEASON, F.col("Team").alias("Opponent"), F.col("first_day").alias("other_day")), [*_SEASON, "Opponent"], "left")
    known, other = F.coalesce(F.col("first_day") < F.col("day"), F.lit(False)), F.coalesce(F.col("other_day") < F.col("day"), F.lit(False))
    rows = rows.select(*_SEASON, "MatchDate", "day", "Team", "Opponent", known.alias("known"), other.alias("other_known"))

    none = [F.lit(0.0).alias(c) for c in "pdg"]
    days = rows.select(*_SEASON, "day").distinct()
    grid = days.join(clubs, _SEASON).where("first_day < day").select(*_SEASON, "day", "Team", *none, F.lit(True).alias("asked"), F.lit(1).alias("counts"))
    new = rows.where("NOT known").select(*_SEASON, "day", "Team", *none, F.lit(True).alias("asked"), F.lit(0).alias("counts")).distinct()
    earlier = Window.partitionBy(*_SEASON, "Team").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    places = grid.unionByName(new).unionByName(played.withColumns({"asked": F.lit(False), "counts": F.lit(0)}))
    totals = places.withColumns({c: F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) for c in "pdg"}).where("asked")
    ahead = Window.partitionBy(*_SEASON, "day").orderBy(F.desc("p"), F.desc("d"), F.desc("g"), "Team").rowsBetween(Window.unboundedPreceding, -1)
    table = totals.select(*_SEASON, "day", "Team", "p", "d", "g", (1 + F.coalesce(F.sum("counts").over(ahead), F.lit(0))).alias("rank"))

    # An unknown opponent is in the table of this match too, with nothing won.
    nothing = F.expr("p < 0 OR (p = 0 AND (d < 0 OR (d = 0 AND (g < 0 OR (g = 0 AND Opponent < Team)))))")
    met = rows.join(table, [*_SEASON, "day", "Team"])
    return met.select("League", "MatchDate", "Team", (F.col("rank") + F.when(~F.col("other_known") & nothing, 1).otherwise(0)).cast("int").alias("position"))
