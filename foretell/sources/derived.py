"""A match table made from the star-schema test tables, so that every operator has data to run on.

League is the order priority, the teams are the nations of the customer and of
the supplier of the order's first line, counts and prices are small formulas
over the keys. A fixture stays if its order is the first for both its teams on
that league's date. Some fixtures are unplayed and some counts are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
#: Column -> SQL over orders and the order's first line, alike in Spark and in other engines.
FORMULAS = {
    "FullTimeHomeGoals": "CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(l_quantity AS INT) % 5 AS DOUBLE) END",
    "FullTimeAwayGoals": "CASE WHEN o_orderstatus <> 'P' THEN CAST(l_partkey % 4 AS DOUBLE) END",
    "HomeShots": "CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_quantity AS INT) % 20 + 3 AS DOUBLE) END",
    "AwayShots": "CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey % 18 + 2 AS DOUBLE) END",
    "HomeShotsOnTarget": "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(l_suppkey % 9 AS DOUBLE) END",
    "AwayShotsOnTarget": "CAST(l_partkey % 7 AS DOUBLE)",
    "HomeCorners": "CAST(o_orderkey % 12 AS DOUBLE)",
    "AwayCorners": "CAST(l_partkey % 9 AS DOUBLE)",
    "HomeYellowCards": "CAST(o_custkey % 5 AS DOUBLE)",
    "AwayYellowCards": "CAST(l_suppkey % 4 AS DOUBLE)",
    "HomeRedCards": "CAST(CASE WHEN o_custkey % 17 = 0 THEN 1 ELSE 0 END AS DOUBLE)",
    "AwayRedCards": "CAST(CASE WHEN l_suppkey % 19 = 0 THEN 1 ELSE 0 END AS DOUBLE)",
    "B365H": "CAST(1.3 AS DOUBLE) + CAST(o_orderkey % 40 AS DOUBLE) / 10",
    "B365D": "CAST(2.6 AS DOUBLE) + CAST(o_orderkey % 17 AS DOUBLE) / 10",
    "B365A": "CAST(1.6 AS DOUBLE) + CAST(l_partkey % 50 AS DOUBLE) / 10",
    "PSCH": "CASE WHEN o_orderkey % 13 <> 0 THEN CAST(1.3 AS DOUBLE) + CAST(o_orderkey % 37 AS DOUBLE) / 10 END",
    "PSCD": "CAST(2.7 AS DOUBLE) + CAST(l_suppkey % 16 AS DOUBLE) / 10",
    "PSCA": "CAST(1.5 AS DOUBLE) + CAST(l_partkey % 47 AS DOUBLE) / 10",
}
_SEASON = "CAST(year(MatchDate) - CASE WHEN month(MatchDate) < 7 THEN 1 ELSE 0 END AS {text})"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation = read("nation").select("n_nationkey", "n_name")
    # The first line by a total order: a grouped minimum, added up before the shuffle.
    first = lambda lines, columns: lines.groupBy("l_orderkey").agg(F.min(F.struct(*columns)).alias("line")).select("l_orderkey", "line.*")
    home = read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("HomeTeam"))
    away = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("AwayTeam"))
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("League"), F.to_date("o_orderdate").alias("MatchDate"))
    teams = lambda orders, lines: orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(home, F.col("o_custkey") == F.col("c_custkey")).join(away, F.col("l_suppkey") == F.col("s_suppkey")).where("HomeTeam != AwayTeam")
    # All orders carry their teams only. Those that become matches are few, as a team plays once a day and league: they are
    # sent to all tasks, and the other columns are read of them alone.
    fixtures = teams(orders.drop("o_orderstatus"), first(read("lineitem"), _FIRST[:3])).select("League", "MatchDate", F.explode(F.array("HomeTeam", "AwayTeam")).alias("Team"), "o_orderkey")
    firsts = F.broadcast(fixtures.groupBy("League", "MatchDate", "Team").agg(F.min("o_orderkey").alias("o_orderkey")).groupBy("o_orderkey").count().where("count = 2").select("o_orderkey"))
    lines = read("lineitem").join(firsts, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    rows = teams(orders.join(firsts, "o_orderkey", "left_semi"), first(lines, _FIRST))
    made = rows.select(F.col("o_orderkey").alias("MatchKey"), "League", "MatchDate", "HomeTeam", "AwayTeam", *[F.expr(sql).alias(c) for c, sql in FORMULAS.items()])
    result = F.when(F.col("FullTimeHomeGoals") > F.col("FullTimeAwayGoals"), "H").when(F.col("FullTimeHomeGoals") == F.col("FullTimeAwayGoals"), "D").when(F.col("FullTimeHomeGoals") < F.col("FullTimeAwayGoals"), "A")
    return made.withColumns({"FullTimeResult": result, "Season": F.expr(_SEASON.format(text="STRING"))})


#: The same table as common table expressions, to stand in front of an oracle query.
MATCHES_CTE = f"""
first_lines AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_FIRST)}) AS nth FROM lineitem) WHERE nth = 1),
fixtures AS (
  SELECT o.*, l.*, o_orderpriority AS League, CAST(o_orderdate AS DATE) AS MatchDate, hn.n_name AS HomeTeam, an.n_name AS AwayTeam
  FROM orders o JOIN first_lines l ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation hn ON c_nationkey = hn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation an ON s_nationkey = an.n_nationkey
  WHERE hn.n_name <> an.n_name),
appearances AS (
  SELECT League, MatchDate, HomeTeam AS Team, o_orderkey FROM fixtures UNION ALL SELECT League, MatchDate, AwayTeam, o_orderkey FROM fixtures),
firsts AS (
  SELECT k FROM (SELECT min(o_orderkey) AS k FROM appearances GROUP BY League, MatchDate, Team) GROUP BY k HAVING count(*) = 2),
counted AS (
  SELECT o_orderkey AS MatchKey, League, MatchDate, HomeTeam, AwayTeam, {", ".join(f"{sql} AS {c}" for c, sql in FORMULAS.items())}
  FROM fixtures WHERE o_orderkey IN (SELECT k FROM firsts)),
matches AS (
  SELECT *, CASE WHEN FullTimeHomeGoals > FullTimeAwayGoals THEN 'H' WHEN FullTimeHomeGoals = FullTimeAwayGoals THEN 'D'
    WHEN FullTimeHomeGoals < FullTimeAwayGoals THEN 'A' END AS FullTimeResult, {_SEASON.format(text="VARCHAR")} AS Season FROM counted)"""
