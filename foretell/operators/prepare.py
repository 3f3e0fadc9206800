"""Match tables made regular: typed, validated, with results; and their two rows a match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.functions.scalars import clean_count, result_of, season_start
from foretell.schema import COUNTS, REQUIRED, RESULTS, TEAM_COUNTS


def regular(matches: DataFrame, season_start_month: int = 7) -> DataFrame:
    """Typed columns, counts cleaned, ``Season``, ``target`` and ``target_label`` derived; no action runs."""
    if not 1 <= season_start_month <= 12:
        raise ValueError(f"a season can't start in month {season_start_month}")
    if missing := sorted(set(REQUIRED) - set(matches.columns)):
        raise ValueError(f"the match table lacks the columns {missing}")
    date = F.to_date(F.col("MatchDate").try_cast("timestamp"))
    own = {"MatchDate": date, "FullTimeResult": F.col("FullTimeResult").cast("string") if "FullTimeResult" in matches.columns else F.lit(None).cast("string")}
    own |= {c: clean_count(F.col(c)) if c in matches.columns else F.lit(None).cast("double") for c in COUNTS}
    own |= {"Season": F.col("Season").cast("string") if "Season" in matches.columns else season_start(date, season_start_month)}
    out = matches.withColumns(own)
    target = result_of(F.col("FullTimeHomeGoals"), F.col("FullTimeAwayGoals"))
    return out.withColumns({"target": target, "target_label": F.array_position(F.array(*map(F.lit, RESULTS)), target).cast("int") - 1})


def validate(prepared: DataFrame) -> None:
    """Raise ValueError for rows that can't be ordered or would be counted twice; one pass for the rows, one for the pairs."""
    found = prepared.agg(
        F.count_if(F.expr("MatchDate IS NULL OR League IS NULL OR HomeTeam IS NULL OR AwayTeam IS NULL")).alias("unnamed"),
        F.count_if(F.expr("HomeTeam = AwayTeam")).alias("alone"),
        F.count_if(F.expr("Season IS NULL")).alias("unseasoned"),
        F.count_if(F.expr("target IS NOT NULL AND FullTimeResult IS NOT NULL AND FullTimeResult != target")).alias("disagreeing"),
    ).first()
    for name, text in {"unnamed": "some rows lack a date, a league or a team", "alone": "in some rows a team meets itself", "unseasoned": "the Season column has gaps", "disagreeing": "some results contradict their goals"}.items():
        if found[name]:
            raise ValueError(text)
    twice = prepared.select("League", "MatchDate", F.explode(F.array("HomeTeam", "AwayTeam")).alias("Team")).groupBy("League", "MatchDate", "Team").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("a team appears twice or more on a day")


def prepare(matches: DataFrame, season_start_month: int = 7, check: bool = True) -> DataFrame:
    prepared = regular(matches, season_start_month)
    if check:
        validate(prepared)
    return prepared


def long_form(prepared: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Two rows a match, home and away, keyed by League, MatchDate and Team.

    Metrics are null in unplayed matches, which so count in no window. The
    home row carries the columns of ``carry`` in a struct.
    """

    def side(own: str, other: str) -> DataFrame:
        played = F.col("target").isNotNull()
        gf, ga = F.col(f"FullTime{own}Goals"), F.col(f"FullTime{other}Goals")
        metrics = {"goals_for": gf, "goals_against": ga, "goal_diff": gf - ga, "form_score": F.signum(gf - ga), "points": F.when(gf > ga, 3.0).when(gf == ga, 1.0).otherwise(0.0)}
        names = dict(zip(TEAM_COUNTS, ["shots", "sot", "corners", "fouls", "yellow_cards", "red_cards"]))
        metrics |= {name: F.col(own + c) for c, name in names.items()}
        metrics |= {f"{names[c]}_against": F.col(other + c) for c in TEAM_COUNTS[:3]}
        carried = F.struct(*carry) if carry and own == "Home" else F.lit(None)
        kind = f"struct<{', '.join(f'`{n}`: {k}' for n, k in prepared.select(*carry).dtypes)}>" if carry else "int"
        return prepared.select(
            "League", "Season", "MatchDate", F.unix_date("MatchDate").alias("day"), F.col(f"{own}Team").alias("Team"), F.col(f"{other}Team").alias("Opponent"),
            F.lit(own == "Home").alias("IsHome"), F.when(played, 1).alias("played"), *[F.when(played, x).alias(n) for n, x in metrics.items()], carried.cast(kind).alias("match"),
        )

    return side("Home", "Away").unionByName(side("Away", "Home"))
