"""Ratings of teams: Elo and regularised Poisson attack and defence. Everything on a date is predicted before any of its results.

Elo is sequential: a league's matches are read in date order as a sorted
stream that holds the ratings only, never the league's rows. The Poisson
models are refitted on days that are known beforehand, each from a window of
results of its own, so all refits of all leagues run side by side.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretell.functions.scalars import elo_expectation
from foretell.operators.asof import asof_join

START_ELO, ELO_STEP, HOME_ADVANTAGE = 1500.0, 32.0, 60.0
#: Statistic -> its columns and the prior mean of an away side.
COUNT_MODELS = {"goals": ("FullTimeHomeGoals", "FullTimeAwayGoals", 1.2), "shots": ("HomeShots", "AwayShots", 10.0), "sot": ("HomeShotsOnTarget", "AwayShotsOnTarget", 3.5)}
HOME_RATIO, HALF_LIFE, REFIT_DAYS, MEMORY_DAYS, LEAST_MATCHES = 1.25, 180.0, 28, 1095, 20
TEAM_PRECISION, GLOBAL_PRECISION = 5.0, 1.0
BOUNDS = (4.0, 1.0, 2.0)
_KEYS = ["League", "MatchDate", "HomeTeam", "AwayTeam"]
_BATCH = 5000


def _stream(rows: DataFrame, keys: list[str], start: Callable, fields: list[str], out: str) -> DataFrame:
    """Fold rows sorted by ``keys`` and day; ``start(key)`` gives a function from one day's rows to their results."""
    order = [*keys, "day", "HomeTeam"]
    columns = [*keys, *[c for c in ["MatchDate", "day", "HomeTeam", "AwayTeam"]], *fields]
    sorted_rows = rows.select(*columns).repartition(*keys).sortWithinPartitions(*order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, today, done = None, None, [], []

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(done, schema)
            done.clear()
            return made

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if today and (key != held or row["day"] != today[0]["day"]):
                    done.extend(state(today))
                    today = []
                if key != held:
                    held, state = key, start(*key)
                today.append(row)
                if len(done) >= _BATCH:
                    yield emit()
        if today:
            done.extend(state(today))
        yield emit()

    kinds = {"string": pa.string(), "double": pa.float64(), "date": pa.date32()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in out.split(", "))])
    return sorted_rows.mapInArrow(fold, out)


def elo(prepared: DataFrame, home_advantage: float = HOME_ADVANTAGE) -> DataFrame:
    """``(League, MatchDate, HomeTeam, AwayTeam, home_elo, away_elo, home_elo_expected)`` before each match."""
    if not math.isfinite(home_advantage):
        raise ValueError("the home advantage is not a finite number")

    def start(_league):
        ratings: dict[str, float] = {}

        def day(rows: list[dict]) -> list[dict]:
            moves, out = [], []
            for r in rows:
                home, away = (ratings.get(r[c], START_ELO) for c in ("HomeTeam", "AwayTeam"))
                expected = 1 / (1 + 10 ** (-(home + home_advantage - away) / 400))
                out.append({k: r[k] for k in _KEYS} | {"home_elo": home, "away_elo": away})
                if r["score"] is not None:
                    moves.append((r["HomeTeam"], r["AwayTeam"], ELO_STEP * (r["score"] - expected)))
            for home, away, change in moves:
                ratings[home] = ratings.get(home, START_ELO) + change
                ratings[away] = ratings.get(away, START_ELO) - change
            return out

        return day

    rows = prepared.withColumns({"day": F.unix_date("MatchDate"), "score": F.when(F.col("target") == "H", 1.0).when(F.col("target") == "D", 0.5).when(F.col("target") == "A", 0.0)})
    rated = _stream(rows, ["League"], start, ["score"], "League string, MatchDate date, HomeTeam string, AwayTeam string, home_elo double, away_elo double")
    return rated.withColumn("home_elo_expected", elo_expectation(F.col("home_elo") + home_advantage - F.col("away_elo")))


def fit_counts(attack: np.ndarray, defence: np.ndarray, venue: np.ndarray, y: np.ndarray, w: np.ndarray, teams: int, prior: np.ndarray, start: np.ndarray | None = None, results: int | None = None) -> np.ndarray | None:
    """Parameters (base, home advantage, attacks, defences) that minimise the weighted, penalised Poisson loss in the box.

    The objective is strictly convex, so projected Newton steps find its only
    optimum from any start. A row touches four parameters, so gradients and
    curvatures are sums by index; no design matrix is made. A row may stand
    for several results of the same teams and venue, ``results`` in all, by
    their summed weight and mean. None if the optimum isn't found.
    """
    size, results = 2 + 2 * teams, len(y) if results is None else results
    base, home = np.zeros(len(y), np.int64), np.ones(len(y), np.int64)
    touched = [(base, np.ones(len(y))), (home, venue.astype(float)), (2 + attack, np.ones(len(y))), (2 + teams + defence, np.ones(len(y)))]
    precision = np.full(size, TEAM_PRECISION)
    precision[:2] = GLOBAL_PRECISION
    centre = np.zeros(size)
    centre[:2] = prior
    high = np.concatenate(([BOUNDS[0], BOUNDS[1]], np.full(2 * teams, BOUNDS[2])))

    def means(x: np.ndarray) -> np.ndarray:
        return sum(x[at] * share for at, share in touched)

    def loss(x: np.ndarray) -> float:
        eta = means(x)
        return float(w @ (np.exp(eta) - y * eta) + 0.5 * precision @ (x - centre) ** 2)

    x = centre.copy() if start is None else start.copy()
    now, close = loss(x), 0
    for _ in range(100):
        mean = w * np.exp(means(x))
        slope = precision * (x - centre)
        curve = np.diag(precision).reshape(-1)
        for at, share in touched:
            slope += np.bincount(at, (mean - w * y) * share, size)
            for other, part in touched:
                curve = curve + np.bincount(at * size + other, mean * share * part, size * size)
        held = ((x >= high) & (slope < 0)) | ((x <= -high) & (slope > 0))
        free = ~held
        if not np.isfinite(now):
            return None
        steep = np.abs(slope[free]).max(initial=0) / max(1.0, results)
        if steep < 1e-13 or close == 3:
            return x
        step = np.linalg.solve(curve.reshape(size, size)[np.ix_(free, free)], slope[free])
        new, share = x.copy(), 1.0
        if steep < 1e-6:  # so near, the loss says nothing more: full steps
            new[free] = np.clip(x[free] - step, -high[free], high[free])
            value, close = loss(new), close + 1
        else:
            while share > 1e-10:
                new[free] = np.clip(x[free] - share * step, -high[free], high[free])
                value = loss(new)
                if value < now:
                    break
                share /= 2
            else:
                return None
        x, now = new, value
    return None


def skellam(home: float, away: float) -> tuple[float, float, float]:
    """P(X > Y), P(X = Y), P(X < Y) for independent Poisson counts; sums reach so far that what is left out is below rounding."""
    top = max(home, away)
    k = np.arange(int(top + 12 * math.sqrt(top) + 40))
    factorials = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, len(k))))))
    x, y = (np.exp(k * math.log(m) - m - factorials) for m in (home, away))
    below = lambda p: np.concatenate(([0.0], np.cumsum(p)[:-1]))
    return float(x @ below(y)), float(x @ y), float(y @ below(x))


_VALUES = ["expected_home", "expected_away", "home_attack", "home_defence", "away_attack", "away_defence"]
_CHANCES = ["p_home", "p_draw", "p_away"]


def count_rows(prepared: DataFrame) -> DataFrame:
    """``(League, MatchDate, HomeTeam, AwayTeam, day, played, stat, home, away)``: a row for each match and statistic."""
    stats = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(h).alias("home"), F.col(a).alias("away")) for s, (h, a, _) in COUNT_MODELS.items()])
    return prepared.select(*_KEYS, F.unix_date("MatchDate").alias("day"), F.col("target").isNotNull().alias("played"), F.inline(stats))


def refit_days(rows: DataFrame) -> DataFrame:
    """``(League, stat, fit_day)``: the days on which a model is fitted anew, from ``count_rows``.

    Every fixture's day is an occasion, played or not; it is taken if the last
    taken one lies REFIT_DAYS back and MEMORY_DAYS hold LEAST_MATCHES results.
    Results don't enter into it, so the days are settled before any fit. Days
    are folded, not matches: as many as a league has match days.
    """
    counted = F.col("played") & (F.col("home").isNotNull() | F.col("away").isNotNull())
    days = rows.groupBy("League", "stat", "day").agg(F.count_if(counted).alias("n"))
    memory = Window.partitionBy("League", "stat").orderBy("day").rangeBetween(-MEMORY_DAYS, -1)
    ready = days.withColumn("held", F.coalesce(F.sum("n").over(memory), F.lit(0))).where(F.col("held") >= LEAST_MATCHES)
    listed = ready.groupBy("League", "stat").agg(F.sort_array(F.collect_list("day")).alias("days"))
    none = F.array().cast("array<int>")
    taken = F.aggregate("days", none, lambda fits, day: F.when((F.size(fits) == 0) | (day - F.element_at(fits, -1) >= REFIT_DAYS), F.concat(fits, F.array(day))).otherwise(fits))
    return listed.select("League", "stat", F.explode(F.when(F.size("days") > 0, taken)).alias("fit_day"))


def _fit_window(rows: pd.DataFrame) -> pd.DataFrame:
    """One refit: the parameters of all teams in its window, or a row without them and a warning.

    A row is a result of ``day``, or all results of two teams as mean counts
    with their summed ``home_weight`` and ``away_weight`` and their number ``n``.
    """
    league, stat, day = rows["League"].iloc[0], rows["stat"].iloc[0], int(rows["fit_day"].iloc[0])
    names, places = np.unique(np.concatenate([rows["HomeTeam"], rows["AwayTeam"]]).astype(object), return_inverse=True)
    home, away = places[: len(rows)], places[len(rows) :]
    y = np.concatenate([rows["home"], rows["away"]]).astype(float)
    there = ~np.isnan(y)
    attack, defence = np.concatenate([home, away]), np.concatenate([away, home])
    venue = np.repeat([1.0, 0.0], len(rows))
    if "n" in rows:
        w, results = np.concatenate([rows["home_weight"], rows["away_weight"]]).astype(float), int(rows["n"].sum())
    else:
        w, results = np.tile(2.0 ** (-(day - rows["day"].to_numpy()) / HALF_LIFE), 2), int(there.sum())
    found = fit_counts(attack[there], defence[there], venue[there], y[there], w[there], len(names), np.log([COUNT_MODELS[stat][2], HOME_RATIO]), None, results)
    if found is None:
        warnings.warn(f"{league}, {stat}: the ratings of day {day} were not found; those before stay in use", RuntimeWarning, stacklevel=2)
        return pd.DataFrame({"League": [league], "stat": [stat], "fit_day": [day], "base": [None], "edge": [None], "ratings": [None]})
    n = len(names)
    ratings = [{"Team": t, "attack": float(found[2 + i]), "defence": float(found[2 + n + i])} for i, t in enumerate(names)]
    return pd.DataFrame({"League": [league], "stat": [stat], "fit_day": [day], "base": [found[0]], "edge": [found[1]], "ratings": [ratings]})


def fit_refits(rows: DataFrame, refits: DataFrame) -> DataFrame:
    """``(League, stat, fit_day, base, edge, ratings)``: one row a refit, nulls where it failed.

    A result goes to the refits whose memory holds it: both are dealt into
    spans of REFIT_DAYS, so the interval join is an equality with a check. A
    refit's loss depends on the results of two teams by their summed weights
    and counts only, which are added up before the shuffle, so that its task
    gets a row for each pair of teams, however many matches they played.
    Refits don't wait for each other, as the optimum is the same from any
    start.
    """
    span = F.floor(F.col("day") / REFIT_DAYS)
    results = rows.where(F.col("played") & (F.col("home").isNotNull() | F.col("away").isNotNull())).select("League", "stat", "day", "HomeTeam", "AwayTeam", "home", "away", span.alias("span"))
    reach = F.sequence(F.floor((F.col("fit_day") - MEMORY_DAYS) / REFIT_DAYS), F.floor((F.col("fit_day") - 1) / REFIT_DAYS))
    spans = refits.select("League", "stat", "fit_day", F.explode(reach).alias("span"))
    held = results.join(spans, ["League", "stat", "span"]).where((F.col("day") >= F.col("fit_day") - MEMORY_DAYS) & (F.col("day") < F.col("fit_day")))
    weight = F.pow(F.lit(2.0), (F.col("day") - F.col("fit_day")) / HALF_LIFE)
    held = held.withColumns({f"{c}_weight": F.when(F.col(c).isNotNull(), weight) for c in ("home", "away")})
    means = [(F.sum(F.col(f"{c}_weight") * F.col(c)) / F.sum(f"{c}_weight")).alias(c) for c in ("home", "away")]
    sums = [F.sum(f"{c}_weight").alias(f"{c}_weight") for c in ("home", "away")]
    pairs = held.groupBy("League", "stat", "fit_day", "HomeTeam", "AwayTeam").agg(*means, *sums, (F.count("home") + F.count("away")).alias("n"))
    out = "League string, stat string, fit_day int, base double, edge double, ratings array<struct<Team: string, attack: double, defence: double>>"
    return pairs.groupBy("League", "stat", "fit_day").applyInPandas(_fit_window, out)


def _match_chances(home: Column, away: Column) -> Column:
    def chances(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([skellam(x, y) if x == x and y == y else (None, None, None) for x, y in zip(a, b, strict=True)], columns=_CHANCES)

    return F.pandas_udf(chances, ", ".join(f"{c} double" for c in _CHANCES))(home, away)


def count_ratings(prepared: DataFrame) -> DataFrame:
    """``(League, MatchDate, HomeTeam, AwayTeam, stat, expected_home, expected_away, home_attack, home_defence, away_attack, away_defence, p_home, p_draw, p_away)``.

    log E[count] = base + home advantage + attack + defence, refitted from the
    last three years at most every 28 days; a match takes the last good fit of
    its day or before, the priors if there is none, and neutral ratings for
    teams that the fit's window lacks. The match probabilities are those of
    independent Poisson counts, for goals only.
    """
    rows = count_rows(prepared)
    fits = fit_refits(rows, refit_days(rows)).where("base IS NOT NULL")
    met = asof_join(rows.select(*_KEYS, "day", "stat"), fits, ["League", "stat"], "day", "fit_day", ["fit_day", "base", "edge"], strict=False)
    strengths = fits.select("League", "stat", "fit_day", F.inline("ratings"))
    for side in ("home", "away"):
        own = strengths.select("League", "stat", "fit_day", F.col("Team").alias(f"{side.capitalize()}Team"), F.col("attack").alias(f"{side}_attack"), F.col("defence").alias(f"{side}_defence"))
        met = met.join(own, ["League", "stat", "fit_day", f"{side.capitalize()}Team"], "left")
    prior = F.create_map(*[F.lit(x) for s, (_, _, p) in COUNT_MODELS.items() for x in (s, math.log(p))])[F.col("stat")]
    rated = met.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in _VALUES[2:]} | {"base": F.coalesce("base", prior), "edge": F.coalesce("edge", F.lit(math.log(HOME_RATIO)))})
    expected = {"expected_home": F.exp(F.col("base") + F.col("edge") + F.col("home_attack") + F.col("away_defence")), "expected_away": F.exp(F.col("base") + F.col("away_attack") + F.col("home_defence"))}
    rated = rated.withColumns(expected)
    goals = F.col("stat") == "goals"
    rated = rated.withColumn("p", _match_chances(F.when(goals, F.col("expected_home")), F.when(goals, F.col("expected_away"))))
    return rated.select(*_KEYS, "stat", *_VALUES, *[F.col("p")[c].alias(c) for c in _CHANCES])
