"""Prices and bets: market probabilities, expected value, settlement, return on stakes and its controls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretell.functions.scalars import devig, expected_value, match_id
from foretell.schema import BOOKMAKER_ODDS, CLOSING_ODDS, RESULTS

THRESHOLDS = (0.0, 0.05, 0.10, 0.20)
_SIDES = ["home", "draw", "away"]


def build_market(matches: DataFrame, odds: list[str] = CLOSING_ODDS) -> DataFrame:
    """``(MatchId, market_H/D/A, price_H/D/A, result, League)`` of matches with a result and usable prices.

    Of rows with one id the first by prices stays.
    """
    usable = matches.where(F.col("FullTimeResult").isNotNull()).select(match_id().alias("MatchId"), *[F.col(o).cast("double").alias(f"price_{r}") for o, r in zip(odds, RESULTS)], F.col("FullTimeResult").alias("result"), "League")
    usable = usable.where(" AND ".join(f"price_{r} > 1 AND NOT isnan(price_{r})" for r in RESULTS))
    first = F.row_number().over(Window.partitionBy("MatchId").orderBy(*[f"price_{r}" for r in RESULTS], "result"))
    once = usable.withColumn("__nth", first).where("__nth = 1").drop("__nth")
    return once.select("MatchId", *[p.alias(f"market_{r}") for p, r in zip(devig([F.col(f"price_{r}") for r in RESULTS]), RESULTS)], *[f"price_{r}" for r in RESULTS], "result", "League")


def pooled(team_predictions: DataFrame) -> DataFrame:
    """One H/D/A distribution a match from its two team rows ``(MatchId, Season, IsHome, ProbabilityLoss/Draw/Win)``: their mean, normalised."""
    home = F.col("IsHome") == 1
    sides = {"H": F.when(home, F.col("ProbabilityWin")).otherwise(F.col("ProbabilityLoss")), "D": F.col("ProbabilityDraw"), "A": F.when(home, F.col("ProbabilityLoss")).otherwise(F.col("ProbabilityWin"))}
    mean = team_predictions.groupBy("MatchId", "Season").agg(*[F.avg(x).alias(r) for r, x in sides.items()])
    total = F.col("H") + F.col("D") + F.col("A")
    return mean.select("MatchId", "Season", *[(F.col(r) / total).alias(r) for r in RESULTS])


def join_market(predictions: DataFrame, market: DataFrame) -> DataFrame:
    return predictions.join(market, "MatchId")


def candidate_bets(joined: DataFrame) -> DataFrame:
    """Three rows a match: outcome, price, probabilities, expected value, profit of one unit."""
    parts = F.array(*[F.struct(F.lit(r).alias("outcome"), F.col(f"price_{r}").alias("price"), F.col(r).alias("model_prob"), F.col(f"market_{r}").alias("market_prob")) for r in RESULTS])
    rows = joined.select("MatchId", "Season", "League", "result", F.inline(parts))
    won = F.col("result") == F.col("outcome")
    return rows.select("MatchId", "Season", "League", "outcome", "price", "model_prob", "market_prob", expected_value(F.col("model_prob"), F.col("price")).alias("expected_value"), F.when(won, F.col("price") - 1).otherwise(-1.0).alias("profit"), won.alias("won"))


def simulate(joined: DataFrame, edge_threshold: float) -> DataFrame:
    """One-unit bets on every outcome whose expected value is above the threshold."""
    return candidate_bets(joined).where(F.col("expected_value") > edge_threshold)


def threshold_bets(joined: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The bets with each threshold that they clear, in one pass for all thresholds."""
    cleared = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("expected_value") > t)
    return candidate_bets(joined).withColumn("edge_threshold", F.explode(cleared))


def roi_summary(joined: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Bets, win rate, return and profit at each threshold that any bet clears."""
    return threshold_bets(joined, thresholds).groupBy("edge_threshold").agg(F.count("*").alias("bets"), F.avg(F.col("won").cast("double")).alias("win_rate"), F.avg("profit").alias("roi"), F.sum("profit").alias("profit_units"))


def summarize(joined: DataFrame, thresholds=THRESHOLDS, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """``roi_summary`` with the bootstrap interval of the return at each threshold, roi_ci_low and roi_ci_high."""
    intervals = bootstrap_roi(threshold_bets(joined, thresholds), draws, seed, ["edge_threshold"])
    rows = roi_summary(joined, thresholds).join(F.broadcast(intervals), "edge_threshold")  # a row for each threshold
    return rows.select("edge_threshold", "bets", "win_rate", "roi", "roi_ci_low", "roi_ci_high", "profit_units")


def by_season(bets: DataFrame) -> DataFrame:
    return bets.groupBy("Season").agg(F.count("*").alias("bets"), F.avg("profit").alias("roi"), F.sum("profit").alias("profit_units"))


def bootstrap_roi(bets: DataFrame, draws: int = 10_000, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """``(by, roi_ci_low, roi_ci_high)``: the 2.5 and 97.5 percentiles of the mean profit of resampled bets; nulls without bets.

    A resample of n bets is a multinomial count of the distinct profits, so
    only those (prices, in hundredths mostly) and their numbers go to the
    tasks, never the bets: each draw costs the number of distinct profits.
    """
    by = by or []
    support = bets.groupBy(*by, "profit").agg(F.count("*").alias("n"))
    packed = support.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("profit", "n"))).alias("support"))
    spread = bets.sparkSession.range(0, draws, 1, 8).crossJoin(F.broadcast(packed))  # one row, or one for each group

    def resample(frames):
        for frame in frames:
            groups = frame.groupby(by, sort=False, dropna=False) if by else [((), frame)]
            for key, rows in groups:
                if not len(rows) or not len(rows["support"].iloc[0]):
                    yield pd.DataFrame({"mean": pd.Series([], dtype="float64")} | {c: frame[c].iloc[:0] for c in by})
                    continue
                held = rows["support"].iloc[0]
                profit = np.array([x["profit"] for x in held])
                n = np.array([x["n"] for x in held], dtype=np.int64)
                means = [np.random.default_rng([seed, int(k)]).multinomial(n.sum(), n / n.sum()) @ profit / n.sum() for k in rows["id"]]
                yield pd.DataFrame({"mean": means} | dict(zip(by, key)))

    kinds = dict(bets.dtypes)
    means = spread.mapInPandas(resample, ", ".join(["mean double", *[f"`{c}` {kinds[c]}" for c in by]]))
    return means.groupBy(*by).agg(F.percentile("mean", F.lit(0.025)).alias("roi_ci_low"), F.percentile("mean", F.lit(0.975)).alias("roi_ci_high"))


def random_bet_control(joined: DataFrame, seed: int = 0) -> DataFrame:
    """``(bets, roi)`` of one outcome a match picked by a hash of its id and the seed: the market's margin."""
    pick = F.get(F.array(*map(F.lit, RESULTS)), F.pmod(F.xxhash64("MatchId", F.lit(seed)), F.lit(3)).cast("int"))
    chosen = candidate_bets(joined).where(F.col("outcome") == pick)
    return chosen.agg(F.count("*").alias("bets"), F.avg("profit").alias("roi"))


def has_bookmaker_odds(matches: DataFrame) -> bool:
    return set(BOOKMAKER_ODDS) <= set(matches.columns)


def bookmaker_probabilities(matches: DataFrame) -> DataFrame:
    """``matches`` with market_prob_home/draw/away; null without usable odds, and without odds columns."""
    names = [f"market_prob_{s}" for s in _SIDES]
    if not has_bookmaker_odds(matches):
        return matches.withColumns({n: F.lit(None).cast("double") for n in names})
    return matches.withColumns(dict(zip(names, devig([F.col(o) for o in BOOKMAKER_ODDS]))))


def edges(predicted: DataFrame) -> DataFrame | None:
    """Model minus market probability for each outcome and the best of them; None without odds columns."""
    if not has_bookmaker_odds(predicted):
        return None
    rows = bookmaker_probabilities(predicted).withColumns({f"edge_{s}": F.col(f"prob_{s}") - F.col(f"market_prob_{s}") for s in _SIDES})
    return rows.withColumn("best_edge", F.greatest(*[f"edge_{s}" for s in _SIDES]))
