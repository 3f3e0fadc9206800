"""Window features, ratings and standings against closed forms and a plain loop over rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretell.operators.prepare import long_form, prepare
from foretell.operators.ratings import elo, fit_counts, skellam
from foretell.operators.standings import positions
from foretell.operators.windows import match_windows

DAY0 = dt.date(2023, 7, 3)
SCHEMA = "MatchDate date, League string, HomeTeam string, AwayTeam string, FullTimeHomeGoals double, FullTimeAwayGoals double, HomeShots double, AwayShots double"


@pytest.fixture(scope="module")
def league():
    rng = random.Random(7)
    rows = []
    for week in range(14):
        teams = list("ABCDEF")
        rng.shuffle(teams)
        for h, a in zip(teams[:3], teams[3:]):
            played = rng.random() > 0.15
            rows.append((DAY0 + dt.timedelta(days=5 * week), "L", h, a, float(rng.randint(0, 3)) if played else None, float(rng.randint(0, 3)) if played else None, float(rng.randint(1, 9)) if rng.random() > 0.2 else None, 4.0))
    return rows


@pytest.fixture(scope="module")
def frame(spark, league):
    return prepare(spark.createDataFrame(league, SCHEMA))


def earlier(league, team, date):
    """A team's completed matches before a date: (goal difference, goals for, shots)."""
    out = []
    for d, _, h, a, hg, ag, hs, as_ in league:
        if d < date and hg is not None and team in (h, a):
            out.append((hg - ag, hg, hs) if team == h else (ag - hg, ag, as_))
    return out


def test_windows_against_a_loop(league, frame):
    rows = match_windows(long_form(frame)).select("MatchDate", "Team", "points_last_5", "shots_for_l5", "ppg_l10", "history_matches", "rest_days").collect()
    assert len(rows) == 2 * len(league)
    for r in rows:
        past = earlier(league, r.Team, r.MatchDate)
        points = [3 if g > 0 else 1 if g == 0 else 0 for g, _, _ in past]
        shots = [s for _, _, s in past[-5:]]
        assert r.history_matches == len(past)
        assert r.points_last_5 == (sum(points[-5:]) if past else None)
        assert r.shots_for_l5 == (sum(shots) if shots and None not in shots else None)
        assert r.ppg_l10 == (pytest.approx(sum(points[-10:]) / len(points[-10:])) if past else None)


def test_later_results_change_nothing(spark, league, frame):
    cut = DAY0 + dt.timedelta(days=35)
    changed = [(*r[:4], None if r[0] >= cut else r[4], None if r[0] >= cut else r[5], *r[6:]) for r in league]
    names = ["MatchDate", "Team", "points_last_10", "goals_for_ewm", "season_points"]
    get = lambda f: sorted(map(tuple, match_windows(long_form(f)).where(F.col("MatchDate") <= cut).select(names).collect()))
    assert get(frame) == get(prepare(spark.createDataFrame(changed, SCHEMA)))


def test_positions_against_a_loop(league, frame):
    got = {(r.MatchDate, r.Team): r.position for r in positions(long_form(frame)).collect()}
    for d, _, h, a, *_ in league:
        table = {t: [0, 0, 0] for t in (h, a)}
        for t in "ABCDEF":
            for g, f, _ in earlier(league, t, d):
                row = table.setdefault(t, [0, 0, 0])
                row[0] -= 3 if g > 0 else g == 0
                row[1] -= g
                row[2] -= f
        order = sorted(table, key=lambda t: (*table[t], t))
        assert [got[d, t] for t in (h, a)] == [order.index(t) + 1 for t in (h, a)]


def test_elo_of_one_match(spark):
    rows = [(DAY0, "L", "A", "B", 1.0, 0.0, None, None), (DAY0 + dt.timedelta(days=7), "L", "B", "A", 0.0, 0.0, None, None)]
    second = elo(prepare(spark.createDataFrame(rows, SCHEMA)), 0.0).orderBy("MatchDate").collect()[1]
    assert (second.home_elo, second.away_elo) == (1484.0, 1516.0)


def test_count_fit_is_stationary_and_skellam_sums_to_one():
    rng = np.random.default_rng(0)
    n, teams = 300, 6
    attack, defence, venue, y, w = rng.integers(0, teams, n), rng.integers(0, teams, n), rng.integers(0, 2, n), rng.poisson(1.3, n).astype(float), rng.random(n)
    prior = np.log([1.2, 1.25])
    x = fit_counts(attack, defence, venue, y, w, teams, prior, np.concatenate((prior, np.zeros(2 * teams))))
    mean = w * np.exp(x[0] + x[1] * venue + x[2 + attack] + x[2 + teams + defence])
    assert abs((mean - w * y).sum() + x[0] - prior[0]) < 1e-5
    assert sum(skellam(1.7, 0.9)) == pytest.approx(1.0, abs=1e-12)
    assert skellam(1.5, 1.5)[1] == pytest.approx(np.exp(-3) * np.i0(3.0), abs=1e-12)


def test_errors(spark, league):
    with pytest.raises(ValueError, match="twice"):
        prepare(spark.createDataFrame(league + league[:1], SCHEMA))
    with pytest.raises(ValueError, match="itself"):
        prepare(spark.createDataFrame([(DAY0, "L", "A", "A", 1.0, 0.0, None, None)], SCHEMA))
    with pytest.raises(ValueError, match="columns"):
        prepare(spark.createDataFrame([("x",)], "League string"))
    assert match_windows(long_form(prepare(spark.createDataFrame([], SCHEMA)))).count() == 0
