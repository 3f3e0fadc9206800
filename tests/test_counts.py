"""Count ratings fitted refit by refit against one fold over the days."""

import datetime as dt
import math
import random
import warnings

import numpy as np
import pandas as pd
import pytest
from foretell.operators import ratings
from foretell.operators.prepare import prepare

DAY0 = dt.date(2018, 1, 1)
SCHEMA = "MatchDate date, League string, HomeTeam string, AwayTeam string, FullTimeHomeGoals double, FullTimeAwayGoals double, HomeShots double, AwayShots double, HomeShotsOnTarget double, AwayShotsOnTarget double"


def matches(seed, league, days, step, teams):
    rng, rows = random.Random(seed), []
    for k in range(0, days, step):
        clubs = list(teams)
        rng.shuffle(clubs)
        for h, a in zip(clubs[::2], clubs[1::2]):
            played = rng.random() > 0.1
            value = lambda top, missing: None if rng.random() < missing else float(rng.randint(0, top))
            goals = [value(4, 0), value(3, 0)] if played else [None, None]
            rows.append((DAY0 + dt.timedelta(days=k), league, h, a, *goals, *([value(15, 0.3), value(12, 0.3)] if played else [None, None]), *([value(7, 0.6), value(5, 0.6)] if played else [None, None])))
    return rows


def fold(rows):
    """All predictions by walking through the days with the state of one model a league and statistic."""
    out = {}
    places = {"goals": 4, "shots": 6, "sot": 8}
    for league in {r[1] for r in rows}:
        for stat, at in places.items():
            mine = sorted(r for r in rows if r[1] == league)
            prior = np.log([ratings.COUNT_MODELS[stat][2], 1.25])
            state, last, history = (prior, {}), None, []
            for day in sorted({r[0] for r in mine}):
                if last is None or (day - last).days >= 28:
                    held = [r for r in history if (day - r[0]).days <= 1095]
                    if len(held) >= 20:
                        last = day
                        names = sorted({t for r in held for t in r[2:4]})
                        sides = [(names.index(x), names.index(y), v, n, 2 ** (-(day - r[0]).days / 180)) for r in held for x, y, v, n in ((r[2], r[3], 1, r[at]), (r[3], r[2], 0, r[at + 1])) if n is not None]
                        x = ratings.fit_counts(*map(np.array, zip(*sides, strict=True)), len(names), prior)
                        state = x[:2], {t: (x[2 + i], x[2 + len(names) + i]) for i, t in enumerate(names)}
                today = [r for r in mine if r[0] == day]
                for r in today:
                    (ha, hd), (aa, ad) = (state[1].get(t, (0.0, 0.0)) for t in r[2:4])
                    base, edge = state[0]
                    out[(*r[1:4], day, stat)] = (math.exp(base + edge + ha + ad), math.exp(base + aa + hd), ha, hd, aa, ad)
                history += [r for r in today if r[4] is not None and (r[at] is not None or r[at + 1] is not None)]
    return out


def test_like_a_fold(spark):
    rows = matches(1, "L", 1500, 9, "ABCDEFGH") + matches(2, "M", 400, 30, "ABCDXY") + matches(3, "few", 60, 20, "AB")
    got = ratings.count_ratings(prepare(spark.createDataFrame(rows, SCHEMA))).collect()
    want = fold(rows)
    assert len(got) == len(want) == 3 * len(rows)
    for r in got:
        assert tuple(r)[5:11] == pytest.approx(want[r.League, r.HomeTeam, r.AwayTeam, r.MatchDate, r.stat], abs=1e-6)
        assert (r.p_home is None) == (r.stat != "goals")
        if r.stat == "goals":
            assert (r.p_home, r.p_draw, r.p_away) == pytest.approx(ratings.skellam(r.expected_home, r.expected_away))
    refits = ratings.refit_days(ratings.count_rows(prepare(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert len([r for r in refits if (r.League, r.stat) == ("L", "goals")]) > 40 and not [r for r in refits if r.League == "few"]


def test_later_results_change_nothing(spark):
    rows = matches(4, "L", 500, 7, "ABCDEF")
    cut = DAY0 + dt.timedelta(days=300)
    blind = [r if r[0] < cut else (*r[:4], *[None] * 6) for r in rows]
    get = lambda x: sorted(tuple(r)[:11] for r in ratings.count_ratings(prepare(spark.createDataFrame(x, SCHEMA))).collect() if r.MatchDate <= cut)
    for a, b in zip(get(rows), get(blind), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)


def test_a_failed_refit_warns_and_has_no_parameters(monkeypatch):
    monkeypatch.setattr(ratings, "fit_counts", lambda *_: None)
    window = pd.DataFrame({"League": ["L"], "stat": ["goals"], "fit_day": [400], "day": [390], "HomeTeam": ["A"], "AwayTeam": ["B"], "home": [1.0], "away": [None]})
    with pytest.warns(RuntimeWarning, match="those before stay in use"):
        found = ratings._fit_window(window)
    assert found["base"].isna().all() and len(found) == 1


def test_a_failed_refit_leaves_the_last_good_one_in_use(spark, monkeypatch):
    rows = prepare(spark.createDataFrame(matches(5, "L", 300, 7, "ABCDEF"), SCHEMA))
    fits = ratings.fit_refits(ratings.count_rows(rows), ratings.refit_days(ratings.count_rows(rows))).where("stat = 'goals'").toPandas().sort_values("fit_day")
    lost = int(fits["fit_day"].iloc[2])
    before = fits.iloc[1]
    whole = ratings.fit_refits
    monkeypatch.setattr(ratings, "fit_refits", lambda *a: whole(*a).where(f"fit_day != {lost}"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = ratings.count_ratings(rows).where(f"stat = 'goals' AND unix_date(MatchDate) BETWEEN {lost} AND {lost + 27}").collect()
    known = {r["Team"]: r["attack"] for r in before["ratings"]}
    assert found and all(r.home_attack == pytest.approx(known.get(r.HomeTeam, 0.0)) for r in found)


def test_a_refits_task_gets_a_row_for_each_pair_of_teams(spark, monkeypatch):
    import pyspark.sql.group as group

    given = []
    whole = group.GroupedData.applyInPandas
    monkeypatch.setattr(group.GroupedData, "applyInPandas", lambda self, *a: given.append(self._df) or whole(self, *a))
    counted = ratings.count_rows(prepare(spark.createDataFrame(matches(6, "L", 600, 2, "ABCD"), SCHEMA)))
    found = ratings.fit_refits(counted, ratings.refit_days(counted)).where("stat = 'sot'").orderBy("fit_day").collect()
    sizes = [r["count"] for r in given[0].groupBy("League", "stat", "fit_day").count().collect()]
    assert len(sizes) == 3 * len(found) and max(sizes) == 4 * 3
    # The same optimum as from the single results.
    last = found[-1]
    window = counted.where(f"stat = 'sot' AND played AND day < {last.fit_day} AND (home IS NOT NULL OR away IS NOT NULL)").toPandas()
    alone = ratings._fit_window(window.assign(fit_day=last.fit_day)).iloc[0]
    assert len(window) > 300 and (last.base, last.edge) == pytest.approx((alone["base"], alone["edge"]), abs=1e-9)
    assert [tuple(r) for r in last.ratings] == [(t["Team"], pytest.approx(t["attack"], abs=1e-9), pytest.approx(t["defence"], abs=1e-9)) for t in alone["ratings"]]
