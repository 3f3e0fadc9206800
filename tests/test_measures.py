"""Metrics, bets, sources and models on closed-form cases."""

import datetime as dt
import http.server
import os
import threading
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretell.operators import betting, blocks, catalog, experiments, metrics, models
from foretell.schema import FEATURE_GROUPS, FEATURES
from foretell.functions.scalars import mixed_date
from foretell.sources.ragged import ragged_headers, read_ragged
from foretell.sources.season_files import ODDS_COLUMNS, UntrustedHost, cache_root, cached_season, get_trusted, http_fetch, load_matches, parse_season_files, season_code, season_label, season_url


def test_registries():
    assert len(set(FEATURES)) == 181 and len(set(ODDS_COLUMNS)) == 46
    assert [len(FEATURE_GROUPS[g]) for g in ("baseline_form", "extended_stats", "all_features", "baseline_context", "baseline_poisson", "baseline_shot_ratings", "corrected_legacy")] == [12, 37, 168, 48, 19, 24, 113]


def test_gini_of_perfect_and_flat_predictions(spark):
    good = spark.createDataFrame([(0, 0.8, 0.1, 0.1), (1, 0.1, 0.8, 0.1), (2, 0.1, 0.1, 0.8)], "y int, p0 double, p1 double, p2 double")
    assert metrics.gini(good).first().gini_macro == pytest.approx(1.0)
    flat = good.withColumns({p: F.lit(1 / 3) for p in ("p0", "p1", "p2")})
    assert metrics.gini(flat).first().gini_macro == pytest.approx(0.0)
    assert metrics.gini(good.where("y < 2")).first().gini_macro is None
    row = metrics.probability_metrics(flat).first()
    assert row.log_loss == pytest.approx(np.log(3)) and row.brier_score == pytest.approx(2 / 3)


def test_bets(spark):
    rows = [("m1", "2020", "L", "H", 0.5, 0.3, 0.2, 2.2, 3.0, 4.0, 0.45, 0.3, 0.25), ("m2", "2020", "L", "A", 0.5, 0.3, 0.2, 2.2, 3.0, 4.0, 0.45, 0.3, 0.25)]
    joined = spark.createDataFrame(rows, "MatchId string, Season string, League string, result string, H double, D double, A double, price_H double, price_D double, price_A double, market_H double, market_D double, market_A double")
    bets = betting.simulate(joined, 0.05)
    assert sorted(r.profit for r in bets.collect()) == pytest.approx([-1.0, 1.2])
    low, high = betting.bootstrap_roi(bets, draws=400).first()
    assert -1 <= low <= 0.1 <= high <= 1.2 + 1e-9
    assert betting.bootstrap_roi(bets.limit(0), draws=10).first() == (None, None)


def test_logistic_is_stationary_and_univariate_fit_agrees(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), float(y + rng.normal(0, 1.5)) if i % 9 else None, "L" if i % 2 else "M") for i, y in enumerate(rng.integers(0, 3, 240))]
    train = spark.createDataFrame(rows, "target_label int, x double, League string").persist()
    status, alone = experiments.univariate_models(train.withColumns({"flat": F.lit(2.0), "none": F.lit(None).cast("double")}), ["x", "League", "flat", "none"])
    assert status == {"x": "OK", "League": "OK", "flat": "constant in train", "none": "missing in train"}
    two = experiments.univariate_predictions(train.withColumns({"flat": F.lit(2.0), "none": F.lit(None).cast("double")}), alone, list(status), [0.2, 0.3, 0.5])
    assert two.count() == 4 * 240 and two.where("feature = 'flat'").select("p2").distinct().collect() == [(0.5,)]
    for column in ("x", "League"):
        one = models.fit_logistic(train, [column])
        assert np.abs(np.array(one.fitted.weights) - np.array(alone[column].fitted.weights)).max() < 1e-9
        wanted = {k: Counter(round(r[0], 9) for r in one.predict(train).select(k).collect()) for k in models.PROBABILITIES}
        assert wanted == {k: Counter(round(r[0], 9) for r in two.where(F.col("feature") == column).select(k).collect()) for k in models.PROBABILITIES}
    assert models.fit_logistic(train, ["x"]).converged and not models.fit_logistic(train, ["x"], max_iter=1).converged
    with pytest.raises(ValueError):
        models.fit_logistic(train.where("target_label = 1"), ["x"])


@pytest.mark.parametrize("classes", [3, 2])
def test_models_fitted_together_are_those_fitted_alone(spark, classes):
    rng = np.random.default_rng(7)
    rows = [(int(y) + 3 - classes, float(y + rng.normal(0, 1.5)) if i % 9 else None, float(rng.normal()), "L" if i % 2 else None if i % 5 else "M") for i, y in enumerate(rng.integers(0, classes, 240))]
    train = spark.createDataFrame(rows, "target_label int, x double, z double, League string").persist()
    unseen = train.union(spark.createDataFrame([(1, None, 50.0, "N")], train.schema)).withColumn("row", F.monotonically_increasing_id())
    groups = {1: ["x"], 2: ["League", "z"], 3: ["z", "x", "League"]}
    seen = []
    together = models.fit_logistics(train, groups, progress=lambda done, all_: seen.append((done, all_)))
    assert list(together) == [1, 2, 3] and seen == [(1, 3), (2, 3), (3, 3)]
    many = models.predict_many(unseen, together, "simulation", ["row"])
    assert many.count() == 3 * unseen.count()
    for key, columns in groups.items():
        alone = models.fit_logistic(train, columns).predict(unseen).orderBy("row").select(*models.PROBABILITIES).collect()
        one = many.where(F.col("simulation") == key).orderBy("row").select(*models.PROBABILITIES).collect()
        assert np.abs(np.array(alone) - np.array(one)).max() < 1e-6
    assert models.predict_many(unseen.limit(0), together, "simulation", ["row"]).count() == 0


def _objective_slope(x, y, w, b, c):
    scores = x @ w.T + b
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    off = p - np.eye(3)[y]
    return np.abs(c * off.T @ x + w).max(), np.abs(c * off.sum(axis=0)).max()


def test_folds_and_penalties_are_fitted_to_the_optimum(spark):
    rng = np.random.default_rng(11)
    rows = [(int(y), float(y + rng.normal(0, 2)) if i % 7 else None, float(rng.normal(3, 9)), i) for i, y in enumerate(rng.integers(0, 3, 400))]
    data = spark.createDataFrame(rows, "target_label int, x double, z double, at int").repartition(5)
    found = models.fit_models(data, {"early": (0, ["x", "z"]), "late": (1, ["z", "x"]), "one": (1, ["z"])}, [150, 400], F.col("at"), c=0.3)
    for key, limit in (("early", 150), ("late", 400), ("one", 400)):
        model, mine = found[key], rows[:limit]
        assert model.converged and model.fitted.passes < 15
        for i, name in enumerate(model.encoder.numeric):
            values = np.array([r[1 if name == "x" else 2] for r in mine], float)
            filled = np.where(np.isnan(values), np.nanmedian(values), values)
            assert (model.encoder.medians[i], model.encoder.means[i], model.encoder.scales[i]) == pytest.approx((np.nanmedian(values), filled.mean(), filled.std()))
        e = model.encoder
        design = np.array([[((m if (v := r[1 if n == "x" else 2]) is None else v) - a) / s for n, m, a, s in zip(e.numeric, e.medians, e.means, e.scales)] for r in mine])
        slopes = _objective_slope(design, np.array([r[0] for r in mine]), np.array(model.fitted.weights), np.array(model.fitted.intercepts), 0.3)
        assert max(slopes) < 1e-5
    with pytest.raises(ValueError):
        models.fit_models(data, {0: (0, ["x"])}, [1], F.col("at"))


def test_selection_is_exact(spark):
    rng = np.random.default_rng(2)
    table = np.stack([rng.normal(size=301), rng.integers(-3, 3, 301) * 1.0, np.exp(rng.normal(0, 40, 301)), np.full(301, np.nan), -np.abs(rng.normal(size=301)) * 1e-300], axis=1)
    table[rng.random(table.shape) < 0.2] = np.nan
    names = list("abcde")
    data = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], 0, i) for i, r in enumerate(table)], ", ".join(f"{n} double" for n in names) + ", target_label int, at int").repartition(4)
    held = blocks.make_blocks(data, names, place=F.col("at"))
    limits = [1.0, 40.0, 301.0, 0.0]
    n = blocks.counts(held, limits)
    least, most = blocks.extremes(held, limits, n)
    middle = blocks.medians(held, limits)
    for f, b in enumerate(limits):
        for c in range(5):
            mine = table[: int(b), c]
            mine = mine[~np.isnan(mine)]
            want = (np.median(mine), mine.min(), mine.max()) if len(mine) else (np.nan,) * 3
            assert np.array_equal((middle[f, c], least[f, c], most[f, c]), want, equal_nan=True) and n[f, c] == len(mine)
    held.release()


def test_pruning_by_one_gram_matrix_agrees_with_pairwise_correlations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    table = np.column_stack([x[:, 0], x[:, 0] * -2 + rng.normal(0, 0.3, 200), x[:, 1], np.full(200, 0.1), x[:, 1] + x[:, 2], x[:, 2]])
    table[::9, 1] = np.nan
    names = list("abcdef")
    data = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], int(i % 3)) for i, r in enumerate(table)], ", ".join(f"{n} double" for n in names) + ", target_label int")
    filled = np.where(np.isnan(table), np.nanmedian(table, axis=0), table)
    with np.errstate(invalid="ignore"):
        related = np.nan_to_num(np.abs(np.corrcoef(filled.T)))
    for threshold in (0.6, 0.9):
        kept = []
        for j in range(6):
            if all(related[i, j] < threshold for i in kept):
                kept.append(j)
        encoder = models.fit_encoder(data, names, prune_at=threshold)
        assert encoder.numeric == [names[j] for j in kept]
        assert encoder.scales[encoder.numeric.index("d")] == 1.0


def test_subsets_are_seeded():
    names = [f"x{i}" for i in range(8)]
    a = experiments.feature_subsets(names, 10, 2, 4, 3)
    assert a == experiments.feature_subsets(names, 10, 2, 4, 3) and len(set(a)) == 10
    with pytest.raises(ValueError):
        experiments.feature_subsets(names, 0)


def test_season_file(spark, tmp_path):
    text = "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,BbAvH\nE0,03/11/02,A,B,1,0,H,1.9,extra,more\nE0,17/08/2002,C,D,x,2\n,,,,,,,\n"
    path = cached_season(2002, "E0", tmp_path, lambda y, d: text.encode("latin-1"))
    rows = parse_season_files(spark, [str(path)], 2002, "E0").orderBy("MatchDate").collect()
    assert [str(r.MatchDate) for r in rows] == ["2002-08-17", "2002-11-03"]
    assert rows[1].AvgH == 1.9 and rows[0].FullTimeHomeGoals is None and rows[0].Season == "2002/03" and rows[0].League == "Premier League"
    assert (season_code(2025), season_label(1999)) == ("2526", "1999/00")
    assert cached_season(2002, "E0", tmp_path, None) == path


def test_dates_of_many_forms(spark):
    same = ["3/11/02", "03/11/2002", "03-11-2002", "3.11.02", "2002-11-03", "2002-11-03T15:30", "03/11/2002 15:30", "3 Nov 2002", "3-Nov-02", "03 November 2002", "Nov 3, 2002", "20021103", " 2002/11/3 "]
    bad = ["", "soon", "32/01/2002", "11/2002", "2002-13-01"]
    rows = spark.createDataFrame([(x,) for x in same + bad], "x string").select("x", mixed_date(F.col("x")).alias("d")).collect()
    assert {r.x: r.d for r in rows} == {x: dt.date(2002, 11, 3) for x in same} | dict.fromkeys(bad)
    old = spark.createDataFrame([("1/2/98",), ("1 Feb 99",), ("1/2/25",)], "x string").select(mixed_date(F.col("x")).alias("d")).collect()
    assert [r.d.year for r in old] == [1998, 1999, 2025]


def test_ragged_files_in_one_scan(spark, tmp_path):
    files = {
        "a.csv": b"\xef\xbb\xbfDiv,Date,FTHG\nE0,1/8/02,2,x,y\n , ,\n\nE0,2/8/02\n",
        "b.csv": 'Date,"A ""b""",A,A\r\n3/8/02,"two\nlines, one field",p,q\r\n4/8/02,M\xfcnchen,,\r\n'.encode("latin-1"),
        "c.csv": b"",
        "d.csv": b"Date,FTHG\n",
    }
    for name, payload in files.items():
        (tmp_path / name).write_bytes(payload)
    paths = [str(tmp_path / n) for n in files]
    heads = {r.path[-5:]: (r.header, r.rows) for r in ragged_headers(spark, paths).collect()}
    assert heads == {"a.csv": (["Div", "Date", "FTHG", "_unnamed_3", "_unnamed_4"], 2), "b.csv": (["Date", 'A "b"', "A", "A"], 2), "d.csv": (["Date", "FTHG"], 0)}
    rows = read_ragged(spark, paths, ["Date", "FTHG", "_unnamed_4", "Second", "A"], renamed={'A "b"': "Second"})
    assert sorted((r.path[-5:], *r[1:]) for r in rows.collect()) == [("a.csv", 1, "1/8/02", "2", "y", None, None), ("a.csv", 2, "2/8/02", "", "", None, None), ("b.csv", 1, "3/8/02", None, None, "two\nlines, one field", "p"), ("b.csv", 2, "4/8/02", None, None, "München", "")]
    with pytest.raises(ValueError, match="empty"):
        parse_season_files(spark, [paths[2]], 2002, "E0")
    with pytest.raises(ValueError, match="no column named Date"):
        (tmp_path / "e.csv").write_bytes(b"Day\n1\n")
        parse_season_files(spark, [str(tmp_path / "e.csv")], 2002, "E0")
    both = parse_season_files(spark, paths[:2], 2002, "E0").orderBy("MatchDate").collect()
    assert [(r.MatchDate.day, r.FullTimeHomeGoals) for r in both] == [(1, 2.0), (2, None), (3, None), (4, None)]


def test_urls_and_fetchers():
    assert season_url(2025, "E0", "http://host/data/") == "http://host/data/2526/E0.csv"
    assert cache_root("x") == Path("x/data/seasons")
    with pytest.raises(OSError):
        http_fetch("http://127.0.0.1:9/none")(2025, "E0")


def test_redirects_are_followed_to_known_hosts_only():
    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            onward = {"/known": f"http://127.0.0.1:{port}/body", "/strange": f"http://localhost:{port}/body", "/file": "file:///etc/hostname", "/round": "/round?"}.get(self.path.partition("?")[0])
            onward = onward + self.path if onward == "/round?" else onward
            self.send_response(302 if onward else 200)
            if onward:
                self.send_header("Location", onward)
            self.end_headers()
            self.wfile.write(b"" if onward else b"text")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    port = server.server_address[1]
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert get_trusted(f"http://127.0.0.1:{port}/known", ["127.0.0.1"]) == b"text"
        with pytest.raises(UntrustedHost):
            get_trusted(f"http://127.0.0.1:{port}/strange", ["127.0.0.1"])
        for path in ("file", "round"):
            with pytest.raises(OSError):
                get_trusted(f"http://127.0.0.1:{port}/{path}", ["127.0.0.1"])
    finally:
        server.shutdown()


def test_a_stale_copy_is_used_with_a_warning(tmp_path):
    def broken(year, division):
        raise OSError("no network")

    today = dt.date(2025, 10, 1)
    path = cached_season(2025, "E0", tmp_path, lambda y, d: b"Date\n", today)
    os.utime(path, (1, 1))
    with pytest.warns(UserWarning, match="cache"):
        assert cached_season(2025, "E0", tmp_path, broken, today) == path
    assert cached_season(2025, "E0", tmp_path, lambda y, d: b"new", today).read_bytes() == b"new"
    with pytest.raises(OSError):
        cached_season(2024, "E0", tmp_path, broken, today)


def test_load_matches_over_files_on_disk(spark, tmp_path):
    def fetch(year, division):
        return f"Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,B365H\n1/09/{year},A{division},B,2,1,H,1.5\n08/09/{year % 100:02d},B,A{division},0,0,D,\n".encode()

    table = load_matches(spark, tmp_path, fetch, 2020, 2021, ["E0", "I1"], dt.date(2023, 1, 1))
    rows = table.collect()
    assert [(str(r.MatchDate), r.League, r.Season) for r in rows] == [("2020-09-01", "Premier League", "2020/21"), ("2020-09-01", "Serie A", "2020/21"), ("2020-09-08", "Premier League", "2020/21"), ("2020-09-08", "Serie A", "2020/21"), ("2021-09-01", "Premier League", "2021/22"), ("2021-09-01", "Serie A", "2021/22"), ("2021-09-08", "Premier League", "2021/22"), ("2021-09-08", "Serie A", "2021/22")]
    assert rows[0].FullTimeHomeGoals == 2 and rows[0].B365H == 1.5 and rows[2].B365H is None
    with pytest.raises(ValueError):
        load_matches(spark, tmp_path, fetch, 2021, 2020)


def test_catalog_covers_every_feature(spark):
    table = catalog.feature_catalog(spark)
    assert table.count() == 182 and catalog.search(table, "ELO").count() >= 6


def test_roi_intervals_by_threshold(spark):
    rows = [(f"m{i}", "2020", "L", "HDA"[i % 3], 0.5, 0.3, 0.2, 2.2, 3.0, 4.0 + i % 2 * 2, 0.45, 0.3, 0.25) for i in range(40)]
    joined = spark.createDataFrame(rows, "MatchId string, Season string, League string, result string, H double, D double, A double, price_H double, price_D double, price_A double, market_H double, market_D double, market_A double")
    got = betting.summarize(joined, (0.05, 0.15, 0.5), draws=300).orderBy("edge_threshold").collect()
    assert [(r.edge_threshold, r.bets) for r in got] == [(0.05, 60), (0.15, 20)]
    for r in got:
        alone = betting.bootstrap_roi(betting.simulate(joined, r.edge_threshold), draws=300).first()
        assert (r.roi_ci_low, r.roi_ci_high) == pytest.approx(tuple(alone)) and r.roi_ci_low < r.roi < r.roi_ci_high


def test_queries_do_the_operators_whole_job(monkeypatch):
    from foretell.plans import queries

    seen = {}

    def record(name):
        def call(*args, **kwargs):
            seen[name] = args[1:], kwargs
            raise InterruptedError

        return call

    monkeypatch.setattr(queries, "_engineered", lambda spark, sf: None)
    monkeypatch.setattr(queries.models, "modeling_data", lambda frame, columns: (None, columns))
    monkeypatch.setattr(queries.models, "time_split", lambda data, *years: (None, None, None))
    for module, name in ((experiments, "walk_forward"), (experiments, "subset_search"), (experiments, "logistic_report"), (experiments, "screen"), (models, "fit_forest"), (models, "fit_logistic")):
        monkeypatch.setattr(module, name, record(name))
    for query in ("e1_walk_forward", "a3_weighted_summary", "e6_subset_search", "e7_report_metrics", "e3_screening", "m4_forest", "m3_logistic"):
        with pytest.raises(InterruptedError):
            queries.QUERIES[query](None, "")
    assert seen.pop("walk_forward") == ((), {})
    assert set(seen) == {"subset_search", "logistic_report", "screen", "fit_forest", "fit_logistic"}
    assert all(call == ((FEATURE_GROUPS["all_features"],), {}) for call in seen.values())


def test_a_reports_metrics_read_predictions_that_are_kept(spark, monkeypatch):
    rows = [(dt.date(y, 1 + i % 12, 1 + i % 28), "L", "A", "B", i % 3, float(i % 7)) for y in (2020, 2023, 2025) for i in range(60)]
    data = spark.createDataFrame(rows, "MatchDate date, League string, HomeTeam string, AwayTeam string, target_label int, HomeShots double")
    monkeypatch.setattr(experiments, "canonical", list)
    monkeypatch.setattr(experiments, "modeling_data", lambda frame, columns: (frame, columns))
    report = experiments.logistic_report(data, ["HomeShots"])
    plan = report["metrics"]._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and len(report["metrics"].collect()) == 6
