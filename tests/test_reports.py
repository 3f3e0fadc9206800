"""Reports over given predictions and days: confident ones, folds, views."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest
from foretell.operators import experiments, metrics, models, training
from foretell.plans import oracles, queries

ROWS = [("train", 0, 0.7, 0.2, 0.1), ("train", 1, 0.6, 0.3, 0.1), ("train", 2, 0.4, 0.3, 0.3), ("test", 2, 0.4, 0.35, 0.25)]


@pytest.fixture(scope="module")
def report(spark):
    rows = [(*r, 0.5, 0.3, 0.2) for r in ROWS]
    return {"predictions": spark.createDataFrame(rows, "partition string, y int, p0 double, p1 double, p2 double, dummy_0 double, dummy_1 double, dummy_2 double")}


def test_confident_means_keep_the_priors_of_all_training_rows(report):
    out = experiments.confidence_report(report, 0.6)
    got = {(r.partition, r.outcome): (r.model_probability, r.observed_frequency, r.prior) for r in out["outcomes"].collect()}
    assert got["train", "home"] == (pytest.approx(0.65), 0.5, 0.5) and got["train", "draw"] == (pytest.approx(0.25), 0.5, 0.3)
    # No test row is sure enough: undefined means, but the row and its prior are there.
    assert got["test", "away"] == (None, None, 0.2) and len(got) == 6
    cover = {r.partition: (r.total, r.kept, r.filtered_out, r.accuracy_kept) for r in out["coverage"].collect()}
    assert cover == {"train": (3, 2, 1, 0.5), "test": (1, 0, 1, None)} and out["selected"].count() == 2


def test_without_the_filter_all_rows_count(report):
    out = experiments.confidence_report(report, 1.0, enabled=False)
    got = {(r.partition, r.outcome): r.model_probability for r in out["outcomes"].collect()}
    assert got["train", "home"] == pytest.approx(1.7 / 3) and got["test", "home"] == pytest.approx(0.4)
    assert out["selected"].count() == 4 and {r.kept for r in out["coverage"].collect()} == {1, 3}


@pytest.mark.parametrize("threshold", [-0.1, 1.1, math.nan])
def test_thresholds_outside_probabilities(report, threshold):
    for f in (metrics.confident, lambda r, t: metrics.confidence_outcomes(r, [], t), lambda r, t: metrics.confidence_coverage(r, [], t)):
        with pytest.raises(ValueError, match="threshold"):
            f(report["predictions"], threshold)


def test_folds_against_plain_counting(spark):
    first = dt.date(2020, 1, 1)
    days = [first + dt.timedelta(days=3 * (i // (1 + i % 2))) for i in range(90)]
    data = models.modeling_data(spark.createDataFrame([(d, i % 3, "L") for i, d in enumerate(days)], "MatchDate date, target_label int, League string"), ["League"])[0]
    ordered = sorted(set(days))
    held = ordered[min(int(len(ordered) * 0.85), len(ordered) - 1)]
    got = experiments.fold_table(data, 4).orderBy("fold").collect()
    assert [r.fold for r in got] == [1, 2, 3, 4]
    for r in got:
        assert r.holdout_start == held > r.eval_end and r.train_end == max(d for d in days if d < r.eval_start)
        assert (r.train_rows, r.eval_rows) == (sum(d < r.eval_start for d in days), sum(r.eval_start <= d <= r.eval_end for d in days))
    assert got[0].eval_start == [d for d in ordered if d < held][len([d for d in ordered if d < held]) // 2]
    assert all(a.eval_end < b.eval_start and not any(a.eval_end < d < b.eval_start for d in ordered) for a, b in zip(got, got[1:]))
    with pytest.raises(ValueError):
        experiments.fold_table(data, 0)


def test_view_is_searched_and_marks_the_models_features(spark):
    scores = spark.createDataFrame([("a", 0.1), ("b_elo", 0.2), ("c", 0.3)], "feature string, log_loss_gain double")
    screening = spark.createDataFrame([("a", 0.5, "OK")], "feature string, screen_gini double, screen_status string")
    catalog = spark.createDataFrame([("a", "Form", "an ELO of its own"), ("b_elo", "Rating", ""), ("c", "Table", "x")], "feature string, group string, description string")
    got = {r.feature: (r.in_model, r.group) for r in training.feature_view(scores, screening, catalog, chosen=["a"], text="elo").collect()}
    assert got == {"a": (True, "Form"), "b_elo": (False, "Rating")}


@pytest.mark.parametrize("name", ["p6_date_split", "p13_preview", "e1_folds", "p9_outcomes", "p9_unfiltered", "a3_market_summary", "m9_evaluation"])
def test_query_and_twin_agree(spark, sf_dir, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    told = connection.execute(oracles.ORACLES[name])
    columns = [c[0] for c in told.description]
    frame = queries.QUERIES[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(columns)
    plain = lambda v: None if v is None else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)
    key = lambda row: tuple("" if v is None else str(v) for v in row)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=key)
    theirs = sorted((tuple(map(plain, r)) for r in told.fetchall()), key=key)
    assert ours and len(ours) == len(theirs)
    assert all(a == pytest.approx(b, abs=2e-5) if isinstance(a, float) else a == b for x, y in zip(ours, theirs) for a, b in zip(x, y))
