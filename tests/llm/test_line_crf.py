import zlib
from itertools import product

import numpy as np
import pytest

from foretell.llm import line_crf as c
from foretell.llm import queries


def brute_marginals(emission, pair):
    """P(good) of every line by summing over all labellings."""
    weight = {y: np.exp(sum(e * v for e, v in zip(emission, y)) + sum(pair[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=len(emission))}
    return [sum(w for y, w in weight.items() if y[t]) / sum(weight.values()) for t in range(len(emission))]


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    lengths, features = [3, 1, 6, 2, 6], rng.normal(size=(18, 2))
    field = c.Field(rng.normal(size=2), rng.normal(size=(2, 2)))
    got, at = field.marginals(features, c.Chains(lengths)), 0
    for n in lengths:
        assert np.allclose(got[at : at + n], brute_marginals(features[at : at + n] @ field.weights, field.pair))
        at += n


def test_slope_against_differences():
    rng = np.random.default_rng(1)
    chains, features, labels = c.Chains([3, 1, 4]), rng.normal(size=(8, 3)), np.array([1, 0, 0])
    field = c.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    placed = chains.by_place(features)
    _, slope, pairs = c.loss_and_slope(field, placed, chains, labels)
    loss = lambda w, p: c.loss_and_slope(c.Field(w, p), placed, chains, labels)[0]
    for i in range(3):
        d = np.eye(3)[i] * 1e-6
        assert slope[i] == pytest.approx((loss(field.weights + d, field.pair) - loss(field.weights - d, field.pair)) / 2e-6, abs=1e-6)
    for a, b in product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[a, b] = 1e-6
        assert pairs[a, b] == pytest.approx((loss(field.weights, field.pair + d) - loss(field.weights, field.pair - d)) / 2e-6, abs=1e-6)


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op7_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [(rows[x.doc_id], x.quality) for x in labels if rows[x.doc_id].held_out]
    for quality in (0, 1):
        mine = [r.predicted == quality for r, q in held if q == quality]
        assert sum(mine) >= 0.9 * len(mine)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.3), (2, "", 0.3), (None, "A line.\nAnother line here.", 0.3), (3, "x " * 400000, 0.3), (3, "### $$$ \U0001f600" * 9, 0.3), (4, "\n" * 5000, 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 0, None), (None, 1, 1), (2, None, 0), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for field in (c.train(docs, labels), c.train(docs, labels.limit(0))):
        rows = c.score(docs, field).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert {round(r.score, 6) for r in rows} == {0.5}
    assert c.score(docs.limit(0), field).collect() == []


def test_only_usable_labels_count(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    one = c.train(docs, labels)
    spoiled = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 1, 1 - quality, quality) AS quality")
    assert np.allclose(one.weights, c.train(docs, spoiled).weights)


def test_a_bad_block_in_a_good_text_is_labelled_line_by_line(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = c.train(docs, labels)
    rows = [r for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    junk = next(r.text for r in rows if r.quality == 0 and "###" in r.text and r.text.count("\n") >= 4).split("\n")[:5]
    seen = 0
    for r in rows:
        lines = r.text.split("\n")
        if r.quality == 1 and len(lines) >= 6:
            good, _, _ = field.lines(["\n".join([*lines[:3], *junk, *lines[3:]])])
            seen += 1
            assert [bool(g >= 0.5) for g in good[:3]] + [bool(g >= 0.5) for g in good[8:]] == [True] * len(lines)
            assert not (good[3:8] >= 0.5).any()
    assert seen >= 3


def test_constraints_hold_and_cost_nothing_where_they_hold_already():
    rng = np.random.default_rng(4)
    lengths, width = [4, 1, 7, 3], len(c.line_features("a")[0][0])
    features = np.abs(rng.normal(size=(15, width)))
    chains, labels = c.Chains(lengths), np.array([1, 1, 0, 0])
    field = c.Field(rng.normal(size=width) / 4, np.zeros((2, 2)))
    placed = chains.by_place(features)
    plain, bound = placed @ field.weights, c.constrained(field, placed, chains, labels)
    length = np.expm1(10 * placed[:, c._SIZE]) + 1
    good = 1 / (1 + np.exp(-bound))
    for k, y in enumerate(labels[chains.order]):
        mine = chains.rank == k
        share = (good[mine] * length[mine]).sum() / length[mine].sum()
        assert share >= c.GOOD_SHARE - 1e-9 if y else share <= c.BAD_SHARE + 1e-9
        was = ((1 / (1 + np.exp(-plain[mine]))) * length[mine]).sum() / length[mine].sum()
        assert not (was >= c.GOOD_SHARE if y else was <= c.BAD_SHARE) or np.allclose(bound[mine], plain[mine])


def test_parts_of_a_long_text_have_the_features_of_the_whole():
    text = "\n".join(f"line {i % 7} of ### {'x' * (i % 5)}!" for i in range(53))
    whole, sizes = c.line_features(text)
    parts = list(c.line_parts(text, 10))
    assert np.array_equal(np.vstack([x for x, _ in parts]), whole) and np.array_equal(np.concatenate([n for _, n in parts]), sizes)
    assert c.Field(np.ones(whole.shape[1]) / 9, np.eye(2)).scores(["\n" * 400000])[0] <= 1
