import re
from collections import Counter

import numpy as np
import pytest

from foretell.llm import queries, robust_rules as r


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(repeated)


def brute_verdicts(rows, lines):
    """The same estimates in NumPy, cell by cell; histogram quantiles as documented."""
    bins, d, floors = 32, 5, np.array(list(r.COORDINATES.values()))
    stats = [brute_statistics(t) for _, t, _, _ in rows]
    failed = [w < 50 or 100 * rep > 50 * w for w, _, _, _, rep in stats]
    vector = np.array([[np.log1p(w), c / max(w, 1), np.log1p(100 * s / max(c, 1)), rep / max(w, 1), dup / max(n, 1)] for (w, c, s, dup, rep), n in zip(stats, lines)])
    kept = [False] * len(rows)
    ok = [i for i in range(len(rows)) if not failed[i]]
    quantile = lambda b, q: np.sort(b)[int(np.ceil(q * len(b))) - 1]

    def step(x, centre, scatter):
        d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
        near = np.floor(np.log2(d2 + 1e-9) * bins)
        inside = x[near <= quantile(near, r.SHARE)]
        return inside.mean(axis=0), r.CONSISTENCY * np.cov(inside.T, bias=True).reshape(d, d) + np.diag(floors**2)

    def estimate(x):
        b = np.floor(np.minimum(x, 64) * bins)
        median = np.array([(quantile(b[:, j], 0.5) + 0.5) / bins for j in range(d)])
        spread = np.array([((quantile(b[:, j], 0.75) - quantile(b[:, j], 0.25)) / bins / 1.349) ** 2 for j in range(d)])
        found = [(median, np.diag(spread + floors**2)), (median, np.diag(floors**2)), (x.mean(axis=0), np.cov(x.T, bias=True).reshape(d, d) + np.diag(floors**2))]
        for _ in range(r.FIRST_STEPS):
            found = [step(x, *f) for f in found]
        logdet = lambda f: np.linalg.slogdet(f[1])[1]
        best = min(found, key=logdet)
        trail = [best]
        for _ in range(r.STEPS):
            trail.append(step(x, *trail[-1]))
        return trail

    def cells(key):
        names = sorted({key(i) for i in ok}, key=str)
        return {n: vector[[i for i in ok if key(i) == n]] for n in names}

    # All cells take steps until none of them moves.
    levels = [cells(lambda i: ()), cells(lambda i: (rows[i][2],)), cells(lambda i: (rows[i][2], rows[i][3]))]
    trails = {n: estimate(x) for level in levels for n, x in level.items()}
    det = lambda n, k: np.linalg.slogdet(trails[n][k][1])[1]
    last = next((k for k in range(1, r.STEPS + 1) if all(abs(det(n, k) - det(n, k - 1)) <= r.TOLERANCE for n in trails)), r.STEPS)
    known = {(): trails[()][last]} if ok else {}
    for level in levels[1:]:
        for n, x in level.items():
            w = len(x) / (len(x) + r.PRIOR)
            known[n] = tuple(w * a + (1 - w) * b for a, b in zip(trails[n][last], known[n[:-1]]))
    for i in ok:
        centre, scatter = known[rows[i][2], rows[i][3]]
        diff = vector[i] - centre
        kept[i] = bool(diff @ np.linalg.inv(scatter) @ diff <= r.CUTOFF)
    return stats, failed, kept


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(x.doc_id, x.text, x.lang, x.source) for x in docs.collect()]
    lines = [sum(bool(line.strip(" \t\n\x0b\x0c\r")) for line in t.split("\n")) for _, t, _, _ in rows]
    stats, failed, kept = brute_verdicts(rows, lines)
    want = {row[0]: (*s, f, k) for row, s, f, k in zip(rows, stats, failed, kept)}
    got = {x.doc_id: tuple(x)[1:] for x in queries.op8_quality_rules(spark, f"/root/testdata/{sf}").collect()}
    assert got == want
    assert any(not f and not k for f, k in zip(failed, kept))


def test_odd_rows(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 5000}" for k in range(60 + i)), None if i % 9 == 0 else "en", "s") for i in range(120)]
    odd = [(900, None, "en", "s"), (901, "", None, None), (902, " \n\t ", "en", "s"), (903, "a b c " * 60, "en", "s"), (904, "a\nb\na\n \n \na b", "en", "s"), (905, " ".join(f"{k}####$$$$" for k in range(90)), "en", "s"), (None, good[5][1], "en", "s"), (5, good[5][1], "en", "s"), (906, "x" * 300000 + " y" * 49, "xx", "y")]
    docs = spark.createDataFrame([(*x, 1, True, "m", 2, 3, 4, 5) for x in good + odd], "doc_id long, text string, lang string, source string, n_words int, kept boolean, m0 string, l00 int, __w int, own int, `__h.x` int")
    rows = r.judge(docs).collect()
    assert len(rows) == len(good) + len(odd)
    texts = {x[0]: x[1] for x in good + odd}
    for x in rows:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_statistics(texts[x.doc_id])
    kept = {x.doc_id: x.kept for x in rows}
    assert all(kept[i] for i in range(120)) and kept[None]
    assert [kept[i] for i in (900, 901, 902, 903, 904, 905)] == [False] * 6
    assert {(x.m0, x.l00, x["__w"], x.own, x["__h.x"]) for x in rows} == {("m", 2, 3, 4, 5)}
    assert r.judge(docs.limit(0)).collect() == []
    assert docs.columns[:4] == r.judge(docs).columns[:4]


def test_every_cell_has_estimates_whatever_its_size(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k * k) % 5000}" for k in range(60 + i)), "en", "s") for i in range(100)]
    rows += [(500, " ".join(f"{'#' * 9}{k}{'x' * 50}" for k in range(90)), "en", "alone"), (501, rows[3][1], "en", "single")]
    kept = {x.doc_id: x.kept for x in r.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[500] and kept[501] and all(kept[i] for i in range(100))
