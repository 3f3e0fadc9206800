import hashlib
import random
from collections import defaultdict

from foretell.llm import mixing as m


def brute_fill(above, nodes):
    """Hand out ``above`` over [(name, weight, cap)] by raising one level until it is spent."""
    given, open_ = {n: 0.0 for n, _, _ in nodes}, [x for x in nodes if x[1] > 0]
    left = above
    while open_ and left > 1e-9:
        unit = left / sum(w for _, w, _ in open_)
        step = min(unit, min((c - given[n]) / w for n, w, c in open_))
        for n, w, _ in open_:
            given[n] += step * w
        left -= step * sum(w for _, w, _ in open_)
        open_ = [x for x in open_ if x[2] - given[x[0]] > 1e-9]
    return {n: int(g + 1e-6) for n, g in given.items()}


def test_budgets_against_brute_force(spark):
    rng = random.Random(1)
    weights = {"domain": {"a": 3, "b": 1}, "lang": {"x": 5, "y": 2}, "source": {f"s{i}": i for i in range(6)}}
    supply = {(d, la, f"s{i}"): rng.randrange(1, 4000) for d in "abc" for la in "xyz" for i in range(6) if rng.random() < 0.7}
    rows = spark.createDataFrame([(*k, n) for k, n in supply.items()], "domain string, lang string, source string, tokens long")
    weight = lambda level, name: weights[level].get(name, 1)
    for budget in (1000, 60000, 10**7):
        got = {(r.domain, r.lang, r.source): r.budget for r in m.budgets(rows, weights, budget, 2).collect()}
        cap = defaultdict(int)
        for k, n in supply.items():
            if weight("source", k[2]):
                for depth in (1, 2, 3):
                    cap[k[:depth]] += 2 * n
        levels = ["domain", "lang", "source"]

        def go(prefix, above):
            depth = len(prefix)
            if depth == 3:
                assert abs(got[prefix] - above) <= 1
                return
            children = [(k, weight(levels[depth], k[-1]), c) for k, c in cap.items() if len(k) == depth + 1 and k[:depth] == prefix]
            for k, part in brute_fill(above, children).items():
                go(k, part)

        go((), budget)
        assert not any(s == "s0" for _, _, s in got)
        assert sum(got.values()) <= min(budget, cap_total := sum(c for k, c in cap.items() if len(k) == 3)) and sum(got.values()) > min(budget, cap_total) - 60


def test_prefixes_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = m.mix(docs, max_epochs=3)
    got = {(r.doc_id, r.epoch): r.taken_tokens for r in mixed.collect()}
    leaves = defaultdict(list)
    for r in docs.collect():
        n = len(r.text.encode().split())
        if n:
            leaves[f"d{int(r.source[3:]) % 4}", r.lang, r.source].append((r.doc_id, n))
    supply = spark.createDataFrame([(*k, sum(n for _, n in v)) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    weights = {"domain": m.DOMAIN_WEIGHTS, "lang": m.LANGUAGE_WEIGHTS, "source": m.SOURCE_WEIGHTS}
    want = {}
    for r in m.budgets(supply, weights).collect():
        left, epoch = r.budget, 0
        while left > 0:
            whole = left >= r.tokens
            stream = sorted(leaves[r.domain, r.lang, r.source], key=lambda x: hashlib.md5(f"{m.SEED}:{epoch}:{x[0]}".encode()).hexdigest())
            for d, n in stream:
                if left > 0:
                    want[d, epoch] = min(n, left)
                    left -= want[d, epoch]
            epoch += whole
    assert got == want
    assert max(e for _, e in got) >= 1


def test_odd_rows(spark):
    rows = [(1, "a b c", "en", "s1", 0), (1, "a b c", "en", "s1", 0), (None, "d e", None, None, 0), (3, None, "en", "s1", 0), (4, "", "en", "s1", 0), (5, "w " * 200000, "de", "x9999999999", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    out = m.mix(docs, budget=10**9, max_epochs=2).collect()
    assert len(out) == 8 and sum(r.taken_tokens for r in out) == 2 * (3 + 3 + 2 + 200000)
    assert {r.domain for r in out} == {"d1", "other", "d3"}
    assert sum(r.taken_tokens for r in m.mix(docs, budget=5).collect()) <= 5
    assert m.mix(docs.limit(0)).collect() == [] and m.mix(docs, budget=0).collect() == []
    assert m.mix(docs).columns == ["doc_id", "text", "lang", "source", "domain", "epoch", "n_tokens", "taken_tokens"]


def test_columns_of_any_name_are_returned_as_they_are(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = {c: docs["doc_id"] * 2 for c in ("rest", "epochs", "key", "bucket", "taken", "own", "h", "id", "path", "n", "__hot")}
    rows = m.mix(docs.withColumns(extra)).collect()
    assert all(r[c] == 2 * r.doc_id for r in rows for c in extra)
    assert sorted((r.doc_id, r.epoch, r.taken_tokens) for r in rows) == sorted((r.doc_id, r.epoch, r.taken_tokens) for r in m.mix(docs).collect())


def test_repeated_ids_are_ordered_by_text(spark):
    docs = spark.createDataFrame([(None if i % 2 else 1, " ".join(["w"] * (1 + i)), "en", "s1") for i in range(40)], "doc_id long, text string, lang string, source string")
    rows = m.mix(docs, budget=300).collect()
    assert sum(r.taken_tokens for r in rows) == 300 and sum(r.taken_tokens < r.n_tokens for r in rows) <= 1


def test_rounds_end_when_few_rows_are_left(spark, sf_dir, monkeypatch):
    """Every round costs the driver two plans; the copies are the same with one round as with all."""
    docs, made, whole = spark.read.parquet(f"{sf_dir}/documents.parquet"), [], m.checkpointed
    monkeypatch.setattr(m, "checkpointed", lambda df: made.append(df) or whole(df))
    columns = ["doc_id", "epoch", "n_tokens", "taken_tokens"]
    few = sorted(map(tuple, m.mix(docs).select(columns).collect()))
    assert few and len(made) == 5
    monkeypatch.setattr(m, "SORTED_ROWS", 0)
    assert sorted(map(tuple, m.mix(docs).select(columns).collect())) == few
    assert len(made) == 5 + 3 + 2 * len(m.ROUNDS)
