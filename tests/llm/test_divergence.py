"""Source divergence against a plain computation over all terms."""

import random
import re
from collections import Counter

from foretell.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term int, n int"


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [(s, w) for l, s, w in docs if l == lang]
        kept = {t for t, n in Counter(t for _, w in mine for t in set(w)).items() if n >= min_docs}
        by = {s: Counter() for s, _ in mine}
        for s, w in mine:
            by[s].update(t for t in w if t in kept)
        v, whole = len(kept), sum(by.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v)
        for s, c in by.items():
            pairs = [(-sum(abs(share(c, t) - share(o, t)) for t in kept), x.encode()) for x, o in by.items() if x != s]
            terms = [(share(whole, t) - share(c, t), t.encode()) for t in kept if c[t] and share(c, t) > share(whole, t)]
            out += [(lang, s, "pair", x.decode(), -n, i + 1) for i, (n, x) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", x.decode(), -n, i + 1) for i, (n, x) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def audit(spark, rows, *more):
    docs = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(docs, *more).collect())


def rows_of(rng, n):
    vocabulary = ["the", "The", "über", "Über", "a1b", "x\x00y", "日本", "naïve", "q-r", "zebra", "İ", "rare"]
    return [(" ".join(rng.choice(vocabulary[: rng.randrange(2, 13)]) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", None])) for _ in range(n)]


def test_like_brute_force(spark):
    rows = rows_of(random.Random(3), 150)
    rows += [(None, "en", "only null"), ("", "xx", "a"), ("12 34", "xx", None), ("word", "yy", "alone"), rows[0], rows[0]]
    assert audit(spark, rows, 6, 5) == brute(rows, 6, 5)


def test_stretches_of_terms(spark):
    rows = rows_of(random.Random(4), 80)
    counted = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], SCHEMA)
    parts = [b for r in rows for b in divergence._counted(iter(divergence.pa.Table.from_pydict({"lang": [r[1]], "source": [r[2]], "text": [r[0]]}).to_batches()))]
    table = divergence.pa.Table.from_batches(parts).sort_by([("lang", "ascending"), ("term", "ascending")])
    query = divergence._KEEP.format(min_docs=3)
    want = sorted(map(str, divergence._queried(query, table).to_pylist()))
    for stretch in (7, 60):
        divergence.STRETCH, before = stretch, divergence.STRETCH
        try:
            found = [r for b in divergence._by_term(query, divergence._SUM)(iter(table.to_batches(max_chunksize=5))) for r in b.to_pylist()]
        finally:
            divergence.STRETCH = before
        assert sorted(map(str, found)) == want
    assert counted.count() == 80


def test_empty(spark):
    assert audit(spark, []) == []
    assert audit(spark, [("too rare", "en", "a"), (None, "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
