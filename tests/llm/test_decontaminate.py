import random
import re

import numpy as np

from foretell.llm import decontaminate as d


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_scores(index_rows, passage):
    """BM25 of a passage's distinct word pairs against every piece, without an index."""
    pairs = set(zip(passage, passage[1:]))
    return {(r.item_id, r.piece): sum(x for t, x in zip(r.terms, r.impacts) if tuple(t.split(" ")) in pairs) for r in index_rows}


def test_wand_returns_all_pieces_over_the_threshold(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(120)]
    rows = d.postings(d.pieces(spark.createDataFrame(items, "item_id long, text string"))).collect()
    for r in rows:
        assert abs(sum(r.impacts) - 1) < 1e-9
    index = d.Index(rows)
    number = {w: i for i, w in enumerate(index.words.to_pylist())}
    for threshold in (0.05, 0.2, 0.5):
        for _ in range(15):
            passage = [rng.choice(vocabulary) for _ in range(rng.randrange(2, 60))] + words(rng.choice(items)[1])[: rng.randrange(20)]
            keys = {number[a] * len(number) + number[b] for a, b in zip(passage, passage[1:]) if a in number and b in number}
            got = index.search(np.flatnonzero(np.isin(index.keys, list(keys))).tolist(), threshold)
            want = {k: x for k, x in brute_scores(rows, passage).items() if x >= threshold - 1e-9}
            assert {index.items[n]: round(x, 9) for n, x in got} == {k: round(x, 9) for k, x in want.items()}


def test_whole_table_against_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = d.postings(d.pieces(items)).collect()
    triples = lambda x: {tuple(x[i : i + 3]) for i in range(len(x) - 2)} or {tuple(x)}
    want = {}
    for doc in docs.collect():
        text = words(doc.text)
        for a in range(0, max(1, len(text) - 64), 64):
            passage = text[a : a + 128]
            held = set().union(*(zip(*(passage[o:] for o in range(k))) for k in (1, 2, 3)))
            scores = brute_scores(rows, passage)
            for r in rows:
                shares = [len(p & held) / len(p) for p in (triples(r.words[: r.cut]), triples(r.words[r.cut :]))]
                if scores[r.item_id, r.piece] >= 0.5 and min(shares) >= 0.5:
                    key = doc.doc_id, r.item_id
                    want[key] = max(want.get(key, 0), round(scores[r.item_id, r.piece], 9))
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in d.contaminated(docs, items).collect()}
    assert got == want and len(want) >= 3
    # Every item that stands in a text as it is, is found.
    for i in items.collect():
        for doc in docs.collect():
            if i.text.lower() in doc.text.lower():
                assert (doc.doc_id, i.item_id) in got
    clean = {r.doc_id for r in d.drop_contaminated(docs, items).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {k[0] for k in got}


def test_odd_rows(spark, monkeypatch):
    long_item = " ".join(f"word{i} next{i % 7}" for i in range(150))
    items = spark.createDataFrame([(1, "What is the tall tower of Paris called today", "the Eiffel tower of course"), (2, None, None), (3, "too short", None), (4, long_item, None), (1, "What is the tall tower of Paris called today", "the Eiffel tower of course"), (None, "a nameless item has words as well as any", None)], "item_id long, text string, answer string")
    hit = "So: WHAT is the tall tower of Paris, called today?! The Eiffel\ntower -- of course."
    docs = spark.createDataFrame(
        [(1, hit, 1), (2, None, 2), (3, "", 3), (None, hit, 4), (5, "what is the tall tower of paris called today", 5), (6, "x y " * 30000 + hit, 6), (7, "pre " * 99 + long_item, 7), (8, "too short", 8), (9, "a nameless item has words as well as any", 9)],
        "doc_id long, text string, score long",
    )
    want = {(1, 1), (None, 1), (6, 1), (7, 4), (9, None), (8, 3)}  # 5 has the question but not the answer
    for shard in (d.SHARD_POSTINGS, 60):
        monkeypatch.setattr(d, "SHARD_POSTINGS", shard)
        assert {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()} == want
        kept = d.drop_contaminated(docs, items)
        assert kept.columns == docs.columns and sorted(r.score for r in kept.collect()) == [2, 3, 5]
    assert d.contaminated(docs, items.limit(0)).collect() == []
    assert d.contaminated(docs.limit(0), items).collect() == []


def test_short_items_and_scripts_without_blanks(spark):
    chinese, thai = "中国的首都是哪里?北京是中国的首都,人口超过两千万人。", "เมืองหลวงของประเทศไทยคือกรุงเทพมหานคร"
    items = spark.createDataFrame([(1, chinese), (2, thai), (3, "one two three four"), (4, "Yes!"), (5, "日本")], "item_id long, text string")
    docs = [(1, f"前言。{chinese}后记。"), (2, f"ก {thai} ข"), (3, "so one, two: three FOUR and on"), (4, "one two four three"), (5, "yes"), (6, "yes and no"), (7, "中国的河流很长"), (8, "日本の首都"), (9, "two three four")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.contaminated(table, items).collect()} == {(1, 1), (2, 2), (3, 3), (5, 4), (8, 5)}
    assert sorted(r.doc_id for r in d.drop_contaminated(table, items).collect()) == [4, 6, 7, 9]
