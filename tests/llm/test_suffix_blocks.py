"""Removed bytes against counting every string of the length."""

import random
from collections import Counter

import numpy as np
import pytest
from foretell.llm import suffix_blocks


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        n_spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])[: len(b)]).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), n_spans, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return out


def cut(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "old", 7) for i, t in enumerate(texts)], "doc_id long, text string, Kept string, `a.b``c` int").repartition(3)
    found = suffix_blocks.remove_repeats(docs, **more)
    assert found.columns == ["doc_id", "text", "a.b`c", "n_bytes", "n_removed", "n_spans", "kept"]
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows]


@pytest.mark.parametrize("q", [2, 3, 5, 7, 13])
def test_difference_cover(q):
    v, cover = suffix_blocks.difference_cover(q)
    assert v == q * q + q + 1 and len(cover) == q + 1
    assert {(i - j) % v for i in cover for j in cover} == set(range(v))


@pytest.mark.parametrize(("length", "q"), [(20, 3), (14, 3), (60, 5)])
def test_like_brute_force(spark, length, q):
    rng = random.Random(length)
    parts = ["".join(rng.choice("ab é日") for _ in range(rng.randrange(1, 3 * length))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "x", "--"]) for _ in range(rng.randrange(0, 5))) for _ in range(60)]
    texts += [None, "", texts[3], texts[3], "a" * (4 * length), "a" * length, "ab" * (2 * length), "z" * (length - 1), "z" * (length - 1), "q" * (length + 1)]
    assert cut(spark, texts, length=length, order=q, block=300, sample_block=500) == brute(texts, length)


def test_blocks_and_periods_do_not_matter(spark):
    rng = random.Random(1)
    core = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    texts = [core, "x" + core[:700] + "y" + core[900:1301] + "z", core[100:499], core[100:500], core[2000:] + core[:450], "k" * 5000] + ["".join(rng.choice("abc") for _ in range(900)) for _ in range(5)]
    want = brute(texts, 400)
    assert cut(spark, texts) == want
    assert cut(spark, texts, block=1000, sample_block=900, order=7) == want
    assert sum(r[1] > 0 for r in want) == 5


def test_held_is_dealt_in_parts():
    held = suffix_blocks._Held(3, 8, 16, True)
    text = b"abcabcabcabcabcabc" * 30
    held.add(b"k" * 16, np.arange(100), suffix_blocks._prints(text, np.arange(100), 9))
    held.add(b"k" * 16, np.arange(100), suffix_blocks._prints(text, np.arange(100), 9))
    rows = [(n, p) for b in held.deal() for n, p in zip(b.column("block").to_pylist(), b.column("packed").to_pylist(), strict=True)]
    known = np.concatenate([suffix_blocks._opened_places(memoryview(p), 16)[2] for n, p in rows if n < 0])
    assert sorted(known.tolist()) == list(range(100))
    opened = [suffix_blocks._opened(p, 8, 16) for n, p in rows if n >= 0]
    assert sum(len(o[2]) for o in opened) == 3 and all(o[4].all() for o in opened)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_blocks.remove_repeats(docs).collect() == []


def test_planted_passages_of_over_fifty_words(spark, tmp_path):
    """The query finds each passage of 400 bytes or more that two documents share, and nothing else; n_bytes tells nothing of it."""
    from foretell.llm.queries import op13_suffix_dedup

    rng = random.Random(4)
    words = lambda n, size: " ".join("".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    long, short = [words(rng.randrange(51, 80), 7) for _ in range(8)], [words(rng.randrange(51, 60), 4) for _ in range(4)]
    texts = [f"{words(40, 6)} {p} {words(40, 6)}" for p in [*long, *short] for _ in range(2)] + [words(140, 6) for _ in range(12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].n_removed > 0 for i in range(len(texts))] == [True] * 16 + [False] * 20
    assert all(0 <= got[i].n_removed - len(long[i // 2]) - 2 < 12 for i in range(16))  # the blanks around it too, and a letter or two by chance
    assert [got[i].n_bytes for i in range(len(texts))] == [len(t) for t in texts]
