import random
import time

import pytest
from pyspark.sql import functions as F

from foretell.llm import queries, token_counts
from foretell.llm.token_counts import Tree, encoder

BITS = ["word", " ", "  ", "\n", "\n\n", "\t", "'ll", "'", " 12", "é", "\u00a0", "\x1c", "🙂", ", ", "x" * 300, " " * 40, ""]


@pytest.fixture(scope="module")
def encoding():
    return encoder(token_counts.VOCABULARY)


def checked(tree: Tree, text: str, encoding) -> None:
    assert tree.tokens == len(encoding.encode_ordinary(text))
    assert sum(n[1] for n in tree.levels[0]) == len(text)
    for below, level in zip(tree.levels, tree.levels[1:]):
        at = 0
        for children, chars, tokens in level:
            part = below[at : at + children]
            assert (chars, tokens) == (sum(n[1] for n in part), sum(n[2] for n in part))
            at += children
        assert at == len(below)


def test_random_edits_against_full_counts(encoding):
    rng = random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice(BITS) for _ in range(rng.choice([0, 3, 200, 4000])))
        tree = Tree.build(text, encoding)
        checked(tree, text, encoding)
        for _ in range(12):
            at, n = rng.randint(0, len(text) + 2), rng.choice([0, 1, 2, 30, 3000])
            new = "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 2, 600])))
            want = text[: min(at, len(text))] + new + text[min(at, len(text)) + n :]
            text, _ = tree.edit(text, at, n, new, encoding)
            assert text == want
            checked(tree, text, encoding)


def test_a_small_edit_encodes_little_of_a_long_text(encoding):
    text = "some words of a long text. " * 40000
    tree = Tree.build(text, encoding)
    _, encoded = tree.edit(text, 500_000, 4, "other", encoding)
    assert encoded < 3 * token_counts.LEAF


def test_edits_of_a_very_long_text_take_little_time(encoding):
    text = "some words of a long text. " * 800_000
    tree = Tree.build(text, encoding)
    began = time.time()
    for k in range(3000):
        _, encoded = tree.edit(text, 7001 * k, 4, "word", encoding)
        assert encoded < 3 * token_counts.LEAF
    assert time.time() - began < 60
    assert tree.height <= 6 and sum(n[1] for n in tree.levels[0]) == len(text)


def test_tables(spark, encoding):
    rows = [(1, "one two three", "a"), (2, None, "b"), (3, "", "c"), (None, "lost", "d"), (1, "one two three", "a"), (4, "long " * 5000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tree string")
    log = [(1, 1, 0, 0, "x "), (1, 0, 3, 4, None), (2, 0, 0, None, "new"), (3, None, None, 9, "w"), (9, 0, 0, 0, "none"), (None, 0, 0, 4, "")]
    log = spark.createDataFrame(log, "doc_id long, seq int, at int, n_deleted int, inserted string")
    got = token_counts.recount(token_counts.with_edits(token_counts.index(docs), log)).collect()
    texts = sorted((r.doc_id or 0, r.text_edited) for r in got)
    assert texts == [(0, "lost"), (1, "x one three"), (1, "x one three"), (2, "new"), (3, "w"), (4, "long " * 5000)]
    for r in got:
        assert r.n_tokens_edited == len(encoding.encode_ordinary(r.text_edited))
        assert r.n_chars_edited == len(r.text_edited)
        checked(Tree(r.tree_edited), r.text_edited, encoding)
    assert token_counts.recount(token_counts.with_edits(token_counts.index(docs.limit(0)), log)).count() == 0


def test_query_counts_whole_texts(spark, sf_dir, encoding):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op6_token_counts(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    places = {r.doc_id: r.h for r in spark.createDataFrame([(d,) for d in docs], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for r in got:
        text = docs[r.doc_id]
        assert r.n_tokens == len(encoding.encode_ordinary(text))
        at, size = places[r.doc_id] % (len(text) + 1), len(text)
        text = "Note: " + text[:at] + " [edited]" + text[at + 5 :]
        text = text[: size + 6] + text[size + 18 :]
        assert (r.n_tokens_edited, r.n_chars_edited) == (len(encoding.encode_ordinary(text)), len(text))
