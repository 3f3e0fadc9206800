"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

from foretell.llm import collocations

SCHEMA = "doc_id long, text string, lang string, source string, path int, n int, above int"


def brute(rows, min_count, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for d in range(1, 5):
                for i in range(len(words) - d + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + d])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < min_count:
                continue
            if any(a_ * 100 >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, a_ in f.items() if len(q) > len(p) and a_ >= min_count):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def test_like_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["of", "the", "Of", "new", "york", "\x01a", "über", "Über", "x\x00y", "a\x1fb", "the of", "日本", "-", "\\"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?"]
    rows = [("".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "fr", None, ""])) for _ in range(120)]
    rows += [(None, "en"), ("", None), (" \t\n", "fr"), ("new york city hall " * 40, "en"), rows[0], rows[0]]
    found = [tuple(r) for r in collocations.collocations(frame(spark, rows), 8, 25).collect()]
    assert sorted(found) == brute(rows, 8, 25)


def test_slices_add_up(spark):
    rows = [("alpha beta gamma delta " * 3, "en")] * 30 + [("alpha beta " * 20_000, "en")]
    want = brute(rows, 30, 100)
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), 30, 100).collect()) == want
    at = [collocations._tokens([t.encode()])[0].tolist() for t in ("a  b.c", "", "..")]
    assert [x.count(-1) for x in at] == [1, 0, 2]


def test_empty(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).collect() == []
    assert collocations.collocations(frame(spark, [(None, None)])).collect() == []
