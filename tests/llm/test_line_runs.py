import random

import pytest

from foretell.llm import line_runs


def brute(docs, min_lines=3, min_words=8):
    """Longest earlier-seen run from every place, by comparing all pairs of places."""
    keys = sorted({(d, t) for d, t in docs if t is not None}, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    places = [(k, [(i, x) for i, x in enumerate(k[1].split("\n")) if x.strip(" \t\n\x0b\x0c\r")]) for k in keys]
    gone = {k: set() for k in keys}
    flat = [(a, p) for a, (_, lines) in enumerate(places) for p in range(len(lines))]
    for n, (a, p) in enumerate(flat):
        best, mine = 0, places[a][1]
        for b, q in flat[:n]:
            theirs, k = places[b][1], 0
            while p + k < len(mine) and q + k < len(theirs) and mine[p + k][1] == theirs[q + k][1]:
                k += 1
            best = max(best, k)
        if best >= min_lines or best and len(mine[p][1].split()) >= min_words:
            gone[places[a][0]] |= {mine[p + j][0] for j in range(best if best >= min_lines else 1)}
    return {k: "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in gone[k]) for k in keys}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = {r.doc_id: r.text for r in line_runs.dedup_lines(docs).collect()}
    assert got == {d: want[d, t] for d, t in rows}
    assert sum(want[d, t] != t for d, t in rows) > 5


def test_runs_within_and_across(spark):
    rows = [(1, "a b\nc\n\nd\nend"), (2, "x\na b\nc\nd\ny"), (3, "z\nz\nz"), (4, "q"), (5, "q"), (6, "one two three four five six seven eight"), (7, "one two three four five six seven eight\n"), (8, None), (9, ""), (6, "one two three four five six seven eight")]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_lines int")
    got = sorted(((r.doc_id, r.text, r.n_deleted) for r in line_runs.dedup_lines(docs, min_lines=2).collect()), key=str)
    want = [(1, "a b\nc\n\nd\nend", 0), (2, "x\ny", 3), (3, "z", 2), (4, "q", 0), (5, "q", 0), (6, rows[5][1], 0), (7, "", 1), (8, None, 0), (9, "", 0), (6, rows[5][1], 0)]
    # "z z z": the pair at line 2 repeats the pair at line 1 and so covers lines 2 and 3.
    assert got == sorted(want, key=str)
    assert line_runs.dedup_lines(docs.limit(0)).count() == 0


def longest_earlier(docs):
    """For each worded line with an earlier copy, the longest run from there on that also starts earlier."""
    keys = sorted(set(docs))
    flat = [(k, i, [x for x in k[1].split("\n") if x.strip()]) for k in keys for i in range(len([x for x in k[1].split("\n") if x.strip()]))]
    found = {}
    for n, (k, p, mine) in enumerate(flat):
        best = 0
        for _, q, theirs in flat[:n]:
            m = 0
            while p + m < len(mine) and q + m < len(theirs) and mine[p + m] == theirs[q + m]:
                m += 1
            best = max(best, m)
        found[k[0], p] = best
    return found


@pytest.mark.parametrize("seed", range(2))
def test_run_lengths_against_brute_force(spark, seed):
    rng = random.Random(seed)
    blocks = [[rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))] for _ in range(6)]
    rows = [(d, "\n".join(x for _ in range(rng.randrange(0, 7)) for x in rng.choice(blocks) + [f"own {rng.random()}"] * rng.randrange(2))) for d in range(40)]
    rows += [(90, "\n".join(["z"] * 21)), (91, "\n".join(["z"] * 13 + ["y"])), (92, rows[7][1]), (93, rows[7][1])]
    want = longest_earlier(rows)
    shuffled = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r.doc_id, r.pos): r.run for r in line_runs._runs(shuffled).collect()}
    assert got == {k: want[k] for k in got}
    assert all(n == 0 for k, n in want.items() if k not in got)
    assert max(want.values()) >= 20


def test_scans_of_partitions_agree_with_one_scan():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 25)
        places, steps = rng.sample(range(100), n), [0] + [rng.randrange(0, 5) for _ in range(n - 1)]
        whole = line_runs._scan(places, steps, [])
        assert whole == [max([min(steps[j + 1 : i + 1]) for j in range(i) if places[j] < places[i]], default=0) for i in range(n)]
        cut = rng.randrange(0, n)
        own: list = []
        line_runs._scan(places[:cut], steps[:cut], own)
        assert line_runs._scan(places[cut:], steps[cut:], line_runs._joined([], 9, own)) == whole[cut:]
        first: list = []
        line_runs._scan(places[cut:], [0, *steps[cut + 1 :]], first)
        through: list = []
        line_runs._scan(places, steps, through)
        assert line_runs._joined(own, min(steps[cut:]), first) == through


def test_long_runs_are_reported_whole_and_any_length_can_be_asked(spark):
    body = "\n".join(f"line {i}" for i in range(37))
    docs = spark.createDataFrame([(1, body), (2, "head\n" + body + "\ntail"), (None, "alone"), (3, "line 4\nline 5\nline 6\nline 8\nline 9")], "doc_id long, text string")
    runs = line_runs.repeated_runs(docs).collect()
    assert sorted((r.doc_id, r.line, r.run_lines) for r in runs) == [(2, i, 37) for i in range(1, 38)] + [(3, i, 3) for i in range(3)]
    for least, gone in ((2, 5), (3, 3), (4, 0), (38, 0)):
        assert line_runs.repeated_runs(docs.where("doc_id != 2"), least).count() == gone
    # Stopping at pairs would take "line 8, line 9" of document 3 for a run.
    assert {r.doc_id: r.n_deleted for r in line_runs.dedup_lines(docs, min_lines=37).collect()} == {1: 0, 2: 37, 3: 0, None: 0}


def test_a_text_of_very_many_lines_and_clashing_names(spark):
    body = "\n".join(f"entry {i}" for i in range(6000))
    docs = spark.createDataFrame([(1, body, 1, "p"), (2, body + "\nmore", 2, "q"), (3, None, 3, "r"), (4, "", 4, "s")], "doc_id long, text string, place int, __lines string")
    got = {r.doc_id: r for r in line_runs.dedup_lines(docs).collect()}
    assert (got[2].n_deleted, got[2].text, got[2].n_lines, got[1].text) == (6000, "more", 6001, body)
    assert [(got[d]["place"], got[d]["__lines"]) for d in (1, 2, 3, 4)] == [(1, "p"), (2, "q"), (3, "r"), (4, "s")]


def test_a_word_limit_above_512_still_deletes_single_lines(spark):
    line = " ".join(f"w{i}" for i in range(700))
    docs = spark.createDataFrame([(1, f"a\n{line}"), (2, f"b\n{line}\nc")], "doc_id long, text string")
    cut = {n: {r.doc_id: r.n_deleted for r in line_runs.dedup_lines(docs, min_words=n).collect()} for n in (600, 700, 701)}
    assert cut == {600: {1: 0, 2: 1}, 700: {1: 0, 2: 1}, 701: {1: 0, 2: 0}}
