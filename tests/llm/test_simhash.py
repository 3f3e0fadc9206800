import random

import pytest
import xxhash

from foretell.llm import simhash
from foretell.llm.components import connected_components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, prints, radius=2):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def unsigned(x):
    return x & (1 << 64) - 1


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "One two", "A b C d e f", "x " * 5000, "É Z\x0bq r s"])
def test_fingerprint(text):
    assert unsigned(simhash.fingerprint(text)) == brute_fingerprint(text)


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], prints, brute_components([r.doc_id for r in rows], prints)))
    got = sorted((r.doc_id, unsigned(r.fp), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_dense_groups_are_tiled_without_losing_links(spark):
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1}
    while len(prints) < 160:
        x = rng.getrandbits(64) & 0xFFFF if len(prints) < 120 else rng.getrandbits(64)
        prints |= {x, x ^ 1 << rng.randrange(64)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame([(p,) for p in signed], "fp long")
    for tile in (3, 8, 2048):
        roots = {unsigned(r.node): r.root for r in connected_components(simhash.near_links(distinct, 2, tile)).collect()}
        names = brute_components(list(range(len(prints))), prints)
        for i in range(len(prints)):
            for j in range(i):
                assert (names[i] == names[j]) == (roots.get(prints[i], signed[i]) == roots.get(prints[j], signed[j]))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (None, "w " * 9, "c"), (7, "w " * 9, "d"), (7, "w " * 9, "d"), (9, "q r s t u", "e"), (None, "lonely words here", "f")],
        "doc_id long, text string, component_id string",
    )
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 7), (7, 7), (7, 7), (9, 9), (None, None)], key=str)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 7, 9, None], key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(5, 5), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [100, *range(200, 250)]}


def test_rows_are_chosen_and_not_ids(spark):
    docs = spark.createDataFrame([(3, "one text of some words", "a"), (7, "one text of some words", "b"), (7, "quite another thing to say here", "c"), (7, "quite another thing to say here", "d"), (None, "one text of some words", "e")], "doc_id long, text string, fp string")
    kept = simhash.keep_representatives(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, "one text of some words"), (7, "quite another thing to say here")]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_are_found_and_others_stay(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    docs, n = [], 0
    for base in range(60):
        body = [rng.choice(words) for _ in range(rng.choice([30, 200, 900]))]
        docs.append((n, " ".join(body)))
        for copy in range(rng.randrange(4)):
            changed = list(body)
            for _ in range(rng.randrange(1, max(2, len(body) // 12))):
                changed[rng.randrange(len(body))] = rng.choice(words)
            n += 1
            docs.append((n, " ".join(changed)))
        n += 1
    table = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_representatives(table).collect()}
    sets = {d: shingles(t) for d, t in docs}
    near = lambda a, b, least: len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    planted = {d for d in sets if any(e < d and near(d, e, 0.8) for e in sets)}
    lone = {d for d in sets if not any(e != d and near(d, e, 0.75) for e in sets)}
    assert len(planted) > 20 and len(planted & kept) <= 0.1 * len(planted)
    assert lone <= kept


def test_overlap_is_exact():
    rng = random.Random(2)
    for n in (3, 120, 4000):
        a = [f"w{rng.randrange(500)}" for _ in range(n)]
        b = [x if rng.random() > 0.02 else "new" for x in a]
        x, y = (" ".join(w) for w in (a, b))
        true = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
        assert simhash.overlap(*[simhash.wide_shingles(simhash._shingle_hashes(t)) for t in (x, y)]) == pytest.approx(true)


def test_a_link_that_fails_takes_no_other_with_it(spark, monkeypatch):
    """Chains of copies of copies near the limit: every pair above it that meets in a band is connected."""
    monkeypatch.setattr(simhash, "VERIFY_TILE", 5)
    rng = random.Random(23)
    words = [f"w{i}" for i in range(4000)]
    docs = []
    for _ in range(12):
        bases = [[rng.choice(words) for _ in range(300)]]
        for _ in range(11):
            body = list(rng.choice(bases))
            for _ in range(rng.randrange(4, 9)):
                body[rng.randrange(300)] = rng.choice(words)
            bases.append(body)
        docs += [" ".join(b) for b in bases]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_representatives(table).collect()}
    sets = [shingles(t) for t in docs]
    prints = [simhash.fingerprint(t) for t in docs]
    bands = [set(enumerate(simhash._band_keys(simhash.wide_shingles(simhash._shingle_hashes(t))).tolist())) for t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            bits = bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1")
            near = bits <= simhash.WIDE_RADIUS and bands[i] & bands[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if bits <= 2 or near:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert kept == {find(i) for i in range(len(docs))} and 12 < len(kept) < 140
