"""Frequent phrases whose parts are rarer elsewhere, from count tries of limited depth.

Every slice of texts becomes a trie of counts: a node is a phrase of up to four
words that occurs in one piece of a text. A phrase is no more frequent than the
phrases inside it, so tries are grown only over phrases whose parts are
frequent in the whole corpus. Which words are is known from their counts; pairs
and then longer phrases are counted by fingerprints of 40 bits, in blocks that
are sorted one at a time. All come back as bitmaps of fixed size, which may let
rare ones through, never keep frequent ones out: what passes is counted exactly. The nodes of a
slice leave it in sorted order. They are dealt out by prefix range, the sorted
runs of all slices are merged, and equal nodes are summed.

In the merged trie the parts of a phrase are other nodes. Walking it in order
keeps the path from the root at hand, whose counts are those of the left parts.
Suffix links lead from a phrase to the phrase without its first word; walking
the trie of reversed paths, where suffix links are the parents, gives the right
parts. A walk is over ranges of the order, so a word that begins many phrases
is cut like any others; of the path to a range's first node at most three
counts come from other ranges, and these few are looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretell.llm.bitmaps import bitmap, maybe_in
from foretell.llm.common import checkpointed, slices

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
#: A candidate goes where a longer one has this share of its count or more.
COVERED = 80
#: Bytes of text in one trie, and in one block of fingerprints.
SLICE = 4 << 20
BLOCK = 64 << 20
_PIECE_END = b".,;:!?\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _PIECE_END + b"\t", bytes(range(97, 123)) + b"\n" * len(_PIECE_END) + b" ")
_NODES = "lang string, phrase binary, n long"


def _hash(lang: str, phrase: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\n" + phrase)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers of all texts in a row, -1 where a piece or text ends, and the words."""
    joined = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ")
    coded = pa.array(joined.split(b" "), pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    numbers = np.arange(len(words))
    numbers[[i for i, w in enumerate(words) if w == b"\n"]] = -1
    at = numbers[coded.indices.to_numpy()]
    if b"" in words:
        at = at[at != words.index(b"")]
    return at, words


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    return np.array([_hash(lang, w) for w in words], np.uint64)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words from those of the words."""
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ (second << np.uint64(31) | second >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grown(at: np.ndarray, hashes: np.ndarray, frequent: list[np.ndarray], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, positions, hashes) of the phrases in pieces, level by level from pairs on.

    ``frequent`` has bitmaps of words, pairs and longer phrases, as far as they
    are known. A phrase grows by a word where the phrase from its second word
    on, one word shorter, is there too.
    """
    good = np.append(maybe_in(frequent[0], hashes), False)[at]  # -1: a piece's end
    begins = np.flatnonzero(good[:-1] & good[1:])
    grown = _pair_hashes(hashes[at[begins]], hashes[at[begins + 1]])
    for d in range(2, depth + 1):
        if d > 2:
            next_to = np.flatnonzero(np.diff(begins) == 1)
            begins, grown = begins[next_to], grown[next_to]
            grown = _pair_hashes(grown, hashes[at[begins + d - 1]])
        known = frequent[min(d - 1, 2)] if min(d - 1, 2) < len(frequent) else None
        if known is not None:
            kept = maybe_in(known, grown)
            begins, grown = begins[kept], grown[kept]
        yield d, begins, grown


def _trie(lang: str, texts: list[bytes], frequent: list[np.ndarray], depth: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(phrases, counts) of the levels from pairs down to ``depth`` of one slice's trie."""
    at, words = _tokens(texts)
    node, names = at, words
    for d, begins, _ in _grown(at, _word_hashes(lang, words), frequent, depth):
        if not len(begins):
            return
        keys, node_of, counts = np.unique(node[begins] * len(words) + at[begins + d - 1], return_inverse=True, return_counts=True)
        names = [names[k // len(words)] + b" " + words[k % len(words)] for k in keys.tolist()]
        node = np.zeros(len(at), np.int64)
        node[begins] = node_of
        yield names, counts


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of a batch by language, about SLICE bytes of them at a time."""
    for part in slices(batch, "text", SLICE):
        texts = pc.fill_null(part.column("text"), "").cast(pa.binary())
        langs = pc.fill_null(part.column("lang"), "und").to_numpy(zero_copy_only=False)
        for lang in np.unique(langs.astype(object)).tolist() if len(langs) else []:
            yield lang, texts.filter(pa.array(langs == lang)).to_pylist()


def _batches(found: Iterator[tuple[str, list[bytes], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, phrases, counts in found:
        order = np.argsort(np.array(phrases, object)) if len(phrases) > 1 else np.arange(len(phrases))
        for i in range(0, len(order), 1 << 16):
            part = order[i : i + (1 << 16)]
            part = part[counts[part] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([phrases[j] for j in part], pa.binary()), pa.array(counts[part], pa.int64())], ["lang", "phrase", "n"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first level: words, and all of them under the empty word."""
    for batch in batches:
        for lang, texts in _slices(batch):
            at, words = _tokens(texts)
            counts = np.bincount(at[at >= 0], minlength=len(words))
            yield from _batches([(lang, [*words, b""], np.append(counts, counts.sum()))])


def _print_rows(frequent: list[Broadcast], depths: tuple[int, ...], blocks: int) -> Callable:
    """Levels by fingerprints: 5 bytes and a count for each phrase of a slice, dealt out in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in frequent]
        for batch in batches:
            for lang, texts in _slices(batch):
                at, words = _tokens(texts)
                found = [grown for d, _, grown in _grown(at, _word_hashes(lang, words), known, max(depths)) if d in depths]
                prints, counts = np.unique(np.concatenate(found), return_counts=True)
                block = ((prints >> np.uint64(40)) % np.uint64(blocks)).astype(np.int32)
                order = np.argsort(block, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0])) if len(order) else []
                packed = []
                for part in np.split(order, starts[1:]) if len(order) else []:
                    prefix = prints[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    packed.append(np.ascontiguousarray(prefix).tobytes() + np.ascontiguousarray(counts[part].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(block[order][starts] if len(order) else [], pa.int32()), pa.array(packed, pa.binary())], ["block", "packed"])

    return run


def _print_sums(min_count: int) -> Callable:
    """Fingerprints with a count of ``min_count`` or more, one block after another."""

    def summed(parts: list[bytes]) -> pa.RecordBatch:
        sizes = [len(p) // 9 for p in parts]
        prints = np.zeros((sum(sizes), 8), np.uint8)
        prints[:, :5] = np.concatenate([np.frombuffer(p, np.uint8, 5 * n).reshape(-1, 5) for p, n in zip(parts, sizes, strict=True)])
        counts = np.concatenate([np.ascontiguousarray(np.frombuffer(p, np.uint8, 4 * n, 5 * n).reshape(4, -1).T).reshape(-1).view("<u4") for p, n in zip(parts, sizes, strict=True)])
        prints = prints.reshape(-1).view("<u8")
        order = np.argsort(prints)
        prints = prints[order]
        starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        sums = np.add.reduceat(counts[order].astype(np.int64), starts)
        return pa.RecordBatch.from_arrays([pa.array(prints[starts][sums >= min_count].astype(np.int64))], ["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if parts and block != now:
                    yield summed(parts)
                    parts = []
                now = block
                parts.append(packed)
        if parts:
            yield summed(parts)

    return run


def _phrase_rows(frequent: list[Broadcast], depth: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in frequent]
        for batch in batches:
            for lang, texts in _slices(batch):
                for phrases, counts in _trie(lang, texts, known, depth):
                    yield from _batches([(lang, phrases, counts)])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged runs in, one row a node out; a node's rows stand together, also across batches."""
    lang = phrase = None
    n = 0
    for batch in batches:
        langs, phrases, counts = batch.column("lang"), batch.column("phrase"), batch.column("n").to_numpy()
        if not len(counts):
            continue
        differs = np.ones(len(counts), bool)
        differs[1:] = ~(pc.and_(pc.equal(langs[1:], langs[:-1]), pc.equal(phrases[1:], phrases[:-1])).to_numpy(zero_copy_only=False))
        starts = np.flatnonzero(differs)
        sums = np.add.reduceat(counts, starts)
        langs, phrases = langs.take(pa.array(starts)), phrases.take(pa.array(starts))
        if (langs[0].as_py(), phrases[0].as_py()) == (lang, phrase):
            sums[0] += n
        elif phrase is not None:
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([phrase], pa.binary()), pa.array([n], pa.int64())], ["lang", "phrase", "n"])
        lang, phrase, n = langs[-1].as_py(), phrases[-1].as_py(), int(sums[-1])
        yield pa.RecordBatch.from_arrays([langs[:-1], phrases[:-1], pa.array(sums[:-1], pa.int64())], ["lang", "phrase", "n"])
    if phrase is not None:
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([phrase], pa.binary()), pa.array([n], pa.int64())], ["lang", "phrase", "n"])


def _ranged(bounds: list[tuple[str, bytes]]) -> Callable:
    """The prefix range of each node: how many bounds are not above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A slice's nodes come sorted by phrase within one language, so the ranges are steps.
            langs = np.array(batch.column("lang").to_pylist(), object)
            at = np.zeros(batch.num_rows, np.int32)
            phrases = np.array(batch.column("phrase").to_pylist(), object)
            for i in np.unique(np.concatenate([[0], np.flatnonzero(langs[1:] != langs[:-1]) + 1])).tolist() if len(langs) else []:
                same = langs == langs[i]
                mine = np.array([p for lang, p in bounds if lang == langs[i]] or [None], object)
                at[same] = sum(lang < langs[i] for lang, _ in bounds) + (np.searchsorted(mine, phrases[same], "right") if mine[0] is not None else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "range"])

    return run


def _merged(nodes: DataFrame, bounds: list[tuple[str, bytes]]) -> DataFrame:
    """Equal nodes of all slices summed, range by range of their order; only those of MIN_COUNT or more stay."""
    dealt = nodes.mapInArrow(_ranged(bounds), _NODES + ", range int").repartition("range").drop("range")
    return dealt.sortWithinPartitions("lang", "phrase").mapInArrow(_sums, _NODES)


def _bounds(nodes: DataFrame, ranges: int) -> list[tuple[str, bytes]]:
    """The first node of each of ``ranges`` equal ranges of the nodes in order: as many rows as ranges, whatever the nodes."""
    if ranges < 2:
        return []
    dealt = nodes.select("lang", "phrase").repartitionByRange(ranges, "lang", "phrase")
    least = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("lang", "phrase")).alias("least"))
    return sorted((r["least"]["lang"], bytes(r["least"]["phrase"])) for r in least.collect())[1:]


def _frequent(nodes: DataFrame) -> Broadcast:
    """The bitmap of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_hash(lang, p) for lang, p in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64))], ["hash"])

    return bitmap(nodes.select("lang", "phrase").mapInArrow(run, "hash long"))


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH) -> DataFrame:
    """Every phrase of up to ``depth`` words with ``min_count`` occurrences or more: lang, phrase (binary), n; the empty phrase has all words.

    Null texts are empty and a null language is ``und``; repeated rows count
    each time; other columns are not looked at. Only ``text`` and ``lang`` are
    read, once for words, twice for fingerprints and once for phrases.
    """
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    enough = (F.col("n") >= min_count) | (F.length("phrase") == 0)
    # Words have no level before them to take bounds from; their sums are a plain aggregate.
    words = checkpointed(texts.mapInArrow(_word_rows, _NODES).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(enough))
    if depth < 2:
        return words
    frequent = [_frequent(words.where(F.length("phrase") > 0))]
    size = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = max(ranges, -(-size // BLOCK))
    for depths in [(2,), tuple(range(3, depth + 1))]:
        if depths:
            dealt = texts.mapInArrow(_print_rows(frequent, depths, blocks), "block int, packed binary").repartition("block").sortWithinPartitions("block")
            frequent.append(bitmap(dealt.mapInArrow(_print_sums(min_count), "hash long")))
    phrases = _merged(texts.mapInArrow(_phrase_rows(frequent, depth), _NODES), _bounds(words, ranges)).where(enough)
    return words.unionByName(phrases)


def _walk(path: str, known: dict) -> Callable:
    """Counts of the nodes above each node, in order of the path; ``known`` has those above the first node of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[tuple, int]] = []
        for batch in batches:
            above = []
            for lang, words, n in zip(batch.column("lang").to_pylist(), batch.column(path).to_pylist(), batch.column("n").to_pylist(), strict=True):
                at = [(lang, *words[:k]) for k in range(1, len(words) + 1)]
                while stack and stack[-1][0] != at[min(len(stack), len(at)) - 1]:
                    stack.pop()
                for k in range(len(stack), len(words) - 1):
                    stack.append((at[k], known[at[k]]))
                above.append([m for _, m in stack[: len(words) - 1]])
                stack = [*stack[: len(words) - 1], (at[-1], n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above, pa.list_(pa.int64()))], [*batch.schema.names, "above"])

    return run


def _above(nodes: DataFrame, path: str, name: str) -> DataFrame:
    """``nodes`` with the counts of the nodes above them in the trie of ``path``, one to all words but the last."""
    ordered = checkpointed(nodes.repartitionByRange("lang", path).sortWithinPartitions("lang", path))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next((b for b in batches if b.num_rows), None)
        if head is not None:
            yield head.slice(0, 1)

    # One row a range is collected, and at most DEPTH - 1 nodes for each.
    heads = ordered.select("lang", path).mapInArrow(first, ordered.select("lang", path).schema).collect()
    wanted = sorted({(r["lang"], *r[path][:k]) for r in heads for k in range(1, len(r[path]))})
    known = {}
    if wanted:
        asked = ordered.sparkSession.createDataFrame([(w[0], list(w[1:])) for w in wanted], "lang string, asked array<binary>")
        hit = ordered.select("lang", path, "n").join(F.broadcast(asked.withColumnRenamed("asked", path)), ["lang", path])
        known = {(r["lang"], *r[path]): r["n"] for r in hit.collect()}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", above array<long>"
    return ordered.mapInArrow(_walk(path, known), schema).withColumnRenamed("above", name)


def _words(phrase: Column) -> Column:
    """The words of a phrase as binaries; bytes stay as they are."""

    @F.pandas_udf("array<binary>")
    def split(phrases):
        return phrases.map(lambda p: p.split(b" "))

    return split(phrase)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases of 2 to 4 words by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    Words are runs of anything but blanks and tabs inside pieces, which end at
    sentence marks and line ends; A-Z are folded. Of a phrase that occurs a
    times, the cut after k words leaves parts of l and r occurrences and scores
    floor(2000000 a / (l + r)). Phrases inside a longer candidate with four
    fifths of their count are left out. Null texts are empty, a null language
    is ``und``, repeated rows count each time; ties are broken by score, a and
    phrase; an empty table has no rows. Other columns are not looked at.
    """
    counted = checkpointed(count_phrases(docs, min_count))
    totals = counted.where(F.length("phrase") == 0).select("lang", F.col("n").alias("total"))
    nodes = counted.where(F.length("phrase") > 0).withColumn("path", _words(F.col("phrase")))
    left = _above(nodes, "path", "lefts").withColumn("reversed", F.reverse("path"))
    both = checkpointed(_above(left, "reversed", "rights"))
    phrases = both.where(F.size("path") > 1)
    # Cut k leaves the left part of k words and the right part of all others, which is the path of size - k words in the reversed trie.
    cuts = F.expr(
        "transform(sequence(1, size(path) - 1), k -> named_struct("
        "'score', cast(cast(2000000 as decimal(38, 0)) * n div (cast(element_at(lefts, k) as decimal(38, 0)) + element_at(rights, size(path) - k)) as long),"
        "'k', k, 'l', element_at(lefts, k), 'r', element_at(rights, size(path) - k)))"
    )
    scored = phrases.select("lang", "phrase", "path", F.col("n").alias("a"), F.array_min(cuts).alias("cut"))
    # Every contiguous part of two words or more of a longer phrase, with the longer one's count.
    parts = F.expr("flatten(transform(sequence(2, size(path) - 1), w -> transform(sequence(1, size(path) - w + 1), i -> slice(path, i, w))))")
    inside = phrases.where(F.size("path") > 2).select("lang", F.explode(parts).alias("path"), F.col("n").alias("longer"))
    covered = inside.groupBy("lang", "path").agg(F.max("longer").alias("longer"))
    left_over = scored.join(covered, ["lang", "path"], "left").where(F.expr(f"longer IS NULL OR cast(100 as decimal(38, 0)) * longer < {COVERED} * cast(a as decimal(38, 0))"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    best = left_over.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score")
