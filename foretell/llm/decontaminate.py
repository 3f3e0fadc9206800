"""Benchmark decontamination: a BM25 index of test items, queried with every training passage.

Items are cut into pieces, and the pieces' word pairs are the terms of a small
inverted index whose impacts are divided by the piece's score against itself,
so that one threshold fits items of any length. Every passage (a window over a
training text) is a query; block-max WAND retrieves all pieces that reach the
threshold, and a retrieved piece counts only when enough of both its question
and its answer is found in the passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import checkpointed, slices

K1, B = 1.2, 0.75
#: Words of a piece at most, and of a passage; passages overlap by half, so every piece lies whole in one.
PIECE_WORDS, PASSAGE_WORDS = 64, 128
#: Shares of overlap say little of items of fewer words: these must be found as they are, all their words in a row.
SHORT_WORDS = 5
#: Share of a piece's own BM25 score that a passage must reach.
THRESHOLD = 0.5
#: Share of the word triples of the question, and of the answer, that the passage must hold.
OVERLAP = 0.5
#: Postings in a block that has one upper bound.
BLOCK = 8
#: Postings of one index at most, some 100 MB in a worker. More items make more indexes: each is built, sent out, used
#: and dropped before the next one, so ten million items of forty words take 400 passes and no more memory than one.
SHARD_POSTINGS = 1_000_000
#: Scripts that put no blanks between words: their characters are the words.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def _normal(texts: pa.Array) -> pa.Array:
    """Lists of lower-case words: letters, digits and marks; all else separates. In unspaced scripts every character is a word."""
    apart = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), _UNSPACED, r" \1 ")
    plain = pc.replace_substring_regex(apart, r"[^\pL\pN\pM]+", " ")
    return pc.split_pattern(pc.utf8_trim(plain, " "), " ")


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text, answer in zip(*(batch.column(c).to_pylist() for c in ("item_id", "text", "answer"))):
            body, tail = (_normal(pa.array([x], pa.string()))[0].as_py() for x in (text, answer))
            words = [w for w in [*body, *tail] if w]
            if not words:
                continue
            split = len(body) if any(tail) and any(body) else None
            parts = -(-len(words) // PIECE_WORDS)
            for k in range(parts):
                a, z = len(words) * k // parts, len(words) * (k + 1) // parts
                cut = min(max(split - a, 1), z - a - 1) if split is not None and a < split < z else (z - a + 1) // 2
                rows.append((item, k, words[a:z], cut))
        item, piece, words, cut = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(piece, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(cut, pa.int32())], ["item_id", "piece", "words", "cut"])


def pieces(items: DataFrame) -> DataFrame:
    """``(item_id, piece, words, cut)``: the items' words in pieces of equal length; the answer begins at word ``cut``.

    Items with an ``answer`` column have it after their text; without one, the
    second half of a piece is its answer. Null texts have no words.
    """
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.alias("answer"))
    return rows.mapInArrow(_piece_batches, "item_id long, piece int, words array<string>, cut int")


def postings(cut: DataFrame) -> DataFrame:
    """``(item_id, piece, words, cut, terms, impacts)`` with impacts that sum to 1 in every piece."""
    cut = cut.distinct().withColumn("id", F.xxhash64("item_id", "piece", "words"))
    # An item of one word is a term by itself; it is looked for in texts of one word.
    pairs = F.when(F.size("words") < 2, F.array(F.concat_ws(" ", F.get("words", F.lit(0)), F.get("words", F.lit(0))))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1))))
    terms = cut.select("id", F.size("words").alias("n"), F.explode(pairs).alias("term")).groupBy("id", "n", "term").agg(F.count("*").alias("tf"))
    size = cut.agg(F.count("*").alias("pieces"), F.avg(F.size("words")).alias("mean"))
    rarity = terms.groupBy("term").agg(F.count("*").alias("df"))
    weighed = terms.join(rarity, "term").crossJoin(F.broadcast(size))  # one row
    impact = F.log(1 + (F.col("pieces") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    lists = weighed.withColumn("impact", impact).groupBy("id").agg(F.sum("impact").alias("own"), F.sort_array(F.collect_list(F.struct("term", "impact"))).alias("p"))
    lists = lists.select("id", F.col("p.term").alias("terms"), F.transform("p.impact", lambda x: x / F.col("own")).alias("impacts"))
    return cut.join(lists, "id").drop("id")


class Index:
    """Inverted lists of one shard in NumPy arrays: docs and impacts by term, with an upper bound by term and by block."""

    def __init__(self, rows: list):
        self.items = [(r.item_id, r.piece) for r in rows]
        words = sorted({w for r in rows for w in r.words})
        self.words = pa.array(words, pa.string())
        number = {w: i for i, w in enumerate(words)}
        key, piece, impact = [], [], []
        for n, r in enumerate(rows):
            for term, x in zip(r.terms, r.impacts):
                a, b = term.split(" ")
                key.append(number[a] * len(words) + number[b])
                piece.append(n)
                impact.append(x)
        order = np.lexsort((piece, key))
        key, self.piece, self.impact = np.array(key, np.int64)[order], np.array(piece, np.int64)[order], np.array(impact)[order]
        self.keys, first = np.unique(key, return_index=True)
        self.first = np.append(first, len(key)).astype(np.int64)
        self.bound = np.maximum.reduceat(self.impact, first) if len(first) else np.array([])
        #: Each list is cut into blocks by itself; block k of term t is at block_first[t] + k.
        sizes = -(-np.diff(self.first) // BLOCK)
        self.block_first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.block_bound = np.array([self.impact[a : min(a + BLOCK, z)].max() for s, z in zip(self.first[:-1], self.first[1:]) for a in range(s, z, BLOCK)])
        triples = lambda ids: {tuple(ids[i : i + 3]) for i in range(len(ids) - 2)} or {tuple(ids)}
        ids = [[number[w] for w in r.words] for r in rows]
        self.parts = [(triples(x[: r.cut]), triples(x[r.cut :])) for x, r in zip(ids, rows)]
        #: Of short items all words, which must stand in a row; of one-word items only the number is needed.
        self.short = {n: tuple(x) for n, (x, r) in enumerate(zip(ids, rows)) if len(x) < SHORT_WORDS and r.piece == 0}
        self.single = {}
        for n, x in self.short.items():
            if len(x) == 1:
                self.single.setdefault(x[0], []).append(n)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All pieces whose impacts over the distinct ``terms`` sum to ``threshold`` or more, by block-max WAND."""
        piece, impact, first, found = self.piece, self.impact, self.first, []
        lists = [[int(piece[first[t]]), int(first[t]), t] for t in terms]
        slack = threshold - 1e-9

        def advance(entry: list, target: int) -> bool:
            """Move to the first posting at or after ``target``; whether there is one."""
            end = int(first[entry[2] + 1])
            entry[1] += int(np.searchsorted(piece[entry[1] : end], target))
            if entry[1] == end:
                return False
            entry[0] = int(piece[entry[1]])
            return True

        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for i, entry in enumerate(lists):
                total += self.bound[entry[2]]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            target = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
                pivot += 1
            total, beyond = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 62
            for _, at, t in lists[: pivot + 1]:
                end = int(first[t + 1])
                at += int(np.searchsorted(piece[at:end], target))
                if at < end:
                    block = (at - int(first[t])) // BLOCK
                    total += self.block_bound[self.block_first[t] + block]
                    beyond = min(beyond, int(piece[min(int(first[t]) + (block + 1) * BLOCK, end) - 1]) + 1)
            if total < slack:  # no piece before any of these blocks ends can reach the threshold
                gone = [i for i, entry in enumerate(lists[: pivot + 1]) if not advance(entry, max(beyond, target + 1))]
            elif lists[0][0] == target:
                score = sum(impact[entry[1]] for entry in lists[: pivot + 1])
                if score >= slack:
                    found.append((target, float(score)))
                gone = [i for i, entry in enumerate(lists[: pivot + 1]) if not advance(entry, target + 1)]
            else:
                gone = [i for i, entry in enumerate(lists[:pivot]) if entry[0] < target and not advance(entry, target)]
            for i in reversed(gone):
                del lists[i]
        return found

    def scan(self, texts: pa.Array, threshold: float, overlap: float) -> Iterator[tuple[int, dict]]:
        """For each text with a verified piece: its row and ``item -> (score, question share, answer share, word)``."""
        lists = _normal(texts)
        ends = lists.offsets.to_numpy()
        ends = ends - ends[0]
        ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if self.single:
            for row in np.flatnonzero(np.diff(ends) == 1).tolist():
                found = {self.items[n][0]: (1.0, 1.0, 1.0, 0) for n in self.single.get(int(ids[ends[row]]), ())}
                if found:
                    yield row, found
        if len(ids) < 2 or not len(self.keys):
            return
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(self.words) + ids[1:], -1)
        inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(ids))] - 1
        pair[inner] = -1  # a pair across two texts
        known = np.flatnonzero(pair >= 0)
        at = np.minimum(np.searchsorted(self.keys, pair[known]), len(self.keys) - 1)
        hit = self.keys[at] == pair[known]
        place, term = known[hit], at[hit]
        sums = np.concatenate(([0.0], np.cumsum(self.bound[term])))
        low, high = np.searchsorted(place, ends[:-1]), np.searchsorted(place, ends[1:])
        step = PASSAGE_WORDS // 2
        for row in np.flatnonzero(sums[high] - sums[low] >= threshold - 1e-9).tolist():
            a, z = int(ends[row]), int(ends[row + 1])
            starts = np.arange(a, max(a + 1, z - step), step)
            i, j = np.searchsorted(place, starts), np.searchsorted(place, np.minimum(starts + PASSAGE_WORDS, z) - 1)
            best: dict = {}
            for k in np.flatnonzero(sums[j] - sums[i] >= threshold - 1e-9).tolist():
                passage = ids[starts[k] : min(starts[k] + PASSAGE_WORDS, z)]
                held = None
                for n, score in self.search(np.unique(term[i[k] : j[k]]).tolist(), threshold):
                    if held is None:
                        listed = passage.tolist()
                        held = {x for w in range(1, SHORT_WORDS) for x in zip(*(listed[o:] for o in range(w)))}
                    if n in self.short:
                        if len(self.short[n]) < 2 or self.short[n] not in held:
                            continue
                        shares = [1.0, 1.0]
                    else:
                        shares = [len(part & held) / len(part) for part in self.parts[n]]
                    item = self.items[n][0]
                    if min(shares) >= overlap and (item not in best or score > best[item][0]):
                        best[item] = (score, *shares, int(starts[k]) - a)
            if best:
                yield row, best


def indexes(items: DataFrame) -> Iterator:
    """Broadcast indexes over all items, each of at most about SHARD_POSTINGS postings; one is dropped when the next one is asked for.

    What uses an index must therefore be written out before the next one.
    """
    lists = checkpointed(postings(checkpointed(pieces(items))))
    total = lists.agg(F.sum(F.size("terms"))).first()[0] or 0
    shards = -(-total // SHARD_POSTINGS)
    context = items.sparkSession.sparkContext
    for n in range(shards):
        shard = lists.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(shards)) == n) if shards > 1 else lists
        index = context.broadcast(Index(sorted(shard.collect(), key=lambda r: (len(r.words), r.item_id is not None, r.item_id or 0, r.piece))))
        yield index, n + 1 == shards == 1
        if shards > 1:
            index.destroy()


def _finder(index, threshold: float, overlap: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list = []
            for part in slices(batch, "text"):
                ids = part.column("doc_id")
                for row, best in index.value.scan(part.column("text"), threshold, overlap):
                    rows += [(ids[row].as_py(), item, *found) for item, found in best.items()]
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "question_share", "answer_share", "at_word"])

    return find


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``(doc_id, item_id, score, question_share, answer_share, at_word)``: every item found in every document.

    One row for each document and item, from the best-scoring passage.
    Texts are read whole; null, empty and wordless ones hold nothing, and so do
    wordless items. Case and punctuation don't matter. Items under SHORT_WORDS
    words are found where all their words stand in a row, and items of one word
    only in texts that are this word.
    Repeated document rows may repeat their findings; repeated items share theirs.
    An empty items table finds nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, score double, question_share double, answer_share double, at_word int"
    parts = []
    for index, alone in indexes(items):
        found = rows.mapInArrow(_finder(index, threshold, overlap), schema)
        parts.append(found if alone else checkpointed(found))
    if len(parts) < 2:
        return parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    # Pieces of one item may lie in several indexes.
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    best = F.max(F.struct("score", "question_share", "answer_share", "at_word")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def _cleaner(index, threshold: float, overlap: float):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[row for row, _ in index.value.scan(part.column("text"), threshold, overlap)]] = False
                yield part.filter(pa.array(keep))

    return clean


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; one pass and no shuffle for each index."""
    for index, alone in indexes(items):
        docs = docs.mapInArrow(_cleaner(index, threshold, overlap), docs.schema)
        docs = docs if alone else checkpointed(docs)
    return docs
