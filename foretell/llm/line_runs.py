"""Repeated runs of lines: a suffix array over line-ID sequences by prefix doubling, and its LCP intervals.

Every document is a sequence of line IDs and every line starts a suffix. Round
k sorts the suffixes by pairs of ranks, of the lines from there on and of those
2^k lines further, and so doubles the length by which they are ordered; ranks
are places in a range-partitioned sort, made global by prefix sums. A suffix
alone with its rank leaves. Longest common prefixes of neighbours are put
together from the ranks of the rounds, longest steps first. A suffix has an
earlier copy of n lines if an LCP interval of n lines or more holds an earlier
place; the largest such n comes from one scan of the array in each direction.
Partitions are scanned by themselves, and what reaches across their ends is
passed on as a staircase of lengths and earliest places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretell.llm.common import WORD, checkpointed, join_unique
from foretell.llm.order import numbered

#: A repeated run of at least this many lines is deleted, whatever its words,
MIN_LINES = 3
#: and so is a single repeated line of at least this many words; shorter ones ("Yes.", "Chapter 1", "}") recur in clean texts.
MIN_WORDS = 8
_ENDLESS = 1 << 40


def _suffixes(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: document key, position among such lines, index among all lines, ID of 128 bits, words."""
    lines = F.split("text", "\n")
    worded = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("x"))), lambda r: r["x"].rlike(WORD))
    key = [F.col("doc_id").isNotNull().cast("long").alias("named"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.xxhash64("text").alias("h")]
    rows = docs.where("text IS NOT NULL").select(*key, F.posexplode(worded).alias("pos", "r"))
    ids = [F.xxhash64("r.x").alias("id_a"), F.xxhash64(F.lit(1), "r.x").alias("id_b")]
    return rows.select("named", "doc_id", "h", F.col("pos").cast("long").alias("pos"), F.col("r.line").cast("long").alias("line"), *ids, F.regexp_count("r.x", F.lit(WORD)).cast("long").alias("words"))


def _repeated(suffixes: DataFrame) -> DataFrame:
    """Suffixes whose first line occurs at two places or more.

    Repeated rows of one document are one document, so places are told apart
    by their hash. No task gets all rows of a very common line.
    """
    place = F.xxhash64("named", "doc_id", "h", "pos")
    groups = suffixes.groupBy("id_a", "id_b").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).where("a != b")
    groups = checkpointed(groups.select("id_a", "id_b", "n"))
    return join_unique(suffixes, groups, ["id_a", "id_b"], suffixes.count())


def _scan(places: list[int], steps: list[int], stairs: list[tuple[int, int]]) -> list[int]:
    """For each place the longest prefix that it shares with a smaller place before it; ``steps`` are common prefixes with the place ahead.

    ``stairs`` (length, least place) is what comes from ahead and is left as
    what goes on: lengths rise and places too, so that each stair is of use.
    """
    found = []
    for place, step in zip(places, steps):
        least = -1
        while stairs and stairs[-1][0] >= step:
            least = stairs.pop()[1]  # the places rise with the lengths, so the last one taken is the least
        if least >= 0 and step > 0:
            stairs.append((step, least))
        while stairs and stairs[-1][1] >= place:
            stairs.pop()
        found.append(stairs[-1][0] if stairs else 0)
        stairs.append((_ENDLESS, place))
    return found


def _array(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the suffix array, and each one's common prefix with the one ahead."""
    table = [np.vstack([b.column(c).to_numpy(zero_copy_only=False) for c in ("rank", "place", "lcp")]) for b in batches if b.num_rows]
    if not table:
        return np.array([], np.int64), np.array([], np.int64)
    rank, place, lcp = np.hstack(table)
    rows = np.flatnonzero(place >= 0)
    steps = np.zeros(len(rows), np.int64)
    given = np.flatnonzero(place < 0)  # a prefix's row has its suffix's rank and comes just before it
    steps[np.searchsorted(rows, given)] = lcp[given]
    return place[rows], steps


def _longest_earlier(array: DataFrame) -> DataFrame:
    """``(place, run)``: by the suffix array ``(rank, place, lcp)``, how many lines from each place on also stand at an earlier place."""
    dealt = checkpointed(array.repartitionByRange("rank").sortWithinPartitions("rank", "place"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, steps = _array(batches)
        if len(places):
            on, back = [], []
            _scan(places.tolist(), [0, *steps[1:].tolist()], on)
            _scan(places[::-1].tolist(), [0, *steps[:0:-1].tolist()], back)
            flat = [[x for stair in s for x in stair] for s in (on, back)]
            inside = int(steps[1:].min()) if len(steps) > 1 else _ENDLESS
            columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([int(steps[0])], pa.int64()), pa.array([inside], pa.int64()), *[pa.array([f], pa.list_(pa.int64())) for f in flat]]
            yield pa.RecordBatch.from_arrays(columns, ["part", "step", "inside", "on", "back"])

    parts = sorted(dealt.mapInArrow(ends, "part long, step long, inside long, on array<long>, back array<long>").collect())
    pairs = lambda flat: list(zip(flat[::2], flat[1::2]))
    ahead, behind = {}, {}
    stairs: list[tuple[int, int]] = []
    for p in parts:
        ahead[p.part] = stairs
        stairs = _joined(stairs, min(p.step, p.inside), pairs(p.on))
    stairs, step = [], 0
    for p in reversed(parts):
        behind[p.part] = (stairs, step)
        stairs, step = _joined(stairs, min(step, p.inside), pairs(p.back)), p.step

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, steps = _array(batches)
        if len(places):
            part = TaskContext.get().partitionId()
            on = _scan(places.tolist(), steps.tolist(), list(ahead[part]))
            stairs, step = behind[part]
            back = _scan(places[::-1].tolist(), [step, *steps[:0:-1].tolist()], list(stairs))
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.maximum(on, back[::-1]), pa.int64())], ["place", "run"])

    return dealt.mapInArrow(runs, "place long, run long")


def _joined(stairs: list[tuple[int, int]], step: int, own: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stairs of a partition with those that reach it over a common prefix of ``step`` lines at most."""
    out: list[tuple[int, int]] = []
    for length, place in sorted([(min(length, step), place) for length, place in stairs if min(length, step) > 0] + own, reverse=True):
        if not out or place < out[-1][1]:
            if out and out[-1][0] == length:
                out.pop()
            out.append((length, place))
    return out[::-1]


def _suffix_array(base: DataFrame) -> DataFrame:
    """``(rank, place, lcp)``: a row of place for each row of ``base (place, doc, pos, id_a, id_b)``, and one of lcp where a rank shares lines with the one ahead."""
    columns = ["place", "doc", "pos"]
    first, more = numbered(base.select(*columns, "id_a", "id_b"), ["id_a", "id_b"], "place")
    levels = [first.select(*columns, F.col("inner").alias("rank"), (~F.col("alone")).alias("open"))]
    done = [levels[0].where("NOT open").select("rank", "place")]
    cuts = []
    while more:
        length = 1 << len(cuts)
        within = Window.partitionBy("doc").orderBy("pos")
        looked = levels[-1].select(
            "*",
            F.max("rank").over(within.rangeBetween(length, length)).alias("beyond"),
            F.coalesce(F.max("open").over(within.rangeBetween(-length, -length)), F.lit(False)).alias("asked"),
        )
        # A settled suffix stays for as long as the order of an open one depends on it.
        rows = looked.where("open OR asked").select(*columns, "rank", F.coalesce("beyond", -1 - F.col("place")).alias("beyond"), F.col("open").cast("long").alias("was"))
        ranked, more = numbered(rows, ["rank", "beyond"], "place")
        rank = (F.col("rank") + F.col("inner") - F.col("outer")).alias("rank")
        cuts.append(ranked.where("at = inner AND inner != outer").select(rank, "doc", "pos", "before_doc", "before_pos"))
        done.append(ranked.where("was = 1 AND alone").select(rank, "place"))
        levels.append(ranked.select(*columns, rank, (~F.col("alone")).alias("open")))

    prefixes, pending = [], None
    for k in range(len(cuts) - 1, -1, -1):
        fresh = cuts[k].select("*", F.lit(1 << k).cast("long").alias("lcp"))
        pending = fresh if pending is None else pending.unionByName(fresh)
        if k:
            # Equal ranks of the round before last say whether so many more lines agree.
            there = levels[k - 1].where("open")
            mine, other = (there.select(F.col("doc").alias(d), F.col("pos").alias(p), F.col("rank").alias(r)) for d, p, r in (("doc", "to", "mine"), ("before_doc", "before_to", "other")))
            reached = pending.withColumns({"to": F.col("pos") + F.col("lcp"), "before_to": F.col("before_pos") + F.col("lcp")})
            met = reached.join(mine, ["doc", "to"], "left").join(other, ["before_doc", "before_to"], "left")
            more = F.when(F.col("mine") == F.col("other"), 1 << (k - 1)).otherwise(0)
            pending = checkpointed(met.select("rank", "doc", "pos", "before_doc", "before_pos", (F.col("lcp") + more).alias("lcp")))
    if pending is not None:
        prefixes.append(pending.select("rank", F.lit(-1).cast("long").alias("place"), "lcp"))
    array = [d.select("rank", "place", F.lit(0).cast("long").alias("lcp")) for d in done] + prefixes
    out = array[0]
    for more in array[1:]:
        out = out.unionByName(more)
    return out


def _runs(docs: DataFrame) -> DataFrame:
    """The suffixes with repeated first lines: document key, ``doc, pos, line, words`` and ``run``, the lines from there on that also stand earlier."""
    suffixes = checkpointed(_suffixes(docs))
    keys = ["named", "doc_id", "h"]
    base, _ = numbered(_repeated(suffixes), keys, "pos")
    base = checkpointed(base.select(*keys, "pos", "line", "words", "id_a", "id_b", F.col("at").alias("place"), F.col("inner").alias("doc")))
    runs = _longest_earlier(_suffix_array(base))
    return base.drop("id_a", "id_b").join(runs, "place")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, h, line, run_lines)``: a row for each line of a run that has an earlier copy.

    ``h`` is the XXH64 of the whole text; with doc_id it names a document, so
    repeated rows (same id and text) are one document. Earlier means by
    (doc_id, h, line), null doc_ids first; copies may overlap. run_lines is the
    length, in lines with a word, of the maximal run that covers the line: of
    those that do, the one that reaches furthest. Runs of ``min_lines`` lines or
    more count, and single lines of ``min_words`` words or more, which are runs
    of one where nothing longer covers them.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    length = F.when(F.col("run") >= min_lines, F.col("run")).when((F.col("run") > 0) & (F.col("words") >= min_words), F.lit(1).cast("long"))
    upto = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(length.isNotNull(), F.struct((F.col("pos") + length).alias("end"), length.alias("n")))).over(upto)
    covered = _runs(docs).withColumn("reach", reach).where("reach.end > pos")
    return covered.select(F.when(F.col("named") == 1, F.col("doc_id")).alias("doc_id"), "h", F.col("line").cast("int").alias("line"), F.col("reach.n").alias("run_lines"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with later copies of repeated line runs cut from ``text``, plus ``n_lines`` and ``n_deleted``.

    Lines are split at \\n. A run of ``min_lines`` or more lines, or one line of
    ``min_words`` or more words, that also occurs earlier (in an earlier
    document or further up in the same one) is deleted; its first copy stays.
    Lines without a word are never part of a run and stay. Null texts stay
    null, with no lines; a text of which every worded line goes keeps only its
    wordless lines. Repeated rows (same id and text) get equal decisions and
    stay both. Ties can't occur: places are unique. doc_id is an integer. Of
    columns of ``docs`` named n_lines or n_deleted only the new ones are returned.
    """
    docs = docs.drop("n_lines", "n_deleted")
    cuts = repeated_runs(docs.select("doc_id", "text"), min_lines, min_words).groupBy("doc_id", "h").agg(F.collect_list("line").alias("__cut"))
    cuts = cuts.select(F.col("doc_id").alias("__cut_id"), F.col("h").alias("__cut_h"), "__cut")
    joined = docs.join(cuts, docs["doc_id"].cast("long").eqNullSafe(cuts["__cut_id"]) & (F.xxhash64(docs["text"]) == cuts["__cut_h"]), "left")
    # Used twice, so made once a row and not once an element.
    parts = joined.select(F.struct(*[docs[c] for c in docs.columns]).alias("own"), cuts["__cut"].alias("cut"), F.split(docs["text"], "\n").alias("lines"))
    parts = parts.select("*", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "cut").alias("left"))
    text = F.when(F.col("cut").isNull(), F.col("own.text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    return parts.select(
        *[text.alias(c) if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns],
        F.when(F.col("own.text").isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).alias("n_deleted"),
    )
