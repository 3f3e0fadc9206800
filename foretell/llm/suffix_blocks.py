"""Bytes covered by strings that start anywhere else, found blockwise over a difference cover of all suffixes.

A difference cover of period v is a set of residues such that any two offsets
have a distance below v at which both fall on it. So two suffixes that agree in
their first LENGTH bytes both pass, within v bytes and at the same distance,
through positions of the cover sample, and from there on agree in at least
LENGTH - v + 1 bytes.

1. The cover sample is ranked once: its suffixes to that depth are dealt out in
   blocks, and each block is sorted by itself. A rank that only one sample
   position has rules out every suffix that passes through it.
2. The suffixes left over, within v bytes before a sample position whose rank
   is shared, are dealt out in blocks again, sorted one block at a time, and
   compared to their whole LENGTH. Those that meet no equal are taken out.

Blocks hold a bounded share of all suffixes, and only one is in memory at a
time. A suffix is a fingerprint of the bytes it is compared by (XXH3 of 128
bits: one half picks the block, of the other the sample keeps 5 bytes, as a
false tie there only costs time, and the suffixes keep 8). So blocks are in the
order of fingerprints, not of bytes: only equality is asked for here.

Equal suffixes that a task finds in its own texts are told apart from the rest:
one of them is sent, marked as repeated, so a string that is everywhere sends
one row a task. Texts that are equal as a whole are one text with copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretell.llm.bitmaps import bitmap, maybe
from foretell.llm.common import checkpointed, join_unique

LENGTH = 400
#: A prime power; the cover's period is q^2 + q + 1, of which q + 1 residues are in it.
ORDER = 13
#: Bytes of text in a block of sample suffixes and, where each byte may start one, in a block of suffixes.
SAMPLE_BLOCK, BLOCK = 32 << 20, 16 << 20
#: Suffixes that a task holds before it deals them out.
HELD = 1 << 19
#: Blocks below zero hold answers already: block -1 - s those of slot s.
_DEALT = "block int, packed binary"


def difference_cover(q: int = ORDER) -> tuple[int, np.ndarray]:
    """(v, residues): a perfect difference set of a prime ``q`` by Singer's construction over cubics, checked before use."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, found = (1, 0, 0), []
                for i in range(v):  # powers of x with x^3 = a x^2 + b x + c
                    if x[2] == 0:
                        found.append(i)
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len(found) == q + 1 and len({(i - j) % v for i in found for j in found}) == v:
                    return v, np.array(found)
    raise ValueError(f"{q} is no prime")


def _planes(values: np.ndarray) -> bytes:
    """Integers with their bytes in planes, so that high bytes compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(packed: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8, n * width).reshape(width, n).T).reshape(-1).view(kind)


def _steps(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions as steps from the one before, whole where ``first``."""
    return np.where(first, at, np.diff(at, prepend=0)).astype("<i4")


def _places(keys: np.ndarray, of: np.ndarray, at: np.ndarray) -> bytes:
    """Texts (their keys, and which one each place is in) and places as bytes; sorted by text and place."""
    new = np.concatenate([[True], of[1:] != of[:-1]])
    each = np.diff(np.append(np.flatnonzero(new), len(of))).astype("<i4")
    head = np.array([len(each), len(of)], "<i8").tobytes()
    return b"".join([head, keys[of[new]].tobytes(), _planes(each), _planes(_steps(at, new))])


def _opened_places(packed: memoryview, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(keys, key number, place) and how many bytes they take."""
    texts, n = np.frombuffer(packed, "<i8", 2).tolist()
    x = 16
    keys = np.frombuffer(packed, f"V{key}", texts, x)
    x += key * texts
    each = _from_planes(packed[x : x + 4 * texts], "<i4", texts)
    x += 4 * texts
    steps = _from_planes(packed[x : x + 4 * n], "<i4", n)
    sums = np.cumsum(steps, dtype=np.int64)
    start = np.cumsum(each) - each
    at = (sums - np.repeat(sums[start] - steps[start], each)).astype(np.int32)
    return keys, np.repeat(np.arange(texts, dtype=np.int32), each), at, x + 4 * n


def _slotted(keys: np.ndarray, of: np.ndarray, at: np.ndarray, slots: int) -> tuple[list[int], list[bytes]]:
    """Answers dealt out by text: (slot, packed) for each slot that has any."""
    if not len(of):
        return [], []
    width = keys.dtype.itemsize
    slot = (np.frombuffer(keys.tobytes(), np.uint8).reshape(-1, width)[:, :4].copy().view("<u4").reshape(-1) % slots).astype(np.int32)[of]
    order = np.lexsort((at, of, slot))
    slot, of, at = slot[order], of[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    ends = [*starts[1:].tolist(), len(of)]
    return slot[starts].tolist(), [_places(keys, of[i:j], at[i:j]) for i, j in zip(starts.tolist(), ends, strict=True)]


def _positions(packed: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(packed, "<i4", len(packed) // 4), dtype=np.int64)


class _Held:
    """The suffixes a task has found and not yet dealt out."""

    def __init__(self, blocks: int, width: int, key: int, shared: bool):
        self.blocks, self.width, self.key, self.shared = blocks, width, key, shared
        self.clear()

    def clear(self) -> None:
        self.keys: list[bytes] = []
        self.seen: dict = {}
        self.at: list[np.ndarray] = []
        self.prints: list[bytes] = []
        self.n = 0

    def add(self, key: bytes, at: np.ndarray, prints: bytes) -> None:
        if (key, int(at[0])) in self.seen:
            return  # an equal text
        self.seen[key, int(at[0])] = True
        self.keys.append(key)
        self.at.append(at)
        self.prints.append(prints)
        self.n += len(at)

    def deal(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        halves = np.frombuffer(b"".join(self.prints), "<u8").reshape(-1, 2)
        of = np.repeat(np.arange(len(self.at), dtype=np.int32), [len(a) for a in self.at])
        at = np.concatenate(self.at)
        keys = self.keys
        block = (halves[:, 1] % np.uint64(self.blocks)).astype(np.int32)
        prints = halves[:, 0] & np.uint64((1 << 8 * self.width) - 1)
        self.clear()
        # Suffixes are held in the order of texts and positions, so an ascending choice of them is in that order too.
        order = np.argsort(prints)
        first = np.concatenate([[True], (prints[order[1:]] != prints[order[:-1]]) | (block[order[1:]] != block[order[:-1]])])
        runs = np.diff(np.append(np.flatnonzero(first), len(first)))
        many = np.zeros(len(order), bool)
        many[order] = np.repeat(runs > 1, runs)
        names = np.frombuffer(b"".join(k[: self.key] for k in keys), f"V{self.key}")
        if self.shared and many.any():
            # What repeats among a task's own suffixes needs no answer.
            slots, packed = _slotted(names, of[many], at[many], self.blocks)
            yield _dealt([-1 - x for x in slots], packed)
        sent = np.sort(order[first])
        sent = sent[np.argsort(block[sent].astype(np.int16) if self.blocks < 1 << 15 else block[sent], kind="stable")]
        block, prints, of, at, many = block[sent], prints[sent], of[sent], at[sent], many[sent]
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        rows = []
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True):
            body = prints[i:j].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width].tobytes()
            rows.append(b"".join([_places(names, of[i:j], at[i:j]), body, np.packbits(many[i:j]).tobytes()]))
        yield _dealt(block[starts].tolist(), rows)


def _dealt(blocks: list[int], packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], ["block", "packed"])


#: Bytes of a text's hash that stand for it; fewer in the sample, where two texts that share them (2^-64 a pair) would also share their spans.
_KEY, _SHORT = 12, 8


def _opened(packed: bytes, width: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, key number, position, fingerprint, repeated) of a dealt block's part."""
    packed = memoryview(packed)
    keys, of, at, x = _opened_places(packed, key)
    n = len(at)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8, n * width, x).reshape(n, width)
    x += n * width
    many = np.unpackbits(np.frombuffer(packed, np.uint8, (n + 7) // 8, x), count=n).astype(bool)
    return keys, of, at, wide.reshape(-1).view("<u8"), many


#: Parts of a block that are sorted one at a time, a power of two.
BUCKETS = 4


def _sorted_block(parts: list, width: int, key: int, shared: bool, slots: int) -> pa.RecordBatch:
    """Sorts one block bucket by bucket; the suffixes with an equal elsewhere if ``shared``, else those without, by slots of texts."""
    keys, of, at, prints, many = _joined_parts(parts, width, key)
    told = []
    for bucket in range(BUCKETS):
        # Sorting one bucket at a time bounds what a block takes on top of its suffixes.
        mine = np.flatnonzero((prints >> np.uint64(8 * width - BUCKETS.bit_length() + 1)) == bucket)
        if len(mine):
            told.append(mine[_told(of[mine], at[mine], prints[mine], many[mine], shared)])
    told = np.concatenate(told)
    return _dealt(*_slotted(keys, of[told], at[told], slots))


def _joined_parts(parts: list, width: int, key: int) -> tuple[np.ndarray, ...]:
    opened = [_opened(p, width, key) for p in parts]
    keys, number = np.unique(np.concatenate([o[0] for o in opened]), return_inverse=True)
    number = number.astype(np.int32)
    starts = np.cumsum([0, *[len(o[0]) for o in opened[:-1]]]).tolist()
    of = np.concatenate([number[s : s + len(o[0])][o[1]] for o, s in zip(opened, starts, strict=True)])
    return keys, of, *[np.concatenate([o[k] for o in opened]) for k in (2, 3, 4)]


def _told(of: np.ndarray, at: np.ndarray, prints: np.ndarray, many: np.ndarray, shared: bool) -> np.ndarray:
    # Equal texts in several tasks send their sample twice; the suffixes come from distinct texts.
    order = np.lexsort((at, of, prints)) if shared else np.argsort(prints)
    of, at, prints, many = of[order], at[order], prints[order], many[order]
    new_print = np.concatenate([[True], prints[1:] != prints[:-1]])
    new = new_print | np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1])])
    starts = np.flatnonzero(new_print)
    runs = np.diff(np.append(starts, len(prints)))
    equal = np.repeat((np.add.reduceat(new.astype(np.int64), starts) > 1) | (np.add.reduceat(many.astype(np.int64), starts) > 0), runs)
    return order[new & ~many & (equal if shared else ~equal)]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(number, parts) of rows that come sorted by their first column."""
    now, parts = None, []
    for batch in batches:
        for number, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if parts and number != now:
                yield now, parts
                parts = []
            now = number
            parts.append(packed.as_buffer())
    if parts:
        yield now, parts


def _blocks(width: int, key: int, shared: bool, slots: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _grouped(batches):
            found = _dealt([-1 - block] * len(parts), [p.to_pybytes() for p in parts]) if block < 0 else _sorted_block(parts, width, key, shared, slots)
            yield found.rename_columns(["slot", "packed"])

    return run


def _gathered(key: int, finish: Callable, kind: pa.DataType) -> Callable:
    """(key, value): a row a text with ``finish`` of its places; a slot of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _grouped(batches):
            opened = [_opened_places(memoryview(p), key) for p in parts]
            keys, number = np.unique(np.concatenate([o[0] for o in opened]), return_inverse=True)
            starts = np.cumsum([0, *[len(o[0]) for o in opened[:-1]]]).tolist()
            of = np.concatenate([number[s : s + len(o[0])][o[1]] for o, s in zip(opened, starts, strict=True)])
            at = np.concatenate([o[2] for o in opened])
            order = np.lexsort((at, of))
            of, at = of[order], at[order]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1])])
            of, at = of[new], at[new]
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
            values = [finish(at[i:j].astype(np.int64)) for i, j in zip(cuts, [*cuts[1:], len(of)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([bytes(keys[k]) for k in of[cuts].tolist()], pa.binary()), pa.array(values, kind)], ["key", "value"])

    return run


def _prints(text: bytes, at: np.ndarray, depth: int) -> bytes:
    digest = xxhash.xxh3_128_digest
    return b"".join(b"".join([digest(text[i : i + depth]) for i in at[k : k + 65536].tolist()]) for k in range(0, len(at), 65536))


def _answers(texts: DataFrame, wanted: Callable, columns: list[str], depth: int, width: int, key_bytes: int, blocks: int, shared: bool, finish: Callable, kind: pa.DataType, schema: str) -> DataFrame:
    """(key, value): a row a text with ``finish`` of its suffixes ``wanted(text, row)`` that have an equal elsewhere to ``depth`` bytes, or of those that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(blocks, width, key_bytes, shared)
        for batch in batches:
            more = [batch.column(c) for c in columns]
            for i, (key, text) in enumerate(zip(batch.column("key"), batch.column("text"), strict=True)):
                text = text.as_py().encode("utf-8", "surrogatepass")
                at = wanted(text, *[m[i].as_py() for m in more])
                for k in range(0, len(at), HELD):
                    part = at[k : k + HELD]
                    held.add(key.as_py(), part, _prints(text, part, depth))
                    if held.n >= HELD:
                        yield from held.deal()
        yield from held.deal()

    dealt = texts.select("key", "text", *columns).mapInArrow(run, _DEALT)
    slotted = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_blocks(width, key_bytes, shared, blocks), "slot int, packed binary")
    return slotted.repartition("slot").sortWithinPartitions("slot").mapInArrow(_gathered(key_bytes, finish, kind), f"key binary, value {schema}")


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Intervals sorted by start, merged where they meet or overlap."""
    if not len(starts):
        return [], []
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)].tolist()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _starts(spans: list[dict], last: int) -> np.ndarray:
    """The starts of ``spans`` up to ``last``."""
    return np.concatenate([np.zeros(0, np.int64), *[np.arange(s["start"], min(s["end"], last + 1)) for s in spans]])


def _passing(texts: DataFrame, length: int, order: int, blocks: int) -> DataFrame:
    """(key, spans): the starts of suffixes that pass a sample position of a shared rank."""
    v, cover = difference_cover(order)
    if length <= v:
        raise ValueError(f"strings must be longer than the period {v}")
    depth = length - v + 1

    def sample(text: bytes) -> np.ndarray:
        at = (np.arange(0, len(text), v)[:, None] + cover).reshape(-1)
        return at[at <= len(text) - depth]

    def spans(at: np.ndarray) -> list[dict]:
        return [{"start": s, "end": e} for s, e in zip(*_runs(np.maximum(at - v + 1, 0), at + 1), strict=True)]

    found = _answers(texts, sample, [], depth, 5, _SHORT, blocks, True, spans, _SPANS, "array<struct<start: long, end: long>>")
    return found.select("key", F.col("value").alias("spans"))


def _covered(size: int, spans: list[dict], alone: bytes | None, length: int) -> tuple[list[int], list[int]]:
    """The byte ranges that strings of ``length`` bytes cover whose starts lie in ``spans`` and are not ``alone``."""
    at = _starts(spans, size - length)
    if alone:
        at = at[~np.isin(at, _positions(alone))]
    return _runs(at, at + length)


def remove_repeats(docs: DataFrame, length: int = LENGTH, order: int = ORDER, block: int = BLOCK, sample_block: int = SAMPLE_BLOCK) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (binary): the text without the bytes that a string of ``length`` bytes starting anywhere else covers.

    Strings never cross texts and are judged on the input; the same text or
    another one, an equal row among them, counts as elsewhere. Null texts are
    empty; texts below ``length`` bytes stay whole; ids may be null or repeat.
    Columns of docs with the names of results are replaced, others pass through
    whatever they are called. An empty table has no rows.
    """
    spark = docs.sparkSession
    results = ["n_bytes", "n_removed", "n_spans", "kept"]
    given = docs.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() not in results])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = given.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in given.columns]).alias("row"), text.alias("text"))
    rows = rows.withColumn("key", F.substring(F.unhex(F.sha2("text", 256)), 1, _KEY))
    size = F.octet_length("text")
    texts = rows.where(size >= length).select("key", "text")
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda each: max(tasks, -(-(counted["bytes"] or 0) // each))

    short = F.substring("key", 1, _SHORT)
    ranked = checkpointed(_passing(texts, length, order, blocks(sample_block)).withColumnRenamed("key", "short"))
    left = texts.where(maybe(bitmap(ranked.select(F.xxhash64("short").alias("hash"))), F.xxhash64(short)))
    passing = left.groupBy("key").agg(F.first("text").alias("text")).withColumn("short", short).join(ranked, "short")
    inside = lambda text, spans: _starts(spans, len(text) - length)
    packed_steps = lambda at: _planes(np.diff(at, prepend=0).astype("<i4"))
    alone = _answers(passing, inside, ["spans"], length, 8, _KEY, blocks(block), False, packed_steps, pa.binary(), "binary").withColumnRenamed("value", "alone")

    copies = checkpointed(texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    hashed = F.xxhash64(short)
    packed = bitmap(ranked.select(F.xxhash64("short").alias("hash")).unionByName(copies.where("n > 1").select(hashed.alias("hash"))))
    # The bitmap may let a text through that nothing touches; it has its row here as well.
    found = copies.withColumn("short", short).join(ranked, "short", "left").drop("short").join(alone, "key", "left").withColumn("copies", F.col("n"))
    marked = rows.withColumn("touched", maybe(packed, hashed) & (size >= length))
    whole = marked.where(~F.col("touched")).select("row", size.cast("long").alias("n_bytes"), *[F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans")], F.encode("text", "UTF-8").alias("kept"))
    joined = join_unique(marked.where("touched").select("row", "key"), found, ["key"], counted["n"])

    place = next(i for i, c in enumerate(given.columns) if c.lower() == "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column("row").field(place)
            for text, copies, spans, alone in zip(texts, *[batch.column(c) for c in ("copies", "spans", "alone")], strict=True):
                whole = str(text.as_py()).encode("utf-8", "surrogatepass")
                if copies.as_py() > 1:
                    starts, ends = [0], [len(whole)]
                else:
                    starts, ends = _covered(len(whole), spans.as_py() or [], alone.as_py(), length)
                kept = b"".join(whole[i:j] for i, j in zip([0, *ends], [*starts, len(whole)], strict=True))
                out.append((len(whole), len(whole) - len(kept), len(starts), kept))
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *results])

    fields = [T.StructField("row", rows.schema["row"].dataType), *[T.StructField(c, T.LongType()) for c in results[:3]], T.StructField("kept", T.BinaryType())]
    shortened = joined.select("row", "copies", "spans", "alone").mapInArrow(cut, T.StructType(fields))
    return whole.unionByName(shortened).select("row.*", *results)
