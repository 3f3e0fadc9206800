"""Near-duplicate documents by SimHash fingerprints and tiled exact comparison.

Fingerprints within a small Hamming radius are linked. Distinct fingerprints
are grouped by equal keys. Every group is sorted by population count and cut
into tiles; pairs of tiles are compared exactly by exclusive-or and bit counts,
and pairs whose population counts differ by more than the radius are never
formed. Keys are two of r + 2 blocks of bits (two fingerprints that differ in
at most r bits agree in at least two, so no link is lost). Near copies lie many
bits apart, where blocks of bits say nothing: there keys are bands of least
shingle hashes, and links are verified by the overlap of word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.llm.bitmaps import bitmap, maybe
from foretell.llm.common import checkpointed, slices
from foretell.llm.components import connected_components

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
#: Fingerprints in a tile; a tile pair is one task's unit of work.
TILE = 2048
_CHUNK = 1 << 16
#: Near copies: shingles of so many words, at least this share of them in common, fingerprints at most so many bits apart.
WIDE_WORDS, SIMILARITY, WIDE_RADIUS = 5, 0.8, 14
#: Bands and least hashes in a band: at a similarity of 0.8 a pair meets in one with probability 0.997.
BANDS, BAND_ROWS = 8, 3
#: Texts in a tile that holds their shingles.
VERIFY_TILE = 1024


def _shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII case and ASCII white space count
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE_WORDS:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = SHINGLE_WORDS - 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:-k].tolist(), ends[k:].tolist())), np.uint64, len(words) - k)


def _fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats counted.

    A-Z are lower-cased; shingles of three words, or all words if fewer; a bit
    is set when over half of the shingles' XXH64 hashes (seed 42) have it.
    No words (null, empty, white space only): zero.
    """
    return _fingerprint(_shingle_hashes(text))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def wide_shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the distinct shingles of WIDE_WORDS words: two of three words each, two places apart, make one of five."""
    if len(hashes) <= WIDE_WORDS - SHINGLE_WORDS:
        hashes = hashes[:1] if len(hashes) < 2 else _mixed(np.add.reduce(hashes, keepdims=True))  # fewer words: all of them
        return _mixed(hashes)
    return np.unique(_mixed(_mixed(hashes[: SHINGLE_WORDS - WIDE_WORDS]) + hashes[WIDE_WORDS - SHINGLE_WORDS :]))


def _band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: what BAND_ROWS seeded orders of the shingles have for their least."""
    if not len(shingles):
        return np.array([], np.int64)
    turns = _mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(len(turns), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 1 << 13):
        part = shingles[None, i : i + (1 << 13)] * turns[:, None]
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=1))
    keys = least.reshape(BANDS, BAND_ROWS)
    key = keys[:, 0]
    for k in range(1, BAND_ROWS):
        key = _mixed(key) + keys[:, k]
    return _mixed(key).view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common shingles among all of two texts, by their distinct shingles' hashes."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(len(a) + len(b) - common, 1)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            prints = pa.array([fingerprint(t) for t in part.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), prints], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``; texts are read whole."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the links of a minimum spanning forest of fingerprints at most ``radius`` bits apart: fewer links than fingerprints, and of each one the shortest.

    Grown node by node; one row of distances is held, never the matrix.
    """
    n = len(prints)
    near, nearest, open_ = np.full(n, BITS + 1, np.uint8), np.zeros(n, np.int64), np.ones(n, bool)
    ends, at = [], 0
    for _ in range(n - 1):
        open_[at] = False
        bits = np.bitwise_count(prints ^ prints[at])
        closer = open_ & (bits < near)
        near[closer], nearest[closer] = bits[closer], at
        at = int(np.where(open_, near, BITS + 2).argmin())
        if near[at] <= radius:
            ends.append((at, nearest[at]))
    return tuple(np.array(ends, np.int64).reshape(-1, 2).T)


def _members(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """The members of each row's tile (or pair of tiles), by field, one for each fingerprint."""
    column = batch.column("members")
    offsets = column.offsets.to_numpy()
    values = column.values  # not cut to the batch, as the offsets aren't
    fields = {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        _, first = np.unique(fields["fp"][a:b], return_index=True)
        yield {name: x[a:b][first] for name, x in fields.items()}


def _link_rows(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    joined = [np.concatenate(x) if x else np.array([], np.int64) for x in (u, v)]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(*joined), pa.int64()), pa.array(np.minimum(*joined), pa.int64())], ["u", "v"])


def _link_batches(radius: int):
    """Links of each row's tile (or pair of tiles): the shortest that connect what is connected there."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for members in _members(batch):
                group = members["fp"]
                if len(group) > 1:
                    one, other = _forest(group.view(np.uint64), radius)
                    u.append(group[one])
                    v.append(group[other])
            yield _link_rows(u, v)

    return links


def _connect_batches(radius: int, similarity: float):
    """Links of each tile that connect what is similar there and not connected yet, nearest first; fewer than it has members."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.column("members"):
                members = tile.values
                prints, first = np.unique(members.field("fp").to_numpy(zero_copy_only=False), return_index=True)
                roots = members.field("root").to_numpy(zero_copy_only=False)[first]
                sizes = members.field("size").to_numpy(zero_copy_only=False)[first].astype(np.float64)
                column = members.field("shingles")
                flat, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
                shingles = [flat[ends[i] : ends[i + 1]] for i in first.tolist()]
                u, v = [], []
                for i in range(len(prints) - 1):
                    bits = np.bitwise_count((prints[i + 1 :] ^ prints[i]).view(np.uint64))
                    fit = np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i])
                    near = i + 1 + np.flatnonzero(fit & (bits <= radius) & (roots[i + 1 :] != roots[i]))
                    for j in near[np.argsort(bits[near - i - 1], kind="stable")].tolist():
                        if roots[i] != roots[j] and overlap(shingles[i], shingles[j]) >= similarity:
                            u.append(prints[i])
                            v.append(prints[j])
                            roots[roots == roots[j]] = roots[i]
                if u:
                    yield _link_rows([np.array(u)], [np.array(v)])

    return connect


def _block_keys(radius: int) -> list[int]:
    """Masks of two of radius + 2 blocks of bits, as signed longs."""
    edges = np.linspace(0, BITS, radius + 3).astype(int)
    blocks = [sum(1 << b for b in range(a, z)) for a, z in zip(edges[:-1], edges[1:])]
    return [int(np.uint64(x | y).view(np.int64)) for x, y in combinations(blocks, 2)]


def near_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(u, v)`` that connect every two fingerprints within ``radius`` bits; ``distinct`` has one row for each ``fp``."""
    masks = _block_keys(radius)
    keyed = distinct.select("fp", F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "key"))
    return tiled_links(keyed, radius, tile)


def tiled_links(keyed: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links ``(u, v)`` that connect every two fingerprints within ``radius`` bits that share a ``(band, key)``.

    ``keyed`` has a row for each ``(fp, band, key)``. Each pair of tiles returns
    a minimum spanning forest, fewer rows than it has members, never all pairs;
    it holds the shortest link of every member, so near copies come up with
    their nearest ones.
    """
    return tiles(keyed, radius, tile).mapInArrow(_link_batches(radius), "u long, v long").distinct()


def tiles(keyed: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """``members``: tiles, or pairs of tiles, that hold every two fingerprints within ``radius`` bits that share a ``(band, key)``.

    ``keyed`` has a row for each ``(fp, band, key)``; its other columns go
    along. A group's population counts, 65 at most, are laid out in order; tiles
    take ``tile`` members or more in that order, and a count with more members
    than that is dealt into tiles by hash. Pairs of tiles are joined by the
    population counts that one reaches and the other has.
    """
    carried = [c for c in keyed.columns if c not in ("band", "key")]
    group, size = ["band", "key"], F.lit(tile)
    keyed = keyed.withColumn("pop", F.bit_count("fp").cast("int"))
    counts = keyed.groupBy(*group, "pop").agg(F.count("*").alias("n"))
    groups = counts.groupBy(*group).agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("pop", "n"))).alias("pops")).where("size > 1")
    before = F.transform("pops", lambda p, i: F.struct(p["pop"].alias("pop"), p["n"].alias("n"), F.aggregate(F.slice("pops", 1, i), F.lit(0).cast("long"), lambda acc, q: acc + q["n"]).alias("before")))
    number = F.floor(F.col("p.before") / size) * 128 + F.when(F.col("p.n") > size, F.col("p.pop") + 1).otherwise(0)
    placed = groups.select(*group, F.explode(before).alias("p")).select(*group, F.col("p.pop").alias("pop"), number.alias("tile"), F.ceil(F.col("p.n") / size).alias("parts"))
    placed = checkpointed(placed)
    ranges = placed.groupBy(*group, "tile").agg(F.min("pop").alias("low"), F.max("pop").alias("high"), F.max("parts").alias("parts"))
    ranges = ranges.select(*group, "low", "high", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    ranges = ranges.select(*group, "low", "high", F.struct("tile", "part").alias("t"))
    one = ranges.select(*group, F.col("t").alias("a"), F.explode(F.sequence("low", F.col("high") + radius)).alias("pop"))
    two = ranges.select(*group, F.col("t").alias("b"), F.explode(F.sequence("low", "high")).alias("pop"))
    pairs = one.join(two, [*group, "pop"]).where("a <= b").select(*group, "a", "b").distinct()
    sides = pairs.select(*group, "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("t")).select(*group, "a", "b", "t.tile", "t.part")
    members = keyed.join(placed, [*group, "pop"]).select(*group, "tile", F.pmod(F.xxhash64("fp"), "parts").alias("part"), F.struct(*carried).alias("member"))
    return sides.join(members, [*group, "tile", "part"]).groupBy(*group, "a", "b").agg(F.collect_list("member").alias("members")).select("members")


def _near_copy_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            prints, bands, sizes = [], [], []
            for text in part.column("text").to_pylist():
                hashes = _shingle_hashes(text)
                wide = wide_shingles(hashes)
                prints.append(_fingerprint(hashes))
                bands.append(_band_keys(wide))
                sizes.append(len(wide))
            columns = [part.column("named"), part.column("doc_id"), part.column("h"), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["named", "doc_id", "h", "fp", "bands", "size"])


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = [wide_shingles(_shingle_hashes(t)).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("named"), part.column("doc_id"), part.column("h"), pa.array(sets, pa.list_(pa.int64()))], ["named", "doc_id", "h", "shingles"])


def _verified_batches(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c) for c in ("a", "b")]
            keep = [overlap(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64)) >= similarity for a, b in zip(*sides)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return verify


def near_copy_links(firsts: DataFrame, rows: DataFrame, close: DataFrame, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(u, v)`` that connect what ``close`` ones connect, and fingerprints at most ``radius`` bits apart whose texts share ``similarity`` of their shingles.

    ``firsts (fp, first, bands, size)`` has one row for each fp, whose text is
    the one of ``rows (named, doc_id, h, text)`` at ``first``. Candidates meet
    in a band. The shortest links that would connect them come first, and are
    held against the whole sets of shingles. Groups that those that hold leave
    apart are dealt into tiles again, with the sets: there every pair that may
    be similar and isn't connected yet is compared, nearest first. So a group
    of copies costs its links, and a link that fails takes no other with it.
    """
    keyed = firsts.select("fp", "size", F.posexplode("bands").alias("band", "key"))
    keyed = checkpointed(keyed.join(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), ["band", "key"]).drop("n"))
    met = keyed.select("fp").distinct().join(firsts.select("fp", "first.*"), "fp")
    place = F.xxhash64("named", "doc_id", "h")
    read = rows.where(maybe(bitmap(met.select(place.alias("hash"))), place)).mapInArrow(_shingle_batches, "named int, doc_id long, h long, shingles array<long>")
    sets = checkpointed(read.join(met, ["named", "doc_id", "h"]).groupBy("fp").agg(F.first("shingles").alias("shingles")))

    def verified(found: DataFrame) -> DataFrame:
        ends = [sets.select(F.col("fp").alias(end), F.col("shingles").alias(name)) for end, name in (("u", "a"), ("v", "b"))]
        both = found.join(ends[0], "u").join(ends[1], "v").select("u", "v", "a", "b")
        return checkpointed(both.mapInArrow(_verified_batches(similarity), "u long, v long"))

    links = close.unionByName(verified(tiled_links(keyed.drop("size"), radius, tile)))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    marked = keyed.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    apart = marked.groupBy("band", "key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("band", "key")
    held = checkpointed(marked.join(apart, ["band", "key"])).join(sets, "fp")  # tiles read it twice
    # What is connected so far goes on as stars, so that the caller's rounds begin where these ended.
    stars = roots.where("fp != root").select(F.col("fp").alias("u"), F.col("root").alias("v"))
    return stars.unionByName(tiles(held, radius, min(tile, VERIFY_TILE)).mapInArrow(_connect_batches(radius, similarity), "u long, v long").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row for each row of ``docs (doc_id, text, ...)``.

    component_id is the least doc_id reachable over links of at most ``radius``
    differing bits, itself included. Equal texts share a fingerprint and so a
    component; comparison runs on distinct fingerprints, so a group of any
    number of copies costs one row. Null and wordless texts have fingerprint
    zero and are linked like any other. Repeated rows each get a row; a null
    doc_id gets its component's least non-null doc_id, or null. Other columns
    of ``docs`` are not read.
    """
    prints = checkpointed(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(near_links(distinct.select("fp"), radius, tile))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    components = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(components, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs (doc_id, text, ...)`` that stand for their group: one row of each group of near copies stays.

    Groups are what is connected by fingerprints at most ``radius`` bits apart
    or by near copies that share ``similarity`` of their five-word shingles. Of
    a group the row of the least doc_id stays (null ids last, of one id the
    least hash of the text), with all its columns. Rows are told apart by id
    and text: a row with another text under a repeated id is judged by its own
    text, and of rows repeated in both any one may stay. Null and wordless
    texts are one group.
    """
    key = [F.col("doc_id").isNull().cast("int").alias("named"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")]
    rows = docs.select(*key, F.col("text").cast("string").alias("text"))
    prints = rows.mapInArrow(_near_copy_batches, "named int, doc_id long, h long, fp long, bands array<long>, size long")
    # One text's bands for each fingerprint, the first row's; added up before they are shuffled.
    place = F.struct("named", "doc_id", "h")
    firsts = prints.groupBy("fp").agg(F.min(place).alias("first"), F.min_by(F.struct("bands", "size"), place).alias("of"))
    firsts = checkpointed(firsts.select("fp", "first", "of.bands", "of.size"))
    links = near_copy_links(firsts, rows, near_links(firsts.select("fp"), radius), similarity)
    roots = connected_components(links).withColumnRenamed("node", "fp")
    groups = firsts.select("fp", "first").join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    stay = groups.select(F.col("first.named").alias("__named"), F.col("first.doc_id").alias("__id"), F.col("first.h").alias("__h"))
    # Rows are dealt by the key once: what joins by it and what drops repeated rows within it share the shuffle.
    keyed = docs.withColumns({f"__{name}": k for name, k in zip(("named", "id", "h"), (F.col("doc_id").isNull().cast("int"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.xxhash64(F.coalesce("text", F.lit("")))))})
    kept = keyed.join(stay, ["__named", "__id", "__h"], "left_semi").dropDuplicates(["__named", "__id", "__h", "doc_id", "text"])
    return kept.select(docs.columns)


def fingerprint_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
