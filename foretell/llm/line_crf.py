"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of the lines
next to it; the chain lets neighbouring labels support each other. A
document's score is the mean of its lines' forward-backward marginals of good,
weighted by length. The field is trained here. Only documents are labelled, so
line labels are latent: after a start from labels passed down to the lines,
rounds of posterior regularisation take the nearest distribution over line
labels in which a good document is mostly good by length and a bad one mostly
bad, and fit the field to that.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretell.llm.common import checkpointed, slices

#: Labelled documents that the field is trained on at most: those whose doc_ids have the least hashes.
TRAIN_DOCS = 4000
#: and lines of theirs at most: documents are taken in that order until the next one would exceed them.
TRAIN_LINES = 400_000
#: Training: weight of the squared norm, and those of neighbouring lines' features and of label pairs (in documents of one
#: label a line's neighbours say as much as itself; at the border of a bad block they don't), rounds with labels passed
#: down, turns of latent labels and rounds in each, step.
PENALTY, BESIDE_PENALTY, PAIR_PENALTY, ROUNDS, TURNS, TURN_ROUNDS, STEP = 1e-3, 0.3, 0.03, 120, 4, 25, 0.08
#: What a label says of a document's lines: the share of good ones by length, at least in good documents and at most in bad ones.
GOOD_SHARE, BAD_SHARE = 0.95, 0.1
#: Lines whose features are held at once; of a longer text one number a line is kept.
LINES_AT_ONCE = 50_000
#: The place of the logarithm of a line's length among its features, and bytes that a line's features take.
_SIZE, _LINE_BYTES = 10, 300
_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _BANG, _SYMBOL, _OTHER = range(8)
_CONTEXT = 6


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """A character class for each code point of the first plane; the rest counts as other."""
    table = np.full(1 << 16, _OTHER, np.uint8)
    for code in range(1 << 16):
        kind = unicodedata.category(chr(code))
        if kind[0] in "LM":
            table[code] = _UPPER if kind == "Lu" else _LETTER
        elif kind[0] == "N":
            table[code] = _DIGIT
        elif kind[0] == "Z" or code in range(9, 14):
            table[code] = _SPACE
        elif kind[0] in "PS":
            table[code] = _SYMBOL
    for text, kind in ((".,;:'\"()-?", _STOP), ("!", _BANG)):
        table[[ord(c) for c in text]] = kind
    return table


def _own_features(lines: list[str], seen: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """What lines say of themselves, and their lengths; ``seen`` holds the lines before them."""
    n = len(lines)
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[np.minimum(codes, (1 << 16) - 1)]
    size = np.fromiter(map(len, lines), np.int64, n)
    at = np.repeat(np.arange(n), size + (np.arange(n) < n - 1))
    counts = np.bincount(at * 8 + kinds, minlength=n * 8).reshape(n, 8).astype(float)
    words, distinct, stutter, again = (np.zeros(n) for _ in range(4))
    for i, line in enumerate(lines):
        w = line.split()
        if w:
            words[i], distinct[i] = len(w), len(set(w))
            stutter[i] = sum(map(str.__eq__, w, w[1:]))
            again[i] = line in seen
            seen.add(line)
    some, each = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(counts[:, _LETTER] + counts[:, _UPPER], 1)
    own = np.column_stack([
        np.minimum(10 * counts[:, _SYMBOL] / some, 3),
        np.minimum(10 * counts[:, _BANG] / some, 3),
        counts[:, _UPPER] / letters,
        stutter / each,
        1 - distinct / each,
        again,
        counts[:, _DIGIT] / some,
        counts[:, _STOP] / some,
        (counts[:, _LETTER] + counts[:, _UPPER]) / some,
        np.log1p(size) / 10,
        np.minimum(size / each, 30) / 10,
        words < 5,
    ])
    return own, size


def line_parts(text: str | None, at_once: int = LINES_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A row of features and a length for each line of a text, in parts of ``at_once`` lines; at least one line."""
    lines, seen = (text or "").split("\n"), set()
    starts = list(range(0, len(lines), at_once))
    none = np.zeros((1, _CONTEXT))
    before, own = none, _own_features(lines[:at_once], seen)
    for k, start in enumerate(starts):
        after = _own_features(lines[starts[k + 1] : starts[k + 1] + at_once], seen) if k + 1 < len(starts) else None
        mine, size = own
        beside = mine[:, :_CONTEXT]
        edge = np.zeros((len(mine), 2))
        edge[0, 0], edge[-1, 1] = start == 0, after is None
        following = none if after is None else after[0][:1, :_CONTEXT]
        yield np.column_stack([np.ones(len(mine)), mine, np.vstack([before, beside[:-1]]), np.vstack([beside[1:], following]), edge]), size
        before, own = beside[-1:], after


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    parts = list(line_parts(text))
    return np.vstack([x for x, _ in parts]), np.concatenate([n for _, n in parts])


class Chains:
    """Sequences laid out step by step: step t holds line t of every sequence that has one, longest sequences first."""

    def __init__(self, lengths: list[int]):
        self.lengths = np.array(lengths, np.int64)
        self.order = np.argsort(-self.lengths, kind="stable")
        longest = int(self.lengths.max()) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths[self.order], -np.arange(1, longest + 1), side="right")
        self.step = np.concatenate(([0], np.cumsum(self.active))).astype(np.int64)
        #: Where each line, in reading order, lies in this layout.
        first = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64) if len(lengths) else np.array([], np.int64)
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        owner = np.repeat(np.arange(len(lengths)), self.lengths)
        self.place = self.step[np.arange(len(owner)) - first[owner]] + rank[owner]
        self.owner = owner
        #: By place, which of the sequences in order of length a line is of.
        self.rank = np.concatenate([np.arange(n) for n in self.active]) if longest else np.array([], np.int64)

    def messages(self, emission: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log messages of both labels, and each sequence's log partition (by length)."""
        forward, backward = np.zeros((2, len(emission))), np.zeros((2, len(emission)))
        forward[1] = emission
        steps = len(self.active)
        for t in range(1, steps):
            n, before, now = self.active[t], self.step[t - 1], self.step[t]
            back = forward[:, before : before + n]
            forward[0, now : now + n] = np.logaddexp(back[0] + pair[0, 0], back[1] + pair[1, 0])
            forward[1, now : now + n] += np.logaddexp(back[0] + pair[0, 1], back[1] + pair[1, 1])
        for t in range(steps - 1, 0, -1):
            n, before, now = self.active[t], self.step[t - 1], self.step[t]
            bad, good = backward[0, now : now + n], backward[1, now : now + n] + emission[now : now + n]
            backward[0, before : before + n] = np.logaddexp(bad + pair[0, 0], good + pair[0, 1])
            backward[1, before : before + n] = np.logaddexp(bad + pair[1, 0], good + pair[1, 1])
        total = np.logaddexp(forward[0, : len(self.lengths)] + backward[0, : len(self.lengths)], forward[1, : len(self.lengths)] + backward[1, : len(self.lengths)])
        return forward, backward, total

    def by_place(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.place] = values
        return out


@dataclass
class Field:
    """Weights of a line's features for good over bad, and of label pairs (before, after)."""

    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, features: np.ndarray, chains: Chains) -> np.ndarray:
        """P(good) of every line, in reading order."""
        return self._good(features @ self.weights, chains)

    def _good(self, emission: np.ndarray, chains: Chains) -> np.ndarray:
        forward, backward, total = chains.messages(chains.by_place(emission), self.pair)
        return np.exp(forward[1] + backward[1] - total[chains.rank])[chains.place]

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, Chains]:
        """P(good) and length of every line of the texts, and their layout; features are held for LINES_AT_ONCE lines of a text."""
        emission, sizes, lengths = [], [], []
        for t in texts:
            lengths.append(0)
            for x, size in line_parts(t):
                emission.append(x @ self.weights)
                sizes.append(size)
                lengths[-1] += len(size)
        chains = Chains(lengths)
        return self._good(np.concatenate(emission), chains), np.concatenate(sizes), chains

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.array([])
        good, size, chains = self.lines(texts)
        n, weight = len(texts), size + 1.0
        return np.clip(np.bincount(chains.owner, good * weight, n) / np.bincount(chains.owner, weight, n), 0, 1)


def expectations(emission: np.ndarray, pair: np.ndarray, chains: Chains, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) by place, expected label pairs weighted by each sequence's ``share``, and log partitions (by length)."""
    forward, backward, total = chains.messages(emission, pair)
    good = np.exp(forward[1] + backward[1] - total[chains.rank])
    pairs = np.zeros((2, 2))
    for t in range(1, len(chains.active)):
        n, before, now = chains.active[t], chains.step[t - 1], chains.step[t]
        tail = (backward[0, now : now + n], backward[1, now : now + n] + emission[now : now + n])
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] += (np.exp(forward[a, before : before + n] + pair[a, b] + tail[b] - total[:n]) * share[:n]).sum()
    return good, pairs, total


def _shares(chains: Chains) -> np.ndarray:
    """Every document weighs alike, and every line of a document."""
    return 1.0 / chains.lengths[chains.order] / len(chains.lengths)


def _penalties(width: int) -> np.ndarray:
    """The weight of each feature's square: more for what neighbouring lines say."""
    out = np.full(width, PENALTY)
    if width > 2 + 2 * _CONTEXT:
        out[-2 - 2 * _CONTEXT : -2] = BESIDE_PENALTY
    return out


def loss_and_slope(field: Field, features: np.ndarray, chains: Chains, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood by line of labels passed down, and its slope; ``features`` laid out by place, a label for each sequence."""
    share, y = _shares(chains), labels[chains.order].astype(float)
    good, pairs, total = expectations(emission := features @ field.weights, field.pair, chains, share)
    label, part = y[chains.rank], share[chains.rank]
    more = (chains.lengths[chains.order] - 1) * share
    gold = np.bincount(chains.rank, label * emission, len(labels)) + (chains.lengths[chains.order] - 1) * np.where(y > 0, field.pair[1, 1], field.pair[0, 0])
    told = np.diag([(more * (y == 0)).sum(), (more * (y == 1)).sum()])
    loss = ((total - gold) * share).sum() + (_penalties(len(field.weights)) * field.weights**2).sum() / 2 + PAIR_PENALTY / 2 * (field.pair**2).sum()
    return loss, features.T @ ((good - label) * part) + _penalties(len(field.weights)) * field.weights, pairs - told + PAIR_PENALTY * field.pair


def constrained(field: Field, features: np.ndarray, chains: Chains, labels: np.ndarray) -> np.ndarray:
    """Emissions by place of the nearest distribution over line labels in which every document keeps to what its label says.

    The nearest one (in relative entropy) adds to a document's emissions a
    multiple of its lines' lengths; the multiple is 0 where the share of good
    lines is right as it is, else it is found by bisection.
    """
    emission, rank, n = features @ field.weights, chains.rank, len(labels)
    length = np.expm1(10 * features[:, _SIZE]) + 1
    whole = np.bincount(rank, length, n)
    weight = length * (chains.lengths[chains.order] / whole)[rank]
    y = labels[chains.order]
    sign, bound = np.where(y > 0, 1.0, -1.0), np.where(y > 0, GOOD_SHARE, BAD_SHARE)

    def wrong(multiple: np.ndarray) -> np.ndarray:
        forward, backward, total = chains.messages(emission + (sign * multiple)[rank] * weight, field.pair)
        share = np.bincount(rank, np.exp(forward[1] + backward[1] - total[rank]) * length, n) / whole
        return sign * share < sign * bound

    low, high = np.zeros(n), np.where(wrong(np.zeros(n)), 32.0, 0.0)
    for _ in range(9):
        middle = (low + high) / 2
        over = wrong(middle)
        low, high = np.where(over, middle, low), np.where(over, high, middle)
    return emission + (sign * high)[rank] * weight


def fit(samples: list[tuple[np.ndarray, int]]) -> Field:
    """The field for ``(features, label)`` of each sampled document; without samples every score is a half."""
    width = samples[0][0].shape[1] if samples else line_features("")[0].shape[1]
    field = Field(np.zeros(width), np.zeros((2, 2)))
    if not samples:
        return field
    chains, labels = Chains([len(x) for x, _ in samples]), np.array([y for _, y in samples])
    features, share = chains.by_place(np.vstack([x for x, _ in samples])), _shares(chains)
    part = share[chains.rank]

    def follow(field: Field, rounds: int, slope_of) -> Field:
        mean = [np.zeros(width + 4), np.zeros(width + 4)]
        for k in range(1, rounds + 1):
            slope = np.concatenate([x.ravel() for x in slope_of(field)])
            mean = [0.9 * mean[0] + 0.1 * slope, 0.999 * mean[1] + 0.001 * slope**2]
            move = STEP * (mean[0] / (1 - 0.9**k)) / (np.sqrt(mean[1] / (1 - 0.999**k)) + 1e-8)
            field = Field(field.weights - move[:width], field.pair - move[width:].reshape(2, 2))
        return field

    field = follow(field, ROUNDS, lambda f: loss_and_slope(f, features, chains, labels)[1:])
    for _ in range(TURNS):
        wanted, told, _ = expectations(constrained(field, features, chains, labels), field.pair, chains, share)

        def slope(f: Field, wanted=wanted, told=told) -> tuple[np.ndarray, np.ndarray]:
            good, pairs, _ = expectations(features @ f.weights, f.pair, chains, share)
            return features.T @ ((good - wanted) * part) + _penalties(width) * f.weights, pairs - told + PAIR_PENALTY * f.pair

        field = follow(field, TURN_ROUNDS, slope)
    return field


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", line_bytes=_LINE_BYTES):
            made = [line_features(t)[0].ravel().astype(np.float32) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float32())), part.column("quality")], ["x", "quality"])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> Field:
    """A field from the texts of at most ``limit`` labelled documents with at most ``lines`` lines.

    Only rows of ``labels (doc_id, quality)`` with a label and with crc32 of
    the doc_id, as text, not 1 modulo 3 are ever used. The sample is those with
    the least hashes, up to the bounds; both are fixed, so the sample can be
    sent to every task, and its features (160 bytes a line) to the driver.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    sample = usable.select("doc_id", F.col("quality").cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality", (F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    texts = checkpointed(texts.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "text").limit(limit))
    upto = F.sum("lines").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "text"))  # over the sample's rows
    rows = texts.withColumn("upto", upto).where(F.col("upto") <= lines).select("text", "quality").mapInArrow(_feature_batches, "x array<float>, quality int").collect()
    width = line_features("")[0].shape[1]
    samples = [(np.array(r.x).reshape(-1, width), r.quality) for r in rows]
    return fit(sorted(samples, key=lambda s: (len(s[0]), s[1], s[0].tobytes())))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``: only the text counts.

    score is from 0 to 1, higher where good is likelier. Null and empty texts
    are one empty line. Texts are scored whole, whatever their length. Repeated
    rows and null doc_ids are rows like any other.
    """

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", line_bytes=100):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(field.scores(part.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score_batches, "doc_id long, score double")
