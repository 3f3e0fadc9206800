"""Secret scans with multipart credential linking.

One pass over the texts takes out certain spans (assigned secrets, access
identifiers, long hex runs) and weak parts, which mean little alone: user
names, random-looking strings, service addresses. Parts are then interval
joined within a scope, a stretch of text around each, and a weak part is
reported only where the parts that complete it are near.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import checkpointed, slices

#: Span kinds in the order of their listing; the first three are always reported.
KINDS = ["assign", "access", "hex", "random", "user", "endpoint"]
#: What a kind contributes to a credential.
PARTS = {"assign": "secret", "access": "identifier", "hex": "secret", "random": "secret", "user": "identifier", "endpoint": "endpoint"}
#: Parts that must be near a weak part.
NEEDS = {"random": ["identifier"], "user": ["secret"], "endpoint": ["identifier", "secret"]}
#: Code points between two parts of one credential at most.
SCOPE = 200

# Fixed values.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN, MIN_ACCESS = 6, 20

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_access = re.compile(ACCESS)
_hex = re.compile(HEX)
_user = re.compile(r"""(?:user(?:name|_id)?|login|account(?:_id)?|client_id|access_key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""", re.ASCII | re.IGNORECASE)
_random = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_endpoint = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~%@:\[\]-]{3,}|\b\d{1,3}(?:\.\d{1,3}){3}:\d{2,5}\b", re.ASCII)
#: What a text must hold for any of a group's expressions to match; RE2 finds it in one linear pass.
_ASSIGN_HINT = r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]"""
_WEAK_HINT = r"""(?i)(user|name|login|account|_id)["']? *[:=]|://|[0-9]:[0-9]|[a-z0-9+/_-]{32}"""
_ENTROPY_BITS = 3.5


def _looks_random(token: str) -> bool:
    n = len(token)
    if not (re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)):
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= _ENTROPY_BITS


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the certain spans, leftmost and non-overlapping within a kind, in code points."""
    spans = []
    if assign:
        spans += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if access:
        spans += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if hexes:
        spans += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]  # a run of 24 or more is a greedy run that doesn't fail
    return sorted(spans)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that overlap no certain span and no weak part found before."""
    taken, spans = _merged((a, z) for a, _, z in base), []
    for kind, pattern in ((4, _user), (5, _endpoint), (3, _random)):
        new = []
        for m in pattern.finditer(text):
            a, z = m.span()
            at = bisect_left(taken, (z,)) - 1  # the last taken stretch that begins before the match ends
            if at >= 0 and taken[at][1] > a or kind == 3 and not _looks_random(m[0]):
                continue
            new.append((a, z))  # matches of one kind don't overlap
            spans.append((a, kind, z))
        taken = _merged([*taken, *new])
    return sorted(spans)


def _merged(spans) -> list[tuple[int, int]]:
    """The stretches of text that the spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = pc.fill_null(part.column("text"), "")
            hints = [pc.match_substring_regex(texts, _ASSIGN_HINT), pc.match_substring(texts, "AKIA"), pc.match_substring_regex(texts, "[0-9a-f]{24}"), pc.match_substring_regex(texts, _WEAK_HINT)]
            some = pc.or_(pc.or_(hints[0], hints[1]), pc.or_(hints[2], hints[3]))
            base, weak = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
            for i in pc.indices_nonzero(some).to_pylist():
                text = texts[i].as_py()
                base[i] = base_spans(text, *(h[i].as_py() for h in hints[:3]))
                if hints[3][i].as_py():
                    weak[i] = weak_spans(text, base[i])
            shaped = [pa.array([[dict(zip(("start", "kind", "end"), s)) for s in spans] for spans in x], _SPANS) for x in (base, weak)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *shaped], ["doc_id", "base", "weak"])


def _near(candidates: DataFrame, parts: DataFrame, role: str, scope: int) -> DataFrame:
    """The candidates with a part of ``role`` within ``scope`` code points: an interval join by buckets of text.

    A semi join: however many parts lie near, a candidate comes out once or not.
    """
    reach = parts.where(F.col("role") == role).select(F.col("row").alias("r"), F.col("start").alias("a"), F.col("end").alias("z"), F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("b"))
    reach = reach.distinct()
    spread = candidates.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    met = (F.col("row") == F.col("r")) & (F.col("bucket") == F.col("b")) & (F.col("a") <= F.col("end") + scope) & (F.col("z") >= F.col("start") - scope)
    other = (F.col("a") != F.col("start")) | (F.col("z") != F.col("end"))
    return spread.join(reach, met & other, "left_semi").drop("bucket").distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, base, linked)`` for every row of ``docs``: spans as arrays of ``(start, kind, end)`` sorted by start, then kind.

    ``base`` has the certain spans; ``linked`` the weak parts whose complement
    lies within ``scope`` code points: a random-looking string near an
    identifier, a user name near a secret, an address near both. kind is the
    place in KINDS; offsets are code points, ends exclusive. Null and empty
    texts have no spans. Texts are read whole; repeated rows and null doc_ids
    are rows like any other; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = "array<struct<start:int,kind:int,end:int>>"
    found = rows.mapInArrow(_scan_batches, f"doc_id long, base {kind}, weak {kind}").withColumn("row", F.monotonically_increasing_id())
    found = checkpointed(found)  # row numbers stay as they are from here on
    roles = F.array(*[F.lit(PARTS[k]) for k in KINDS])
    weak = found.where(F.size("weak") > 0)
    parts = weak.select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.*").withColumn("role", F.get(roles, "kind"))
    candidates = weak.select("row", F.explode("weak").alias("s")).select("row", "s.*")
    linked = None
    for name, needs in NEEDS.items():
        near = candidates.where(F.col("kind") == KINDS.index(name))
        for role in needs:
            near = _near(near, parts, role, scope)
        linked = near if linked is None else linked.union(near)
    linked = linked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    return found.join(linked, "row", "left").select("doc_id", "base", F.coalesce("linked", F.array().cast(kind)).alias("linked"))


def count_kind(spans, kind: int):
    """How many of the spans are of ``kind``; a second parameter of the lambda would be given the span's place."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def span_list(spans):
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
