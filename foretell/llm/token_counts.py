"""Token counts that follow edits: a segment tree of pre-token runs for every document.

A document's leaves are runs of whole pre-tokens; inner nodes hold the sums of
code points and tokens below them. An edit re-encodes only the leaves that it
touches, with the boundary context at both ends, splices the new leaves in and
updates the sums on the path to the root.

Leaves are cut only between a character that isn't white space and a blank, tab
or line end. The pre-token pattern never reaches across such a place, and what
it finds from there on depends on nothing before. So the leaves' counts add up
to the whole text's, and a leaf boundary whose two characters an edit leaves
alone stays a boundary: nothing beyond it has to be looked at again.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import slices

#: Vocabulary file of the production query: byte-level BPE as ranks. Every executor must have it, or it must lie in a shared folder;
#: operators take another path as a parameter, the environment variable names it for the query.
VOCABULARY = os.environ.get("TOKEN_VOCABULARY") or "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points of a leaf at least, but for the last one, and children of an inner node at most.
LEAF, FAN = 256, 16

_leaf = re.compile(rf".{{{LEAF - 1},}}?\S(?=[ \n\t\r])|.+", re.DOTALL)


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    """The tokenizer of a file of base64 tokens and ranks; read once in a worker."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def split_leaves(text: str) -> list[str]:
    return _leaf.findall(text)


class Tree:
    """Nodes ``[children, chars, tokens]``, leaves without children; kept as levels, from the leaves up to the root, of ``[number of children, chars, tokens]``."""

    def __init__(self, levels: list[list[list[int]]]):
        nodes = [[None, chars, tokens] for _, chars, tokens in levels[0]]
        for level in levels[1:]:
            below, at, nodes = nodes, 0, []
            for children, chars, tokens in level:
                nodes.append([below[at : at + children], chars, tokens])
                at += children
        self.root, self.height = (nodes[0] if nodes else [[], 0, 0]), max(len(levels) - 1, 1)

    @classmethod
    def build(cls, text: str, encoding: tiktoken.Encoding) -> Tree:
        tree = cls([[]])
        tree._rise(_encoded(text, encoding))
        return tree

    def _rise(self, nodes: list) -> None:
        """Put nodes one level above the leaves, or higher, under one root."""
        self.height = 1
        nodes = [[nodes, sum(n[1] for n in nodes), sum(n[2] for n in nodes)]] if len(nodes) <= FAN else _grouped(nodes)
        while len(nodes) > 1:
            nodes = _grouped(nodes)
            self.height += 1
        self.root = nodes[0]

    @property
    def tokens(self) -> int:
        return self.root[2]

    @property
    def levels(self) -> list[list[list[int]]]:
        """The tree as it is kept; an empty text's has no leaves and no root."""
        if not self.root[0]:
            return [[], []]
        out, nodes = [], [self.root]
        for _ in range(self.height):
            out.append([[len(n[0]), n[1], n[2]] for n in nodes])
            nodes = [child for n in nodes for child in n[0]]
        return [[[0, n[1], n[2]] for n in nodes], *reversed(out)]

    @staticmethod
    def _child(node: list, start: int, offset: int) -> tuple[int, int]:
        """The child that holds code point ``offset``, or the last one: its number and its place."""
        for k, child in enumerate(node[0]):
            if offset < start + child[1] or k + 1 == len(node[0]):
                return k, start
            start += child[1]
        raise ValueError("no children")

    def _leaf(self, offset: int) -> tuple[int, int]:
        """Where the leaf that holds code point ``offset``, or the last one, begins and ends."""
        node, at = self.root, 0
        while node[0] is not None:
            k, at = self._child(node, at, offset)
            node = node[0][k]
        return at, at + node[1]

    def _spliced(self, node: list, height: int, start: int, first: int | None, last: int | None, leaves: list) -> list:
        """Nodes in place of ``node`` with ``leaves`` for those from the one that holds ``first`` to the one that holds ``last`` (None: to its ends)."""
        children = node[0]
        a, low = (0, start) if first is None else self._child(node, start, first)
        z, high = (len(children) - 1, start + node[1] - children[-1][1]) if last is None else self._child(node, start, last)
        if height == 1:
            new = leaves
        elif a == z:
            new = self._spliced(children[a], height - 1, low, first, last, leaves)
        else:
            new = self._spliced(children[a], height - 1, low, first, None, leaves) + self._spliced(children[z], height - 1, high, None, last, [])
        return _grouped([*children[:a], *new, *children[z + 1 :]])

    def edit(self, text: str, at: int, deleted: int, inserted: str, encoding: tiktoken.Encoding) -> tuple[str, int]:
        """The text with ``deleted`` code points at ``at`` replaced by ``inserted``, and how many code points were encoded for it.

        Places beyond the text's ends are moved to them. Only nodes on the
        paths to the touched leaves are looked at and made anew.
        """
        at = min(max(at, 0), len(text))
        end = min(at + max(deleted, 0), len(text))
        if at == end and not inserted:
            return text, 0
        if not text:
            self._rise(_encoded(inserted, encoding))
            return inserted, len(inserted)
        low, _ = self._leaf(max(at - 1, 0))  # begins before the edit, so both characters at its left end stay
        _, high = self._leaf(end)  # ends behind the character after the edit, so both at its right end stay
        touched = text[low:at] + inserted + text[end:high]
        nodes = self._spliced(self.root, self.height, 0, max(at - 1, 0), end, _encoded(touched, encoding))
        while len(nodes) > 1:
            nodes = _grouped(nodes)
            self.height += 1
        while nodes and self.height > 1 and len(nodes[0][0]) == 1:
            nodes = nodes[0][0]
            self.height -= 1
        if nodes:
            self.root = nodes[0]
        else:
            self._rise([])
        return text[:at] + inserted + text[end:], len(touched)


def _grouped(nodes: list[list[int]]) -> list[list[int]]:
    parts = -(-len(nodes) // FAN)
    cuts = [len(nodes) * k // parts for k in range(parts + 1)] if parts else [0]
    return [[nodes[a:z], sum(n[1] for n in nodes[a:z]), sum(n[2] for n in nodes[a:z])] for a, z in zip(cuts, cuts[1:])]


def _encoded(text: str, encoding: tiktoken.Encoding) -> list[list[int]]:
    return [[None, len(x), len(encoding.encode_ordinary(x))] for x in split_leaves(text)]


_TREE = "array<array<array<int>>>"
_TREE_ARROW = pa.list_(pa.list_(pa.list_(pa.int32())))


def index(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of ``docs`` and ``tree``, the segment tree of the whole text; a table that can be kept and edited later.

    Null texts have the tree of an empty text, without leaves. A column named
    tree gives way. ``vocabulary`` is a file that every executor can read.
    """
    docs = docs.drop("tree")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                trees = [Tree.build(t or "", encoding).levels for t in part.column("text").to_pylist()]
                yield part.append_column("tree", pa.array(trees, _TREE_ARROW))

    fields = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    return docs.mapInArrow(build, f"{fields}, tree {_TREE}")


def with_edits(indexed: DataFrame, log: DataFrame) -> DataFrame:
    """``indexed`` with ``edits``, the edits of each document from ``log (doc_id, seq, at, n_deleted, inserted)``.

    One document's edits follow each other, so they meet in one row. Edits of
    documents that aren't there, or with a null doc_id, have no effect.
    """
    edit = F.struct(*[F.col(c) for c in ("seq", "at", "n_deleted", "inserted")])
    lists = log.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    return indexed.drop("edits").join(lists, "doc_id", "left")


def recount(indexed: DataFrame, vocabulary: str = VOCABULARY, results: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_chars_encoded, text_edited, tree_edited)`` for each row of ``indexed (doc_id, text, tree, edits)``.

    ``edits`` is an array of ``(seq, at, n_deleted, inserted)``, in that order;
    each counts code points in the text that the ones before it left, and places
    beyond the text are moved to its ends. Null fields count as 0 and as
    nothing inserted; null or no edits leave the counts as they are.
    n_chars_encoded is what the edits had to encode, never the whole text
    unless an edit spans it or it has no place to be cut. Null texts count as
    empty. Repeated rows and null doc_ids are rows like any other. Without
    ``results`` the last two columns are left out.
    """
    names = ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded", "text_edited", "tree_edited"]
    kinds = [pa.int64()] * 5 + [pa.string(), _TREE_ARROW]
    width = len(names) if results else 5
    rows = indexed.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "tree", F.expr("transform(edits, e -> struct(cast(e.at as long) as at, cast(e.n_deleted as long) as n_deleted, cast(e.inserted as string) as inserted))").alias("edits"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc, text, levels, edits in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "tree", "edits"))):
                    text, tree, encoded = text or "", Tree(levels), 0
                    before = tree.tokens
                    for e in edits or ():
                        text, n = tree.edit(text, e["at"] or 0, e["n_deleted"] or 0, e["inserted"] or "", encoding)
                        encoded += n
                    out.append((doc, before, tree.tokens, len(text), encoded, text, tree.levels)[:width])
                columns = list(zip(*out)) if out else [()] * width
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[:width])

    numbers = ", ".join(f"{n} long" for n in names[:5])
    return rows.mapInArrow(follow, f"{numbers}, text_edited string, tree_edited {_TREE}" if results else numbers)
