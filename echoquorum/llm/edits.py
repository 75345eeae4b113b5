"""Operator 5, token counts that follow edits.

A text's pre-tokens (pieces that a byte-pair tokenizer encodes one by one) are grouped into leaves of a segment tree,
whose nodes hold the characters and the tokens below them. An edit splits and encodes again only the leaves it touches
and some context before them, up to the first place at or after the edit where a new pre-token starts at the start of
an old leaf; from there on nothing can have changed. Then the sums on the way to the root are updated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

LEAF = 64
#: Pre-tokens whose number of tokens a Python worker remembers, and the longest that is remembered.
REMEMBERED, LONGEST = 500_000, 64
EDIT = "struct<pos:int,drop:int,put:string>"


class Pretokens:
    """Splits with a pattern that tiles any text and looks ahead at most three characters or over a run of white space."""

    def __init__(self, path: str, pattern: str):
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def sizes(self, pieces: list[str]) -> list[int]:
        """Number of tokens of each pre-token."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = list(map(known.get, pieces))
        for i, n in enumerate(out) if None in out else ():
            if n is None:
                p = pieces[i]
                out[i] = known.get(p) or len(self.encoding.encode_ordinary(p))
                if len(p) <= LONGEST:
                    known[p] = out[i]
        return out


@cache
def pretokens(path: str, pattern: str) -> Pretokens:
    return Pretokens(path, pattern)


class Tree:
    """Sums of characters and tokens over leaves; node 1 is the root, the leaves are the nodes from ``cap`` on."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.n = max(1, len(chars))
        self.cap = 1 << (self.n - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.cap), np.int64)
        self.sums[0, self.cap : self.cap + len(chars)] = chars
        self.sums[1, self.cap : self.cap + len(tokens)] = tokens
        width = self.cap
        while width > 1:
            self.sums[:, width // 2 : width] = self.sums[:, width : 2 * width].reshape(2, -1, 2).sum(axis=2)
            width //= 2

    @classmethod
    def of(cls, text: str, split: Pretokens) -> Tree:
        pieces = split.pattern.findall(text)
        if not pieces:
            return cls(np.zeros(0, np.int64), np.zeros(0, np.int64))
        starts = np.arange(0, len(pieces), LEAF)
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return cls(np.add.reduceat(chars, starts), np.add.reduceat(np.array(split.sizes(pieces), np.int64), starts))

    def to_bytes(self) -> bytes:
        """Number of leaves, then the tree's nodes: characters and tokens."""
        return np.int64(self.n).tobytes() + self.sums.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tree:
        self = cls.__new__(cls)
        self.n = int(np.frombuffer(raw, np.int64, 1)[0])
        self.sums = np.frombuffer(raw, np.int64, offset=8).reshape(2, -1).copy()
        self.cap = self.sums.shape[1] // 2
        return self

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf with character ``pos`` (the last one if there's none) and the characters before it."""
        node, before = 1, 0
        while node < self.cap:
            node *= 2
            if pos - before >= self.sums[0, node] and self.sums[0, node + 1]:
                before += int(self.sums[0, node])
                node += 1
        return node - self.cap, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.cap
        change = np.array([chars, tokens]) - self.sums[:, node]
        while node:
            self.sums[:, node] += change
            node //= 2


def edit(text: str, tree: Tree, pos: int, drop: int, put: str, split: Pretokens) -> tuple[str, Tree, int]:
    """The text and tree after ``drop`` characters at ``pos`` gave way to ``put``, and the number of pre-tokens encoded.

    pos and drop are clipped to the text.
    """
    pos = min(max(pos, 0), len(text))
    end = min(pos + max(drop, 0), len(text))
    new, grown = text[:pos] + put + text[end:], len(put) - (end - pos)
    if not new or not text:
        tree = Tree.of(new, split)
        return new, tree, tree.tokens and len(split.pattern.findall(new))
    first, start = tree.leaf_at(max(pos - 1, 0))
    # Nothing before ``start`` may have looked as far as the edit.
    while start > 0 and (pos - start < 8 or text[start : pos - 3].isspace()):
        first, start = tree.leaf_at(start - 1)
    # Scan the new text until a pre-token starts where an old leaf did.
    last, edge = tree.leaf_at(end)
    if edge < end:
        edge += int(tree.sums[0, tree.cap + last])
    pieces, at = [], start
    for m in split.pattern.finditer(new, start):
        while edge + grown < m.start() and edge < len(text):
            edge += int(tree.sums[0, tree.cap + tree.leaf_at(edge)[0]])
        if m.start() == edge + grown and edge >= end:
            break
        pieces.append(m[0])
        at = m.end()
    after = tree.leaf_at(edge)[0] if edge < len(text) and at == edge + grown else tree.n
    n, sizes = after - first, split.sizes(pieces)
    if len(pieces) > 2 * LEAF * n:  # the leaves would become too large: build the tree again from its leaves
        leaves = tree.sums[:, tree.cap : tree.cap + tree.n]
        groups = [(pieces[i : i + LEAF], sizes[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]
        own = np.array([[sum(map(len, p)) for p, _ in groups], [sum(s) for _, s in groups]], np.int64)
        merged = np.concatenate([leaves[:, :first], own, leaves[:, after:]], axis=1)
        return new, Tree(merged[0], merged[1]), len(pieces)
    for k in range(n):  # as many leaves as before; trailing ones may become empty
        lo, hi = k * len(pieces) // n, (k + 1) * len(pieces) // n
        tree.put(first + k, sum(map(len, pieces[lo:hi])), sum(sizes[lo:hi]))
    return new, tree, len(pieces)


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, tree, n_tokens, and the columns ``extra``) for every row; a null text counts as empty.

    Repeated rows each get a row, an empty table gives an empty result, and other columns play no part. A name in
    ``extra`` that is one of the result's raises ValueError. Memory holds one Arrow batch and its trees.
    """
    extra = extra or {}
    if taken := {c.lower() for c in extra} & {"doc_id", "text", "tree", "n_tokens"}:
        raise ValueError(f"extra columns must not be named like results: {sorted(taken)}")
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[c.alias(n) for n, c in extra.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pretokens(tokenizer, pattern)
        for b in batches:
            trees = [Tree.of(t.as_py(), split) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([t.to_bytes() for t in trees], pa.binary()), pa.array([t.tokens for t in trees], pa.int64())],
                names=[*b.schema.names, "tree", "n_tokens"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)
    return src.mapInArrow(tidy(run), f"{fields}, tree binary, n_tokens long")


def apply_edits(counted: DataFrame, tokenizer: str, pattern: str, edits: str = "edits") -> DataFrame:
    """Apply each row's ``edits`` (array of EDIT, in order) to what ``count_tokens`` returned.

    Returns (doc_id, text, tree, n_tokens, n_tokens_before, n_encoded): the edited text, its tree and count, the count
    before, and the pre-tokens encoded for the edits. Positions are in characters of the text as it then is and are
    clipped to it; null edits, or an edit with a null in it, change nothing; repeated rows each get a row.
    """
    src = counted.select("doc_id", "text", "tree", "n_tokens", F.col(edits).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pretokens(tokenizer, pattern)
        for b in batches:
            texts, trees, counts, encoded = [], [], [], []
            for t, raw, todo in zip(b.column("text"), b.column("tree"), b.column("edits")):
                text, tree, n = t.as_py(), Tree.from_bytes(raw.as_py()), 0
                for e in todo.as_py() or ():
                    if e and None not in e.values():
                        text, tree, k = edit(text, tree, e["pos"], e["drop"], e["put"], split)
                        n += k
                for c, x in zip((texts, trees, counts, encoded), (text, tree.to_bytes(), tree.tokens, n)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(texts, pa.string()), pa.array(trees, pa.binary()), pa.array(counts, pa.int64()), b.column("n_tokens"), pa.array(encoded, pa.int64())],
                names=["doc_id", "text", "tree", "n_tokens", "n_tokens_before", "n_encoded"],
            )

    kind = counted.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(tidy(run), f"doc_id {kind}, text string, tree binary, n_tokens long, n_tokens_before long, n_encoded long")
