"""Operator 2, benchmark decontamination with an Aho-Corasick automaton.

Every benchmark item is cut into windows of 13 words; all windows form one automaton. A document is normalised once
(lower case, single spaces between words), scanned once, and the matches are mapped back to words and, for the spans,
to character offsets of the original text.

The automaton is held by every Python worker (built once there, not once a task), so its size is checked: items whose
windows may need more than ``max_nodes`` nodes in all are dealt by a hash of their id into several automata, and the
documents are scanned once for each of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, scratch, tidy

WINDOW = 13
#: All ASCII but letters and digits separates words; A-Z become a-z; bytes of other characters are word bytes.
_TABLE = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256)
)

HITS = "array<struct<first:int,last:int,item:string>>"
#: Nodes of the largest automaton: some 70 bytes each with their edges.
MAX_NODES = 4_000_000
#: The automaton that this Python worker built last, by the name of its part.
_built: dict[str, object] = {}


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows(text: str | None) -> set[bytes]:
    w = words(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))}


def build(items: list[tuple[str, str | None]]):
    """One automaton over the windows of all items; the value of a window is (number of words, its items' ids)."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(text):
            owners.setdefault(w, set()).add(item)
    automaton = ahocorasick.Automaton()
    for w, ids in owners.items():
        # A space on either side makes matches whole words; bytes become characters one to one.
        automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(ids))))
    if owners:
        automaton.make_automaton()
    return automaton if owners else None


def scan(automaton, text: str | None) -> tuple[int, list[tuple[int, int, str]]]:
    """Number of words, and (first word, last word, item) of each occurrence of a window."""
    w = words(text)
    if automaton is None or not w:
        return len(w), []
    line = b" " + b" ".join(w) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return len(w), []
    # The space before word i stands at the sum of the lengths of the words before it, each with its space.
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    out = []
    for end, (n, ids) in found:
        last = int(np.searchsorted(spaces, end)) - 1
        out += [(last - n + 1, last, i) for i in ids]
    return len(w), out


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets (begin, end) in the original text of each run of hit words."""
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    runs = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [(int(chars[begins[a]]), int(chars[ends[b - 1]])) for a, b in zip(runs[::2], runs[1::2])]


def automaton_of(patterns):
    """The automaton of a named broadcast list of (item, text), built once in each worker."""
    name, items = patterns
    if name not in _built:
        _built.clear()
        _built[name] = build(items.value)
    return _built[name]


def parts_of(benchmark: DataFrame, item: str, item_text: str, max_nodes: int) -> list:
    """Named broadcast lists of (item, text), each for an automaton of at most ``max_nodes`` nodes (an item is never divided).

    A word stands in at most 13 windows, which bounds an item's nodes by 13 times its bytes.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("t")).filter("item IS NOT NULL AND t IS NOT NULL")
    nodes = WINDOW * ((items.agg(F.sum(F.octet_length("t") + 2)).first()[0]) or 0)
    n = max(1, -(-nodes // max_nodes))
    own = lambda k: items if n == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
    # Each list holds about max_nodes / 13 bytes of text.
    return [(uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([(r.item, r.t) for r in own(k).collect()])) for k in range(n)]


def judge(text: str | None, n_words: int, found: list[tuple[int, int, str]], with_spans: bool = True) -> tuple[int, list[str], list[tuple[int, int]]]:
    """Words hit, items found, and the places of the hit passages in the text."""
    if not found:
        return 0, [], []
    mark = np.zeros(n_words, bool)
    for first, last, _ in found:
        mark[first : last + 1] = True
    return int(mark.sum()), sorted({i for _, _, i in found}), spans(text, mark) if with_spans else []


def _earlier_hits(src: DataFrame, parts: list, column: str, hits: str) -> DataFrame:
    """``src`` with the hits of all ``parts`` in the column ``hits``; one pass for each of them."""
    out = src.withColumn(hits, F.array().cast(HITS))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.string())]))
    for patterns in parts:

        def run(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            automaton = automaton_of(patterns)
            for b in batches:
                at = b.schema.names.index(hits)
                new = [old + [{"first": x, "last": y, "item": i} for x, y, i in scan(automaton, t.as_py())[1]] for t, old in zip(b.column(column), b.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(new, kind), *b.columns[at + 1 :]], names=b.schema.names)

        out = scratch(out.mapInArrow(tidy(run), out.schema), "hits")
    return out


def _scanned(b: pa.RecordBatch, column: str, hits: str | None, patterns) -> Iterator[tuple[str | None, int, list[tuple[int, int, str]]]]:
    """(text, number of words, all hits) of each row of a batch."""
    automaton = automaton_of(patterns)
    texts, earlier = b.column(column), b.column(hits) if hits else None
    for i in range(b.num_rows):
        t = texts[i].as_py()
        n, found = scan(automaton, t)
        if earlier is not None and len(old := earlier[i].as_py()):
            found += [(x["first"], x["last"], x["item"]) for x in old]
        yield t, n, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", min_percent: int = 5, max_nodes: int = MAX_NODES, keep: list[str] | None = None) -> DataFrame:
    """Judge every row of ``docs`` against the benchmark.

    Returns the columns ``keep`` (default: all but those named like a result) and n_words, n_hit (words inside any occurrence of a window), items
    (ids of the items found, as strings in order), spans (begin and end of each hit passage, in characters of the
    original text) and contaminated (n_hit > 0 and 100 * n_hit >= min_percent * n_words). Cases: a null, empty or
    wordless text has no words and isn't contaminated; items that are null or wordless are left out; items of less
    than 13 words are one window; items with equal windows are all reported; repeated rows each get a row; an empty
    table gives an empty result; a column of ``keep`` that is named like a result raises ValueError. Memory holds one
    text at a time beside its Arrow batch and the automaton.
    """
    results = {"n_words", "n_hit", "items", "spans", "contaminated"}
    keep = [c for c in docs.columns if c.lower() not in results] if keep is None else keep
    if taken := {c.lower() for c in keep} & results:
        raise ValueError(f"columns named like results must not be in keep: {sorted(taken)}")
    *before, patterns = parts_of(benchmark, item, item_text, max_nodes)
    text_in = f"in_{keep.index(text)}" if text in keep else "text_"
    src = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(keep)], *([] if text in keep else [F.col(f"`{text}`").alias("text_")]))
    hits = "hits_" if before else None
    if before:
        src = _earlier_hits(src, before, text_in, hits)
    result = "n_words long, n_hit long, items array<string>, spans array<struct<begin:int,end:int>>"
    names = [f"in_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            words_, n_hit, items, places = [], [], [], []
            for t, n, found in _scanned(b, text_in, hits, patterns):
                k, own, where = judge(t, n, found)
                words_.append(n), n_hit.append(k), items.append(own)
                places.append([{"begin": x, "end": y} for x, y in where])
            out = [pa.array(words_, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(places, span)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *out], names=[*names, "n_words", "n_hit", "items", "spans"])

    kept = "".join(f"in_{i} {src.schema[f'in_{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    judged = src.mapInArrow(tidy(run), kept + result)
    return judged.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)],
        "n_words", "n_hit", "items", "spans",
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", min_percent: int = 5, max_nodes: int = MAX_NODES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, unchanged, whatever their columns are called.

    One pass over the rows' own columns; a batch is filtered, not built again. The cases are those of ``decontaminate``.
    """
    *before, patterns = parts_of(benchmark, item, item_text, max_nodes)
    src, hits = docs, None
    if before:
        (hits,) = fresh(docs, "hits_")
        src = _earlier_hits(docs, before, text, hits)

    def clean(b: pa.RecordBatch) -> list[bool]:
        hit = [(judge(t, n, found, with_spans=False)[0], n) for t, n, found in _scanned(b, text, hits, patterns)]
        return [not (k > 0 and 100 * k >= min_percent * n) for k, n in hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.filter(pa.array(clean(b), pa.bool_()))
            yield out.select([c for c in out.schema.names if c != hits]) if hits else out

    return src.mapInArrow(tidy(run), docs.schema)
