"""Operator 13, ranked lexical search through hierarchical max trees over document ranges.

The index is a table of postings. Documents are numbered within ranges of a few thousand, as the tasks read them; a range
has a row for each of its terms (documents and counts, ascending) and one row, without a term, that has the documents'
ids and lengths. Building it is one pass without a shuffle, and further documents are appended as further ranges.

Queries are taken in blocks of bounded size. A block's terms are looked up in the index, and the rows found are dealt out
by range. For each range, each term then has a tree of maxima: its best contribution in any 16 documents, in any 16 of
those nodes, and so on up to the whole range (contributions depend on the corpus's totals, so trees are made when the
block is searched, for its own terms only). Each query descends best first: the node whose maxima, weighted and summed
up, are highest is opened next, until the highest bound is below the k-th best score so far; a node whose bound equals it
is opened, too, as it may hold a tie of a smaller id. The k best are carried from range to range of a task, so most
ranges aren't opened at all; what the tasks found is ranked once more.
"""

from __future__ import annotations

import math
import uuid
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_scratch, scratch, tidy

#: All ASCII but letters and digits separates terms; A-Z become a-z; bytes of other characters are term bytes.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: A range ends with this many documents or postings; neither loses any.
RANGE_DOCS, RANGE_POSTINGS = 4096, 1_000_000
#: Children of a node, and documents of a lowest node.
FANOUT = 16
#: Bytes of query text of a block: what is broadcast at a time.
BLOCK_BYTES = 4 << 20


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order, A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class _Range:
    """The documents of one range while it is filled."""

    def __init__(self):
        self.ids, self.sizes, self.distinct = [], [], []
        self.terms, self.counts = [], []

    def add(self, doc_id, text: str | None) -> None:
        words = terms_of(text)
        own = Counter(words)
        self.ids.append(doc_id), self.sizes.append(len(words)), self.distinct.append(len(own))
        self.terms.extend(own), self.counts.extend(own.values())

    def full(self) -> bool:
        return len(self.ids) >= RANGE_DOCS or len(self.terms) >= RANGE_POSTINGS

    def rows(self, name: str, id_type: pa.DataType) -> pa.RecordBatch:
        names = sorted(set(self.terms))
        number = {t: k for k, t in enumerate(names)}
        code = np.fromiter(map(number.__getitem__, self.terms), np.int64, len(self.terms))
        order = np.argsort(code, kind="stable")
        docs = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.distinct)[order]
        found = np.bincount(code, minlength=len(names)) if names else np.zeros(0, np.int64)
        lists = lambda first, rest: pa.array(np.concatenate([[0, first], first + np.cumsum(rest)]).astype(np.int32))
        none, size = np.zeros(len(names), np.int64), len(self.ids)
        columns = [
            pa.array([name] * (len(names) + 1), pa.string()),
            pa.array([None, *names], pa.binary()).cast(pa.string()),
            pa.ListArray.from_arrays(lists(0, found), pa.array(docs, pa.int32())),
            pa.ListArray.from_arrays(lists(size, found), pa.array(np.concatenate([np.array(self.sizes, np.int64), np.array(self.counts, np.int64)[order]]), pa.int32())),
            pa.ListArray.from_arrays(lists(size, none), pa.array(self.ids, id_type)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["range", "term", "docs", "counts", "ids"])


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The index rows (range, term, docs, counts, ids) of all rows of ``docs``, without a shuffle."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind, build = src.schema["id"].dataType, uuid.uuid4().hex
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, now = TaskContext.get().partitionId(), 0, _Range()
        for b in batches:
            for doc_id, t in zip(b.column(0), b.column(1)):
                now.add(doc_id.as_py(), t.as_py())
                if now.full():
                    yield now.rows(f"{build}-{part}-{n}", id_type)
                    n, now = n + 1, _Range()
        if now.ids:
            yield now.rows(f"{build}-{part}-{n}", id_type)

    return src.mapInArrow(tidy(run), f"range string, term string, docs array<int>, counts array<int>, ids array<{kind.simpleString()}>")


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Add all rows of ``docs`` to the index at ``path`` (made if there is none); the index as a frame."""
    postings(docs, id_col, text).write.mode("append").parquet(path)
    return docs.sparkSession.read.parquet(path)


def blocks_of(queries: DataFrame, item: str, text: str, max_bytes: int) -> Iterator[list[tuple[int, object, Counter]]]:
    """The queries that have terms, as (number, item, terms), in lists of at most ``max_bytes`` of text or of one query."""
    block, size = [], 0
    for k, r in enumerate(queries.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).toLocalIterator()):
        if own := Counter(terms_of(r.text)):
            if block and size + len(r.text) > max_bytes:
                yield block
                block, size = [], 0
            block.append((k, r.item, own))
            size += 4 * len(r.text)
    if block:
        yield block


class _Block:
    """A block's queries as flat arrays: query i has the terms ``term[start[i]:start[i + 1]]`` with their weights."""

    def __init__(self, queries: list[tuple[int, object, Counter]], weights: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.number = {t: k for k, t in enumerate(weights)}
        known = [(k, i, {t: n for t, n in own.items() if weights.get(t)}) for k, i, own in queries]
        self.queries = [(k, i) for k, i, own in known if own]
        owns = [own for _, _, own in known if own]
        self.start = np.cumsum([0, *map(len, owns)])
        self.term = np.array([self.number[t] for own in owns for t in own], np.int64)
        self.weight = np.array([n * weights[t] for own in owns for t, n in own.items()], np.int64)


class _Trees:
    """The postings of a block's terms in one range, and the trees of maxima over them."""

    def __init__(self, sizes: np.ndarray, term: np.ndarray, doc: np.ndarray, count: np.ndarray, block: _Block):
        m = 25 + (75 * sizes * block.n_docs) // block.n_terms
        self.doc, self.gain = doc, (1_000_000_000 * count) // (1000 * count + 8 * m[doc])
        terms, local = np.unique(term, return_inverse=True)
        self.local = np.full(len(block.number), -1, np.int64)
        self.local[terms] = np.arange(len(terms))
        self.width = -(-len(sizes) // FANOUT)
        self.key = local * self.width + doc // FANOUT  # ascends, as terms and their documents do
        nodes, first = np.unique(self.key, return_index=True)
        low = np.zeros((len(terms), self.width), np.int64)
        low.reshape(-1)[nodes] = np.maximum.reduceat(self.gain, first)
        self.levels = [low]
        while (n := self.levels[-1].shape[1]) > 1:
            padded = np.pad(self.levels[-1], ((0, 0), (0, -n % FANOUT)))
            self.levels.append(padded.reshape(len(terms), -1, FANOUT).max(axis=2))

    def scores(self, rows: np.ndarray, weight: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a lowest node."""
        begin, end = (np.searchsorted(self.key, rows * self.width + node, side) for side in ("left", "right"))
        at = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])
        total = np.zeros(FANOUT, np.int64)
        np.add.at(total, self.doc[at] - FANOUT * node, np.repeat(weight, end - begin) * self.gain[at])
        hit = np.flatnonzero(total)
        return hit + FANOUT * node, total[hit]


def descend(trees: _Trees, rows: np.ndarray, weight: np.ndarray, bound: int, ids: list, best: list, k: int) -> int:
    """Best-first search of one range; ``best`` keeps the k best (-score, id is null, id) in order. Returns nodes opened."""
    heap, opened = [(-bound, len(trees.levels) - 1, 0)], 0
    while heap:
        floor = -best[-1][0] if len(best) == k else 1
        bound, level, node = heappop(heap)
        if -bound < floor:
            break
        opened += 1
        if level:
            below = trees.levels[level - 1][rows, node * FANOUT : (node + 1) * FANOUT]
            bounds = weight @ below
            for j in np.flatnonzero(bounds >= floor):
                heappush(heap, (-int(bounds[j]), level - 1, node * FANOUT + int(j)))
            continue
        for d, score in zip(*trees.scores(rows, weight, node)):
            found = (-int(score), ids[d] is None, ids[d])
            if len(best) < k or found[:2] < best[-1][:2] or (found[:2] == best[-1][:2] and not found[1] and found[2] < best[-1][2]):
                insort(best, found, key=lambda x: (*x[:2], 0 if x[1] else x[2]))
                del best[k:]
    return opened


def search_range(rows: list[dict], block: _Block, best: list[list], k: int) -> int:
    """Search one range, given as its index rows, for all queries of the block. Returns nodes opened."""
    sizes, ids, term, doc, count = None, [], [], [], []
    for r in sorted(rows, key=lambda r: -1 if r["term"] is None else block.number[r["term"].encode()]):
        if r["term"] is None:
            sizes, ids = np.array(r["counts"], np.int64), r["ids"]
        else:
            doc.append(np.array(r["docs"], np.int64)), count.append(np.array(r["counts"], np.int64))
            term.append(np.full(len(doc[-1]), block.number[r["term"].encode()]))
    if not doc:
        return 0
    trees = _Trees(sizes, np.concatenate(term), np.concatenate(doc), np.concatenate(count), block)
    local = trees.local[block.term]
    top = np.where(local >= 0, trees.levels[-1][local, 0], 0)
    bounds, opened = np.add.reduceat(block.weight * top, block.start[:-1]), 0
    for i in np.flatnonzero(bounds):
        if len(best[i]) == k and bounds[i] < -best[i][-1][0]:
            continue
        part = slice(block.start[i], block.start[i + 1])
        there = local[part] >= 0
        opened += descend(trees, local[part][there], block.weight[part][there], int(bounds[i]), ids, best[i], k)
    return opened


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each range of batches that are ordered by range."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["range"] != now and rows:
                yield rows
                rows = []
            now = r["range"]
            rows.append(r)
    if rows:
        yield rows


def _search_block(index: DataFrame, queries: list[tuple[int, object, Counter]], n_docs: int, n_terms: int, item_type, k: int) -> DataFrame:
    spark = index.sparkSession
    asked = sorted({t for _, _, own in queries for t in own})
    words = spark.createDataFrame([(t.decode("utf-8", "surrogatepass"),) for t in asked], "term string")
    hits = index.join(F.broadcast(words), "term", "left_semi").drop("ids")  # at most a block's bytes are broadcast
    found = scratch(hits.unionByName(index.filter("term IS NULL"), allowMissingColumns=True), "asked")
    df = {r.term.encode(): r.df for r in found.filter("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()}  # terms of the block
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in sorted(df.items())}
    shared = spark.sparkContext.broadcast(_Block(queries, weights, n_docs, n_terms))
    id_type = found.schema["ids"].dataType.elementType
    kinds = [pa.int64(), to_arrow_type(item_type), pa.int64(), to_arrow_type(id_type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best: list[list] = [[] for _ in block.queries]
        for rows in _ranges(batches):
            search_range(rows, block, best, k)
        out = [(n, item, -score, doc) for (n, item), own in zip(block.queries, best) for score, _, doc in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["query", "item_id", "score", "doc_id"])

    ordered = found.repartition("range").sortWithinPartitions("range")
    schema = f"query long, item_id {item_type.simpleString()}, score long, doc_id {id_type.simpleString()}"
    best = scratch(ordered.mapInArrow(tidy(run), schema), "best")  # k rows a query and task at most
    shared.destroy()
    drop_scratch(found)
    return best


def search(index: DataFrame, queries: DataFrame, k: int = 10, item: str = "item_id", text: str = "text", max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` highest-scoring documents of an index for every row of ``queries``: (item_id, rank, doc_id, score).

    Exact: bounds only decide what needn't be opened. Scores are whole numbers above 0; ties go by ascending id, a null id
    last. A query without terms, or without a document that scores, has no row; repeated queries are answered each, and
    repeated documents are documents each. Nulls are empty texts. An empty index or no queries give an empty result.
    """
    spark, kind = index.sparkSession, queries.schema[item].dataType
    sums = index.filter("term IS NULL").select(F.explode("counts").alias("n")).filter("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    parts = [_search_block(index, b, sums.n, sums.l, kind, k) for b in blocks_of(queries, item, text, max_bytes)] if sums.n else []
    schema = f"query long, item_id {kind.simpleString()}, score long, doc_id {index.schema['ids'].dataType.elementType.simpleString()}"
    every = spark.createDataFrame([], schema)
    for p in parts:
        every = every.unionByName(p)
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Index ``docs`` for these queries alone, and search."""
    index = scratch(postings(docs, id_col, text), "postings")
    out = search(index, queries, k, item, item_text, max_bytes)
    drop_scratch(index)  # the blocks' results are written
    return out
