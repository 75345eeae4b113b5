"""Operator 4, near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some 64-bit word lies within r bits of both. So every distinct
fingerprint emits all words within r bits of itself (r = 2: 2,081 of them), and fingerprints that emit the same word
are linked. The words are not shuffled one by one: those that agree in their first b bits travel as one row (prefix,
fingerprint, bits still free), and the task that gets a prefix spells out the rest. This is the same set of words in
1 + b + b(b-1)/2 rows in place of 2,081. A prefix that too many rows share is made longer, eight bits at a time, up to
the whole word; so no task loads a group of unbounded size.

Fingerprints that emit the same word are all within 2r bits of each other, so a star around one of them loses no
connection; no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import ascii_lower, give_back, join_by_weight, row_keys, scratch, tidy, words_of
from .components import connected_components

SEED = 42
#: Words spelled out at once in a reducing task, which bounds its memory (about 50 bytes each).
CHUNK = 1_500_000
#: Rows of a prefix beyond which it is made longer, and bits by which.
GROUP_ROWS, STEP = 300_000, 8


def fingerprint(text: str | None, k: int = 4) -> int:
    """SimHash of a text: lower-case A-Z, words at ASCII white space, k-word shingles, XXH64, strict majority per bit."""
    import xxhash

    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(line, SEED)
    starts = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    h = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    n = len(words) - k + 1
    for lo in range(0, n, 1 << 16):  # in pieces, so that a very long text needs little memory
        hi = min(n, lo + (1 << 16))
        hashes = np.fromiter(
            (h(line[a : b - 1], SEED) for a, b in zip(starts[lo:hi], starts[lo + k : hi + k])), np.uint64, hi - lo
        )
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", row_keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, and the longs ``row_keys``): the id and the signed long that holds the fingerprint's 64 bits, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *row_keys])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), *row_keys)
    return src.mapInArrow(tidy(run), "doc_id long, fp long" + "".join(f", {k} long" for k in row_keys))


def masks(bits: int, r: int) -> dict[int, np.ndarray]:
    """The words of ``bits`` bits with exactly j ones, for j = 0..r."""
    return {
        j: np.array([sum(1 << x for x in c) for c in combinations(range(bits), j)] or [0], np.uint64)
        for j in range(min(bits, r) + 1)
    }


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the ends of the edges (a, b); parent maps each node to the least one of its component."""
    while True:
        pa_, pb = parent[a], parent[b]
        differ = pa_ != pb
        if not differ.any():
            return parent
        a, b, pa_, pb = a[differ], b[differ], pa_[differ], pb[differ]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _link(parent: np.ndarray, fps: np.ndarray, rest: np.ndarray, who: np.ndarray, free: np.ndarray, bits: int, limit: int) -> np.ndarray:
    """Merge fingerprints ``who`` that emit a common word; rest: their last ``bits`` bits, free: bits still to be changed."""
    if len(who) < 2 or (who == who[0]).all() or (parent[who] == parent[who[0]]).all():
        return parent
    top = int(free.max())
    balls = [sum(comb(bits, j) for j in range(f + 1)) for f in range(top + 1)]
    if sum(balls[f] * int((free == f).sum()) for f in range(top + 1)) > CHUNK and bits > 8 and top:
        step = min(8, bits)  # too many words at once: take the next bits first, and one group of them after the other
        parts = []
        for j, m in masks(step, top).items():
            may = free >= j
            words = (rest[may, None] ^ (m << np.uint64(bits - step))[None, :]).ravel()
            parts.append((words, np.repeat(who[may], len(m)), np.repeat(free[may] - j, len(m))))
        words, owner, left = (np.concatenate(x) for x in zip(*parts))
        head = words >> np.uint64(bits - step)
        order = np.argsort(head, kind="stable")
        cuts = np.flatnonzero(np.diff(head[order])) + 1
        low = np.uint64((1 << (bits - step)) - 1)
        for part in np.split(order, cuts):
            parent = _link(parent, fps, words[part] & low, owner[part], left[part], bits - step, limit)
        return parent
    parts = []
    for f in range(top + 1):
        mine = free == f
        if mine.any():
            m = np.concatenate(list(masks(bits, f).values()))
            parts.append(((rest[mine, None] ^ m[None, :]).ravel(), np.repeat(who[mine], len(m))))
    words, owner = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(words, kind="stable")
    words, owner = words[order], owner[order]
    same = np.flatnonzero(words[1:] == words[:-1]) + 1
    if not len(same):
        return parent
    # The first of each run of equal words is its centre.
    begins = np.ones(len(words), bool)
    begins[same] = False
    centre = np.maximum.accumulate(np.where(begins, np.arange(len(words)), 0))
    a, b = owner[same], owner[centre[same]]
    pairs = np.unique(np.maximum(a, b).astype(np.int64) * len(fps) + np.minimum(a, b))
    a, b = pairs // len(fps), pairs % len(fps)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= limit
    return _merge(parent, a[near], b[near])


def prefix_bits(n: int) -> int:
    """Bits of the word that decide where it is sent: about a thousand fingerprints to a prefix, 6 to 40 bits."""
    return int(min(40, max(6, log2(max(n, 1) / 1000) + 1)))


def _spread(rows: DataFrame, bits: int, more: int, r: int) -> DataFrame:
    """rows (prefix, fp, free), prefixes of ``bits`` bits -> the same words by prefixes of ``bits + more`` bits."""
    flips = F.array(*[F.struct(F.lit(int(m)).alias("m"), F.lit(j).alias("used")) for j, ms in masks(more, r).items() for m in ms])
    own = F.shiftrightunsigned("fp", 64 - bits - more).bitwiseAND(F.lit((1 << more) - 1))
    may = F.filter(flips, lambda x: x["used"] <= F.col("free"))
    out = rows.select("prefix", "fp", "free", F.explode(may).alias("x"))
    return out.select(F.shiftleft("prefix", more).bitwiseOR(own.bitwiseXOR(F.col("x.m"))).alias("prefix"), "fp", (F.col("free") - F.col("x.used")).alias("free"))


def links(distinct: DataFrame, n: int, limit: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (column fp, unique) that are within ``limit`` bits, directly or by others.

    A task takes a prefix of at most ``group_rows`` rows. A whole word that more fingerprints emit needs no task of
    its own: they are all near each other, so each is linked to the least of them.
    """
    if limit % 2 or not 2 <= limit <= 8:
        raise ValueError("the limit must be an even number of bits from 2 to 8")
    r, bits = limit // 2, prefix_bits(n)
    start = distinct.select(F.lit(0).cast("long").alias("prefix"), "fp", F.lit(r).alias("free"))
    rows, found = _spread(start, 0, bits, r), []
    while True:
        heavy = rows.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows).select("prefix", F.lit(True).alias("heavy"))
        heavy = scratch(heavy, "heavy-prefixes")  # at most 1 / group_rows of the rows
        any_heavy = bool(heavy.limit(1).count())
        marked = rows.join(F.broadcast(heavy), "prefix", "left") if any_heavy else rows
        light = marked.filter("heavy IS NULL").drop("heavy") if any_heavy else rows
        found.append(_links_of(light, bits, limit))
        if not any_heavy:
            break
        rows = marked.filter("heavy").drop("heavy")
        if bits == 64:
            least = rows.groupBy("prefix").agg(F.min("fp").alias("v"))
            found.append(rows.join(F.broadcast(least), "prefix").select(F.col("fp").alias("u"), "v").filter("u <> v"))
            break
        more = min(STEP, 64 - bits)
        rows, bits = scratch(_spread(rows, bits, more, r), "longer-prefixes"), bits + more
    return reduce(DataFrame.unionByName, found)


def _links_of(rows: DataFrame, bits: int, limit: int) -> DataFrame:
    """Edges between the fingerprints of each prefix (prefix, fp, free) that emit a common word with it."""

    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        free = table.column("free").to_numpy().astype(np.int64)
        rest = fps & np.uint64((1 << (64 - bits)) - 1)
        parent = np.arange(len(fps))
        if len(fps) > 1:
            parent = _link(parent, fps, rest, parent.copy(), free, 64 - bits, limit)
            give_back()
        signed, far = fps.view(np.int64), np.flatnonzero(parent != np.arange(len(parent)))
        return pa.table({"u": signed[far], "v": signed[parent[far]]})

    return rows.groupBy("prefix").applyInArrow(run, "u long, v long")


def _components(fps: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(fp, n_rows, root), a row for each fingerprint of ``fps``, with its component's least one; and the number of rows."""
    classes = scratch(fps.groupBy("fp").agg(F.count("*").alias("n_rows")), "classes")
    n, total = classes.agg(F.count("*"), F.sum("n_rows")).first()
    roots = scratch(connected_components(links(classes.select("fp"), n, limit)), "roots")
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "n_rows", F.coalesce("root", "fp").alias("root"))
    return scratch(rooted, "rooted"), total or 0


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the least doc_id that can be reached over links of at most ``limit`` differing bits, the row's own
    included. Equal texts share a fingerprint and so a component. Null, empty and wordless texts have fingerprint 0 and
    are linked like any other. A null doc_id gets its component's least id, which is null only if no row there has one.
    Repeated rows each get a row. An empty table gives an empty result. Other columns of ``docs`` play no part.
    """
    fps = scratch(fingerprints(docs, id_col, text), "fingerprints")
    rooted, total = _components(fps, limit)
    with_root = scratch(join_by_weight(fps, rooted, ["fp"], "n_rows", total), "with-root")
    least = scratch(with_root.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_rows")), "components")
    return join_by_weight(with_root, least, ["root"], "n_rows", total).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = 4) -> DataFrame:
    """The rows of ``docs`` without all but one row of each component.

    The row of the least id stays (of several with that id, that of the least hash); one without an id only where no row
    of its component has one. Of rows that are equal in all columns one stays. Rows are told apart by two hashes of all
    their columns, so an id that several rows share can't keep more than one of them.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col(id_col).cast("long").alias("id_"), F.col(text).alias("text_"), *row_keys(docs))
    fps = scratch(fingerprints(row, "id_", "text_", ("k1", "k2")), "fingerprints")
    rooted, total = _components(fps, limit)
    with_root = join_by_weight(fps, rooted, ["fp"], "n_rows", total)
    best = with_root.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "k1", "k2")).alias("best"))
    kept = scratch(best.select("best.k1", "best.k2"), "kept")
    twice = scratch(fps.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2"), "equal-rows")
    met = row.join(kept, ["k1", "k2"])
    if twice.limit(1).count():
        met = met.join(twice, ["k1", "k2"], "left_anti").unionByName(met.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return met.select("row_.*")


def _fingerprint_keys(rows: DataFrame, limit: int) -> DataFrame:
    """rows (k1, norm) -> (h, k1): a key for each component of fingerprints within ``limit`` bits, found as in ``near_duplicates``."""
    fps = scratch(fingerprints(rows, "k1", "norm").distinct(), "fingerprints")
    rooted, total = _components(fps, limit)
    return join_by_weight(fps, rooted, ["fp"], "n_rows", total).select(F.xxhash64(F.lit("fingerprint"), "root").alias("h"), F.col("doc_id").alias("k1"))


def _band_keys(rows: DataFrame, similarity: float) -> DataFrame:
    """rows (k1, norm) -> (h, k1): the MinHash bands of each text's 5-word shingles."""
    bands = passages.tune_bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = passages.Signer(*bands)
        for b in batches:
            if b.num_rows:
                keys = [signer.bands_of(passages.shingles(p.as_py().encode())) for p in b.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(b.column(0).to_numpy(), bands[1]))], names=["h", "k1"])

    return rows.mapInArrow(tidy(run), "h long, k1 long")


def _shingle_sets(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [passages.shingles(p.as_py().encode()).view(np.int64) for p in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["k1", "s"])

    return rows.mapInArrow(tidy(run), "k1 long, s array<long>")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, limit: int = 4) -> DataFrame:
    """The rows of ``docs`` without all but one document of each component of texts whose 5-word Jaccard is at least ``similarity``.

    Candidates come from SimHash: the components of fingerprints within ``limit`` bits. Texts of Jaccard 0.8 are some
    nine of 64 bits apart, so those that fingerprints miss are met by MinHash bands, tuned to find a pair at the threshold
    with a chance of 0.998. Each link of either is verified exactly. Words are compared as in ``fingerprint``; wordless texts are equal. The document of the least id stays, one row of it; a row
    without an id comes after all others, so it stays only where no row of its group has one.
    """
    norm = F.array_join(words_of(ascii_lower(F.col(text))), " ")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col(id_col).cast("long").alias("id_"), norm.alias("norm"))
    row = row.withColumns({"k1": F.xxhash64("norm"), "k2": F.xxhash64(F.lit(1), "norm")})
    place = F.struct(F.isnull("id_").alias("no_id"), F.col("id_").alias("id_"))
    classes = row.groupBy("k1", "k2").agg(F.min(place).alias("first"))
    classes = scratch(classes, "text-classes")
    texts = row.select("k1", "norm")
    keyed = _fingerprint_keys(texts, limit).unionByName(_band_keys(texts, similarity))
    sets_of = lambda wanted: _shingle_sets(texts.join(wanted, "k1", "left_semi").groupBy("k1").agg(F.min("norm").alias("norm")))
    roots = passages.similar_classes(keyed, sets_of, similarity).withColumnRenamed("node", "k1")
    rooted = classes.join(roots, "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    best = rooted.groupBy("root").agg(F.min(F.struct("first", "k1", "k2")).alias("best"))
    best = scratch(best.select("best.k1", "best.k2", F.col("best.first.id_").alias("id_")), "kept-texts")
    on = F.col("id_").eqNullSafe(F.col("kept_id_")) & (F.col("k1") == F.col("kept_k1_")) & (F.col("k2") == F.col("kept_k2_"))
    kept = best.withColumnsRenamed({"k1": "kept_k1_", "k2": "kept_k2_", "id_": "kept_id_"})
    same = row.select("k1", "k2", "id_").groupBy("k1", "k2", "id_").agg(F.count("*").alias("kept_n_"))
    same = same.withColumnsRenamed({"k1": "kept_k1_", "k2": "kept_k2_", "id_": "kept_id_"}).filter("kept_n_ > 1")
    same = scratch(same, "repeated-rows")
    met = row.drop("norm").join(kept, on, "inner").drop("kept_k1_", "kept_k2_", "kept_id_")
    if same.limit(1).count():
        once = met.join(same, on, "left_anti").unionByName(met.join(same, on, "left_semi").dropDuplicates(["k1", "k2", "id_"]))
        return once.select("row_.*")
    return met.select("row_.*")
