"""Operator 9, repeated passages: content-defined units of the word stream, exact Jaccard, connected components.

The words of a text, without regard to line ends, are cut into units of about nine words: a cut is made where the hash
of three words is the least among its ``WINDOW`` neighbours on both sides. That depends only on words nearby, so a
passage gives the same units, but for its first and last, in whatever text it stands. Equal units are one class.

Different units can be similar, too. A pair of shingle sets with a Jaccard similarity of at least the threshold shares
one of the first elements of the two sorted sets (prefix filtering: n - ceil(threshold n) + 1 of n), so every class is
sent under those of its hashes, and no pair is missed. Within the classes that share one, the least one is the centre,
and every other is compared with it exactly. Where some fail, the group's classes that aren't connected yet are
compared with each other, too, in blocks inside a task. By the triangle inequality of the Jaccard distance only those
can be similar whose distances from the centre differ by at most 1 - threshold. So no group is expanded into rows of
pairs, and no connection between classes that share a hash is lost.

A phrase of nine words repeats by chance. So neighbouring repeated units are joined, over a single unit between them
that was edited, and of these runs those of at least ``min_run`` words are reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_scratch, join_by_weight, scratch, tidy
from .components import connected_components

#: Neighbours on either side above which a cut's hash must be the least: units have 2 * WINDOW + 1 words on average, and
#: WINDOW + 1 at least (but for a text's first and last).
WINDOW = 4
#: Words of the shortest run of units that op9 reports, and how far apart (in units) members of a run may lie.
MIN_RUN, REACH = 15, 2
SHINGLE = 5
#: Classes of a group that one task compares with as many others, and shingles that it counts at once.
BLOCK, COLUMNS = 1000, 4096
#: A worker leaves out the shingles of units that it has just sent; so many of them are remembered.
REMEMBERED = 200_000
#: Small groups are compared together, so many rows or so in a call; rows are those of classes in blocks.
BUCKET_ROWS = 2000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def tune_bands(threshold: float, recall: float = 0.998, max_rows: int = 8, max_bands: int = 16) -> tuple[int, int]:
    """(rows, bands): the most selective banding within the limits that finds a pair at the threshold with this chance."""
    best = None
    for rows in range(1, max_rows + 1):
        for bands in range(1, max_bands + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (rows, bands)
                break
    if best is None:
        raise ValueError("no banding reaches the recall within the limits")
    return best


def cuts(words: list[bytes]) -> list[int]:
    """Where units begin, and the number of words at the end."""
    import xxhash

    n = len(words)
    if n < 3:
        return [0, n] if n else [0]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    v = h[:-2] * _MIX[0] + h[1:-1] * _MIX[1] + h[2:] * _MIX[2]
    v = (v ^ (v >> np.uint64(32))) * _MIX[0]
    v ^= v >> np.uint64(29)
    least = np.ones(n - 2, bool)
    least[0] = False
    for d in range(1, min(WINDOW, n - 3) + 1):
        least[d:] &= v[d:] < v[:-d]
        least[:-d] &= v[:-d] <= v[d:]
    return [0, *np.flatnonzero(least).tolist(), n]


def paragraphs(text: str | None) -> list[tuple[int, bytes, int]]:
    """(number, words joined by spaces with A-Z lower-cased, number of words) of the units of a text."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    at = cuts(w)
    return [(i, b" ".join(w[a:b]), b - a) for i, (a, b) in enumerate(zip(at, at[1:]))]


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The first character and that after the last, for every word of a text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.diff(np.concatenate([[1], _BLANK[data], [1]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if text.isascii():
        return begin, end
    chars = np.cumsum((data & 0xC0) != 0x80)
    return chars[begin] - 1, chars[end - 1]


def key(paragraph: bytes) -> tuple[int, int]:
    import xxhash

    d = np.frombuffer(xxhash.xxh3_128_digest(paragraph), np.int64)
    return int(d[0]), int(d[1])


def shingles(paragraph: bytes) -> np.ndarray:
    """Distinct hashes (uint64) of the 5-word shingles, in order."""
    import xxhash

    h, at, starts = xxhash.xxh64_intdigest, 0, [0]
    for w in paragraph.split():
        at += len(w) + 1
        starts.append(at)
    if len(starts) <= SHINGLE:
        return np.array([h(paragraph)], np.uint64)
    found = np.array([h(paragraph[a : b - 1]) for a, b in zip(starts, starts[SHINGLE:])], np.uint64)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


class Signer:
    def __init__(self, rows: int, bands: int, seed: int = 1):
        r = np.random.default_rng(seed)
        n = rows * bands
        self.rows, self.bands = rows, bands
        self.a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, n, dtype=np.uint64)
        self.mix = r.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = r.integers(0, 1 << 63, bands, dtype=np.uint64)

    def bands_of(self, s: np.ndarray) -> np.ndarray:
        """A 64-bit key (int64) for each band; s: shingle hashes."""
        least = np.empty(len(self.a), np.uint64)
        step = max(1, 100_000 // len(s))
        for i in range(0, len(self.a), step):
            v = self.a[i : i + step, None] * s
            v += self.b[i : i + step, None]
            least[i : i + step] = v.min(axis=1)
        least >>= np.uint64(8)
        h = (least.reshape(self.bands, self.rows) * self.mix).sum(axis=1, dtype=np.uint64) + self.salt
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


UNITS = "row long, text_hash long, doc_id long, at int, n_words int, begin int, end int, k1 long, k2 long, s array<long>"


def prefix_size(n: int, threshold: float) -> int:
    """Elements of a set of n under which it must be met by every other set that is similar; 0 if only an equal one can be."""
    if n / (n + 1) < threshold:
        return 0
    return n - ceil(threshold * n - 1e-9) + 1


def _units(src: DataFrame, threshold: float) -> DataFrame:
    """A row for each unit of ``src`` (doc_id, text, text_hash); s: shingles, only where a worker meets a unit that can resemble another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 3, *[pa.int32()] * 4, *[pa.int64()] * 2, pa.list_(pa.int64())]
        names = [x.split()[0] for x in UNITS.split(", ")]
        row, sent = TaskContext.get().partitionId() << 33, set()
        least = next(n for n in range(1, 1 << 20) if prefix_size(n, threshold)) + SHINGLE - 1
        cols: tuple[list, ...] = tuple([] for _ in kinds)
        for b in batches:
            for doc, t, text_hash in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                row += 1
                t = t.as_py()
                found = paragraphs(t)
                if not found:
                    continue
                begin, end = word_places(t)
                n = [x[2] for x in found]
                last = np.cumsum(n)
                for (at, p, size), lo, hi in zip(found, begin[last - n].tolist(), end[last - 1].tolist()):
                    k1, k2 = key(p)
                    s = None
                    if size >= least and k1 not in sent:
                        sent.add(k1)
                        s = shingles(p).view(np.int64)
                    for c, x in zip(cols, (row, text_hash, doc, at, size, lo, hi, k1, k2, s)):
                        c.append(x)
                if len(cols[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
                    cols = tuple([] for _ in kinds)
            if len(sent) > REMEMBERED:
                sent.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return src.mapInArrow(tidy(run), UNITS)


def _similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) with their exact Jaccard similarity."""
    with_u = pairs.join(sets.select(F.col("k1").alias("u"), F.col("s").alias("su")), "u")
    both = with_u.join(sets.select(F.col("k1").alias("v"), F.col("s").alias("sv")), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.select("u", "v", (common / (F.size("su") + F.size("sv") - common)).alias("jaccard"))


def _compare_blocks(rows: DataFrame, threshold: float, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) that connect, within each group h, similar classes of different roots; rows (h, n, k1, jaccard, root, s).

    A group is dealt into blocks of about BLOCK classes, and a task compares two blocks with each other (or one with
    itself) by counting common shingles in matrix products. Pairs stay inside the task: out come at most as many links
    as it has classes. Pairs of classes that both are similar to the centre are connected already, and by the triangle
    inequality so far apart in their distance from it can't be similar: both are passed over.
    """
    nb = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("k1"), nb).cast("int")
    dealt = rows.withColumn("b", own).withColumn("j", F.explode(F.sequence(F.lit(0), nb - 1)))
    dealt = dealt.select("h", F.least("b", "j").alias("i"), F.greatest("b", "j").alias("j"), "k1", "jaccard", "root", "s")
    # The groups' classes, each as often as its group has blocks, over calls of bounded size, whatever the input's size.
    n_rows = rows.agg(F.sum(nb.cast("long"))).first()[0] or 0
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("h", "i", "j"), F.lit(max(1, -(-n_rows // bucket_rows)))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("i", "ascending"), ("j", "ascending")]).combine_chunks()
        edge = np.zeros(table.num_rows, bool)
        for c in ("h", "i", "j"):
            x = table.column(c).to_numpy()
            edge[1:] |= x[1:] != x[:-1]
        at = [0, *np.flatnonzero(edge).tolist(), table.num_rows]
        links = [x for lo, hi in zip(at, at[1:]) for x in compare(table.slice(lo, hi - lo))]
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})

    def compare(table: pa.Table) -> list[tuple[int, int]]:
        k1, root, d = (table.column(c).to_numpy() for c in ("k1", "root", "jaccard"))
        if len(k1) < 2:
            return []
        column = table.column("s").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(k1)), sizes)
        _, at, df = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = df[at] > 1  # a shingle of one class only adds nothing
        row, at = row[shared], (np.cumsum(df > 1) - 1)[at[shared]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        parent = np.unique(root, return_inverse=True)[1]
        common = np.zeros((len(k1), len(k1)), np.float32)
        n_shared = int((df > 1).sum())
        for lo in range(0, n_shared, COLUMNS):
            x, y = np.searchsorted(at, [lo, lo + COLUMNS])
            m = np.zeros((len(k1), min(COLUMNS, n_shared - lo)), np.float32)
            m[row[x:y], at[x:y] - lo] = 1
            common += m @ m.T
        alike = common >= (threshold - 1e-6) * (sizes[:, None] + sizes[None, :] - common)
        alike &= (parent[:, None] != parent[None, :]) & (np.abs(d[:, None] - d[None, :]) <= 1 - threshold + 1e-6)
        u, v = np.nonzero(np.triu(alike))
        links = []
        for a, b in zip(u.tolist(), v.tolist()):
            c = int(common[a, b])
            if parent[a] != parent[b] and c / int(sizes[a] + sizes[b] - c) >= threshold:
                parent[parent == parent[b]] = parent[a]
                links.append((k1[a], k1[b]))
        return links

    return dealt.groupBy("bucket").applyInArrow(run, "u long, v long")


def similar_classes(keyed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(node, root): the components of similar but different classes.

    keyed has (h, k1), the keys under which a class may meet others; sets_of gives (k1, s), the shingles, of each class
    in a table of k1. Classes go by the first half of their 128-bit keys: should two share that half, they are
    compared by one of them; equality never rests on it.
    """
    once = keyed.repartition("h").groupBy("h", "k1").agg(F.lit(1).alias("one"))
    centre = F.min("k1").over(W.partitionBy("h"))
    members = scratch(once.select("h", "k1", centre.alias("centre")).filter("k1 <> centre"), "members")
    pairs = scratch(members.select(F.col("k1").alias("u"), F.col("centre").alias("v")).distinct(), "pairs")
    wanted = pairs.select(F.col("u").alias("k1")).unionByName(pairs.select(F.col("v").alias("k1"))).distinct()
    sets = scratch(sets_of(wanted), "shingle-sets")
    met = scratch(_similarity(pairs, sets), "similarities")
    links = met.filter(F.col("jaccard") >= threshold).select("u", "v")
    failed = F.col("jaccard") < threshold
    if met.filter(failed).limit(1).count():
        roots = scratch(connected_components(links), "roots").withColumnRenamed("node", "k1")
        placed = members.join(met.select(F.col("u").alias("k1"), F.col("v").alias("centre"), "jaccard"), ["k1", "centre"]).join(roots, "k1", "left")
        placed = scratch(placed.select("h", "k1", "jaccard", F.coalesce("root", "k1").alias("root")), "placed")
        groups = placed.groupBy("h").agg(F.count("*").alias("n"), F.bool_or(failed).alias("any_failed"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        open_ = scratch(placed.join(groups.filter("any_failed AND lo <> hi").select("h", "n"), "h").join(sets, "k1"), "open-groups")
        links = links.unionByName(scratch(_compare_blocks(open_, threshold), "second-links"))
        drop_scratch(placed, open_)
    return scratch(connected_components(links), "components")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, min_run: int = 0) -> DataFrame:
    """Every unit that another one equals or resembles and that lies in a run of at least ``min_run`` words: a row for each place.

    Columns: doc_id, text_hash (XXH64 of the text, as Spark has it), paragraph (the unit's number in the text), n_words, begin and
    end (its first character in the text, from 0, and that after its last), cluster_id, kept_doc_id, n_places (units in the
    cluster, reported or not) and removed. A cluster is a component of units linked by equality or a Jaccard similarity of at
    least ``threshold`` over 5-word shingles. The place with the least (doc_id, paragraph) stays, kept_doc_id is its
    document and cluster_id the key of one of its units; all others are removed. A run is a row of repeated units of
    one text with at most one other between two of them. Cases: null and empty texts have no units; a repeat within
    one text counts; rows with a null doc_id come before all others; of rows that repeat a doc_id one keeps the unit
    (their places are equal, and ties are broken by the keys); an empty table gives an empty result. Other columns of
    ``docs`` play no part.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    units = scratch(_units(src, threshold), "units")
    sets = units.filter("s IS NOT NULL").select("k1", "s")
    size = F.size("s") - F.ceil(F.lit(threshold) * F.size("s") - 1e-9).cast("int") + 1
    keyed = sets.select(F.explode(F.slice("s", F.lit(1), size)).alias("h"), "k1")
    sets_of = lambda wanted: sets.join(wanted, "k1", "left_semi").groupBy("k1").agg(F.first("s").alias("s"))
    roots = similar_classes(keyed, sets_of, threshold).withColumnRenamed("node", "k1")
    classes = units.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
    linked = classes.join(roots, "k1", "left").filter("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "k1"))
    linked = scratch(linked, "linked")
    clusters = linked.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("n_places"), F.count("*").alias("n_classes"))
    total, n_units = linked.agg(F.count("*"), F.sum("n")).first()
    named = join_by_weight(linked, scratch(clusters, "clusters"), ["root"], "n_classes", total)
    named = scratch(named.select("k1", "k2", "n", "root", "kept", "n_places"), "named")
    out = join_by_weight(units.drop("s"), named, ["k1", "k2"], "n", n_units or 0, "inner")
    if min_run:
        in_text = W.partitionBy("row").orderBy("at")
        out = out.withColumn("far", (F.col("at") - F.lag("at").over(in_text) > REACH).cast("int"))
        out = out.withColumn("run", F.sum(F.coalesce("far", F.lit(0))).over(in_text))
        out = out.withColumn("run_words", F.sum("n_words").over(W.partitionBy("row", "run"))).filter(F.col("run_words") >= min_run)
    place = F.struct("doc_id", "at")
    return out.select(
        "doc_id", "text_hash", F.col("at").alias("paragraph"), "n_words", "begin", "end", F.col("root").alias("cluster_id"),
        F.col("kept.doc_id").alias("kept_doc_id"), "n_places", (~place.eqNullSafe(F.col("kept"))).alias("removed"),
    )


def without_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their texts less the places that ``found``, a result of ``repeated_passages``, removes.

    White space around a place stays. Rows are matched by their id and their text's hash; null texts stay null.
    """
    spans = found.filter("removed").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans_"))
    spans = spans.select(F.col("doc_id").alias("span_id_"), F.col("text_hash").alias("span_hash_"), "spans_")
    on = F.col(id_col).cast("long").eqNullSafe(F.col("span_id_")) & (F.xxhash64(F.col(text)) == F.col("span_hash_"))
    met = docs.join(spans, on, "left")
    before = lambda i: F.coalesce(F.get("spans_", i - 1)["end"], F.lit(0))
    pieces = F.transform("spans_", lambda x, i: F.substring(F.col(text), before(i) + 1, x["begin"] - before(i)))
    rest = F.substring(F.col(text), F.element_at("spans_", -1)["end"] + 1, F.char_length(text))
    left = F.when(F.col("spans_").isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return met.withColumn("left_", left).select(*[F.col("left_").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
