"""Retrieval by sketches where slot values are frequent: as a full scan has it, and without a row for each pair."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from echoquorum import schema as S
from echoquorum.functions import sketch
from echoquorum.operators import identify

E = S.EPISODE
REF, ASKED = "tmdb_id long, season int, episode int, sketch array<bigint>, hash_count int", "query_id long, sketch array<bigint>, hash_count int"


def sketches(r, kind, n):
    """n sketches: some values in all of them, some in many, the rest in few; many copies."""
    out = []
    for k in range(n):
        if kind == "copies" and k % 3 == 0:
            out.append([7 + i for i in range(sketch.SLOTS)])
            continue
        s = [r.randrange(1, 40) * 1000 + i for i in range(sketch.SLOTS)]
        if kind in ("one", "copies"):
            s[5] = 42
        elif kind == "several":
            for i in range(0, 40, 4):
                s[i] = r.choice([1, 1, 2, s[i]])
        out.append(s)
    if kind != "none":
        out[1], out[2] = list(out[0]), [x if i % 2 else 0 for i, x in enumerate(out[0])]
    return out


def full_scan(asked, refs, n):
    out = set()
    for q, s in enumerate(asked):
        near = sorted((-sum(a == b for a, b in zip(s, t)), k) for k, t in enumerate(refs))
        out |= {(q, k, -c / sketch.SLOTS) for c, k in near[:n] if c}
    return out


@pytest.mark.parametrize("kind", ["none", "one", "several", "copies"])
@pytest.mark.parametrize("n", [2, 8])
def test_frequent_values_change_nothing(spark, kind, n):
    r = random.Random(3)
    refs, asked = sketches(r, kind, 90), sketches(r, kind, 40)
    asked[3], asked[4] = list(refs[10]), [x if i % 8 else 0 for i, x in enumerate(refs[20])]
    a = spark.createDataFrame([(q, s, 1) for q, s in enumerate(asked)], ASKED)
    b = spark.createDataFrame([(k, 1, 1, s, 1) for k, s in enumerate(refs)], REF)
    got = {(x.query_id, x.tmdb_id, x.jaccard) for x in identify.similar(a, b, n, frequent=10).collect()}
    assert got == full_scan(asked, refs, n) == {(x.query_id, x.tmdb_id, x.jaccard) for x in identify.similar(a, b, n).collect()}


def test_a_value_of_all_sketches_makes_no_row_for_each_pair(spark):
    rows = spark.range(400).select(F.col("id"), F.transform(F.sequence(F.lit(0), F.lit(sketch.SLOTS - 1)), lambda i: F.when(i == 5, 42).otherwise(F.pmod(F.xxhash64("id", i), F.lit(1 << 32))).cast("long")).alias("sketch"))
    code = F.transform("sketch", lambda v, i: i.cast("long") * (1 << 32) + v)
    slots = rows.select(F.col("id").alias("cls"), F.explode(code).alias("code"))
    often = slots.groupBy("code").count().filter("count > 20").select("code")
    assert often.count() == 1
    pairs = identify.rare_pairs(slots, slots.withColumnRenamed("cls", "asked"), often)
    assert pairs.count() < 3 * 400  # each with itself and by chance with few others, not 400 x 400
    a = rows.select(F.col("id").alias("query_id"), "sketch", F.lit(1).alias("hash_count"))
    b = rows.select(F.col("id").alias("tmdb_id"), F.lit(1).alias("season"), F.lit(1).alias("episode"), "sketch", F.lit(1).alias("hash_count"))
    out = identify.similar(a, b, 2, frequent=20).collect()
    best = {x.query_id: x.tmdb_id for x in out if x.jaccard == 1}
    assert len(out) == 800 and best == {q: q for q in range(400)}
    # The second is the first other key, which shares that one value, unless chance has made a closer one.
    assert sum(x.tmdb_id == (0 if x.query_id else 1) for x in out if x.jaccard < 1) > 300


def test_the_screen_is_the_same_with_frequent_values(spark):
    r = random.Random(4)
    prints = [sorted({1, 2, *r.choices(range(3, 400), k=60)}) for _ in range(60)] + [[9, 10]] * 20
    refs = spark.createDataFrame([(k, 1, 1, h) for k, h in enumerate(prints)], "tmdb_id long, season int, episode int, hashes array<bigint>")
    asked = spark.createDataFrame([(k, (k * 7) % 100, 1, 1, h[: 1 + len(h) * 3 // 4]) for k, h in enumerate(prints)], "id long, tmdb_id long, season int, episode int, hashes array<bigint>")
    assert sorted(map(tuple, identify.screen(asked, refs, frequent=5).collect()), key=str) == sorted(map(tuple, identify.screen(asked, refs).collect()), key=str)


def shuffled(spark):
    return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_values_below_the_frequent_ones_make_no_rows_of_pairs(spark):
    shared = F.transform(F.sequence(F.lit(0), F.lit(sketch.SLOTS - 1)), lambda i: F.when(i % 16 == 0, i).otherwise(F.pmod(F.xxhash64("id", i), F.lit(1 << 32))).cast("long"))
    rows = spark.range(900).select(F.col("id").alias("query_id"), F.col("id").alias("tmdb_id"), F.lit(1).alias("season"), F.lit(1).alias("episode"), shared.alias("sketch"), F.lit(1).alias("hash_count"))
    before = shuffled(spark)
    out = identify.similar(rows.select("query_id", "sketch", "hash_count"), rows.drop("query_id"), 2).collect()
    assert shuffled(spark) - before < 4_000_000  # the sketches; 810,000 pairs would be more
    assert len(out) == 1800 and {x.query_id: x.tmdb_id for x in out if x.jaccard == 1} == {q: q for q in range(900)}


@pytest.mark.parametrize("kind", ["none", "one", "several", "copies"])
def test_parts_of_the_sketches_change_nothing(spark, kind, monkeypatch):
    r = random.Random(5)
    refs, asked = sketches(r, kind, 90), sketches(r, kind, 40)
    for name in ("LEAST_BLOCK", "BLOCK_PAIRS"):
        monkeypatch.setattr(identify, name, 7)
    array = lambda rows: pa.chunked_array([rows[:9], rows[9:]], pa.list_(pa.int32()))
    for n, frequent in ((1, 3), (2, 10), (8, 10), (200, 5)):
        got = {(q, k, c / sketch.SLOTS) for q, k, c in zip(*identify._best(array(asked), np.array(refs, np.int32).T, n, frequent))}
        assert got == full_scan(asked, refs, n)
    a = spark.createDataFrame([(q, s, 1) for q, s in enumerate(asked)], ASKED)
    b = spark.createDataFrame([(k if k else None, 1, 1, s, 1) for k, s in enumerate(refs)], REF)
    assert identify.blocks(40, 90, 4) != (1, 1)
    got = {(x.query_id, x.tmdb_id or 0, x.jaccard) for x in identify.similar(a, b, 3).collect()}
    assert got == full_scan(asked, refs, 3)
    assert identify.similar(a.limit(0), b, 3).count() == identify.similar(a, b.limit(0), 3).count() == 0


def test_few_queries_meet_small_blocks_however_many_references_there_are():
    """Before, a block grew with the catalogue up to 65,536 references; queries still aren't copied more often than there are references."""
    for there in (50_000, 500_000, 3_000_000):
        g, b = identify.blocks(400, there, 12)
        assert g == 1 and there / b <= identify.LEAST_BLOCK and 400 * b <= there + 400
    assert identify.blocks(500_000, 500_000, 12) == (2, 8)  # all with all: as before


@pytest.mark.parametrize("kind", ["none", "one", "several", "copies"])
@pytest.mark.parametrize("n", [1, 2, 8])
def test_stored_references_read_in_pieces_change_nothing(kind, n, tmp_path):
    """What earlier pieces have found bounds what is looked at in later ones; the pieces are in no order, and cross files."""
    r = random.Random(6)
    refs, asked = sketches(r, kind, 90), sketches(r, kind, 40)
    asked[3], asked[4] = list(refs[10]), [x if i % 8 else 0 for i, x in enumerate(refs[20])]
    lists = lambda rows: pa.array(rows, pa.list_(pa.int32()))
    where, files = r.sample(range(90), 90), []
    for begin in range(0, 90, 25):
        part = where[begin : begin + 25]
        table = pa.table({"tmdb_id": pa.array([k or None for k in part], pa.int64()), "season": pa.array([1] * len(part), pa.int32()), "episode": pa.array([1] * len(part), pa.int32()), "sketch": lists([refs[k] for k in part])})
        pq.write_table(table, tmp_path / f"{begin}.parquet")
        files.append(f"file:{tmp_path}/{begin}.parquet")
    batches = [pa.RecordBatch.from_pydict({"query_id": [f"q{q}" for q in part], "sketch": lists([None if q == 7 else asked[q] for q in part])}) for part in (range(0, 15), range(15, 40))]
    for at_once in (7, 40, 1000):
        out = [x for b in identify._streamed(files, n, 10, at_once)(iter(batches)) for x in b.to_pylist()]
        got = {(int(x["query_id"][1:]), x["tmdb_id"] or 0, x["c"] / sketch.SLOTS) for x in out}
        assert len(got) == len(out) and got == {x for x in full_scan(asked, refs, n) if x[0] != 7}
    assert list(identify._streamed(files, n, 10, 7)(iter([batches[0].slice(7, 1)]))) == []


def test_all_with_all_shuffles_each_sketch_once(spark, monkeypatch):
    """Before, each was shuffled for each part of the other side, so four times the rows made sixteen times the disk."""
    for name in ("LEAST_BLOCK", "BLOCK_REFERENCES", "BLOCK_QUERIES", "STREAM_QUERIES", "STREAM_REFERENCES"):
        monkeypatch.setattr(identify, name, 100, raising=False)
    written = []
    for n in (400, 1600):
        rows = spark.range(n).select(F.col("id").alias("query_id"), F.col("id").alias("tmdb_id"), F.lit(1).alias("season"), F.lit(1).alias("episode"), F.transform(F.sequence(F.lit(0), F.lit(sketch.SLOTS - 1)), lambda i: F.pmod(F.xxhash64(F.col("id").bitwiseAND(F.lit(1023)), i), F.lit(1 << 32))).alias("sketch"), F.lit(1).alias("hash_count"))
        before = shuffled(spark)
        out = identify.similar(rows.select("query_id", "sketch", "hash_count"), rows.drop("query_id"), 1).collect()
        written.append(shuffled(spark) - before)
        assert {(x.query_id, x.tmdb_id) for x in out} == {(q, q % 1024) for q in range(n)}  # of equal ones the first
    assert written[1] < 6 * written[0] and written[1] < 2 * 1600 * 4 * sketch.SLOTS
