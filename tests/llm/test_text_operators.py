"""Corpus operators against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import random
import re

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from echoquorum.llm import decontaminate, lines, mixing, passages, quality, queries, sharding, simhash
from echoquorum.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names those of results and helpers would clash with.
CLASH = ["n_words", "fp", "k1", "row_", "copies", "shard", "at", "kept"]

R = random.Random(5)
WORDS = ["Alpha", "beta", "Gamma,", "delta", "ÉTÉ", "été", "zz#", "1", "the", "of", "日本"]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def rows():
    base, long = prose(90), prose(20_000)
    out = [(1, None), (2, ""), (3, " \n\t"), (4, base), (5, base), (6, base.replace("beta", "Beta")), (7, long), (8, "one"), (9, "x\n" + base + "\r\nX \n\n"), (None, base), (10, "a\x00b\x7fc é"), (11, "x\ny\nx\ny"), (11, "x\ny\nx\ny")]
    out += [(20 + i, f"shared Line\n{prose(30 + i)}\n \tSHARED line\x0b") for i in range(14)]
    return [(i, t, R.choice(["en", None, "fr"]), R.choice(["s0", "s1", None]), len(t or "")) for i, t in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("x") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="module")
def arrow():
    import pyarrow as pa

    return pa.table({n: [r[i] for r in ROWS] for i, n in enumerate(("doc_id", "text", "lang", "source", "n_chars"))})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_quality_equals_sql(docs, arrow):
    out = quality.quality_rules(docs, keep=["doc_id"]).select("doc_id", *quality.MEASURES, "base_failed", "kept")
    assert_same(out, queries.ORACLE["op7_quality"], None, documents=arrow)


def test_quality_filter_and_bad_hosts(spark, docs, empty):
    kept = quality.filter_quality(docs)
    judged = quality.quality_rules(docs, keep=["doc_id"])
    assert kept.columns == docs.columns and kept.count() == judged.filter("kept").count() > 0
    bad = [(i, "# $ % & | < > * # $ " * 3, "en", "bad", 0) for i in range(60)] + [(100 + i, prose(60), "en", f"good{i % 5}", 0) for i in range(60)]
    bad += [(500, " ".join(map(str, range(60))), "en", "bad", 0)]
    assert {r.source for r in quality.filter_quality(spark.createDataFrame(bad, DOCS)).collect()} == {f"good{i}" for i in range(5)}
    # A host of few failures is trusted: what fails other than the base rules stays there, and goes from a suspect host.
    plain = " ".join(f"w{i}" for i in range(40))
    odd = plain + " " + "## $$ %% && ## $$ " * 2
    mixed = [(i, odd if i == 0 else plain, "en", "trusted", 0) for i in range(200)] + [(300 + i, odd if i % 3 == 0 else plain, "en", "suspect", 0) for i in range(60)]
    verdicts = {(r.source, r.failed): r.kept for r in quality.quality_rules(spark.createDataFrame(mixed, DOCS), keep=["source"]).collect()}
    assert verdicts == {("trusted", False): True, ("trusted", True): True, ("suspect", False): True, ("suspect", True): False}
    # Two documents of two don't condemn a host among hosts that differ by chance only.
    even = [(10 * h + i, odd if (i + h) % 5 == 0 else plain, "en", f"h{h}", 0) for h in range(40) for i in range(10)] + [(900 + i, odd, "en", "tiny", 0) for i in range(2)]
    assert not any(r.host_rejected for r in quality.quality_rules(spark.createDataFrame(even, DOCS)).collect())
    assert quality.quality_rules(empty).count() == 0 and quality.filter_quality(empty).columns == empty.columns


def test_default_columns_are_safe(docs):
    odd = docs.withColumns({"a.b": F.lit(1), "N_Hit": F.lit(2), "host_rejected": F.lit(3)})
    judged = quality.quality_rules(odd)
    assert "a.b" in judged.columns and judged.columns.count("host_rejected") == 1 and judged.count() == odd.count()
    assert quality.filter_quality(odd.withColumnRenamed("source", "so.urce"), host="so.urce").columns[3] == "so.urce"
    found = decontaminate.decontaminate(odd, odd.selectExpr("doc_id item_id", "text"))
    assert "a.b" in found.columns and "N_Hit" not in found.columns and found.count() == odd.count()
    with pytest.raises(ValueError):
        decontaminate.decontaminate(odd, odd.selectExpr("doc_id item_id", "text"), keep=["N_Hit"])


def test_lines_equal_sql_in_any_number_of_batches(spark, docs, arrow):
    out = lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    assert_same(out, queries.ORACLE["op3_lines"], None, documents=arrow)
    runs = lines.LineRuns(spark, 10, 1, fanout=2)
    for k in range(5):
        runs.add(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(5)) == k))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    # The state is read again from its folder, and a batch is joined to the runs without an exchange of theirs.
    runs.close()
    runs = lines.LineRuns(spark, folder=runs.folder)
    assert [len(x) for x in runs.levels] == [1, 0, 1] and runs.fanout == 2 and runs.version == 5
    plan = runs.new_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1
    again = runs.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    assert_same(again, queries.ORACLE["op3_lines"], None, documents=arrow)


@pytest.mark.parametrize("n_files", [1, 4, 40])
def test_line_query_on_a_table_of_several_files(spark, docs, arrow, tmp_path, n_files):
    docs.select(*arrow.column_names).repartition(n_files).write.parquet(f"{tmp_path}/documents.parquet")
    assert len(lines.batches_of(spark.read.parquet(f"{tmp_path}/documents.parquet"), 4)) == min(n_files, 4)
    assert_same(queries.op3_lines(spark, str(tmp_path)), queries.ORACLE["op3_lines"], None, documents=arrow)


def test_runs_hold_one_row_for_each_key(spark, docs):
    """Counts of several runs of several files, before and after a compaction, are those of the whole table."""
    want = sorted(map(tuple, lines.key_counts(docs, "text", 1).collect()))
    runs = lines.LineRuns(spark, 1000, 1, fanout=3)  # nothing settles, so all is counted on
    for k in range(5):
        runs.add(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(5)) == k).repartition(4))
    assert [len(x) for x in runs.levels] == [2, 1]
    assert sorted(map(tuple, runs._merged([r for level in runs.levels for r in level]).collect())) == want
    for run in runs.runs():
        assert run.count() == run.select("h1", "h2").distinct().count()
    runs.delete()


def test_lines_of_filtered_derived_and_united_frames(spark, docs, arrow, tmp_path):
    docs.select(*arrow.column_names).repartition(6).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    docs.select(*arrow.column_names).withColumn("part", F.pmod("doc_id", F.lit(2))).write.partitionBy("part").parquet(f"{tmp_path}/parts")
    hidden = spark.read.parquet(f"{tmp_path}/parts")
    frames = [table.filter("doc_id % 2 = 0"), table.withColumn("text", F.upper("text")), table.unionByName(table.filter("doc_id > 20")), hidden, hidden.filter("part = 1")]
    for df in frames:
        assert len(lines.batches_of(df, 4)) == 4
        assert sum(b.count() for b in lines.batches_of(df, 4)) == df.count()
        out = lines.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
        assert_same(out, queries.ORACLE["op3_lines"], None, documents=df.select("doc_id", "text").toArrow())


def test_light_and_heavy_lines_are_dropped_alike(spark):
    import pyarrow as pa

    texts = [f"often\nown {i}" + ("\n RARE " if i % 4 == 0 else "") + "\noften" for i in range(48)] + ["rare\nseldom"] * 5
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    runs = lines.LineRuns(spark)
    runs.add(df)
    settled = {r.n_docs for r in runs.settled().collect()}
    assert settled == {48, 17}
    for share, heavy in ((4096, 2), (2, 1), (1, 0)):
        assert sum(n >= max(2, -(-65 // share)) for n in settled) == heavy
        out = runs.drop_lines(df, heavy_share=share).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
        assert_same(out, queries.ORACLE["op3_lines"], None, documents=pa.table({"doc_id": ids, "text": texts}))
    runs.delete()


def test_lines_of_an_empty_table(spark, empty):
    assert lines.dedup_lines(empty).count() == 0
    runs = lines.LineRuns(spark)
    runs.add(empty)
    assert runs.drop_lines(empty).count() == 0
    runs.delete()


def test_mixing_equals_sql(docs, arrow, empty):
    out = mixing.mix(docs, queries.WEIGHTS, max_epochs=2, seed=queries.MIX_SEED, domain=queries.domain_of(F.col("source")))
    out = out.select(F.when(F.col("id") != "", F.col("id").cast("long")).alias("doc_id"), "domain", "lang", "source", F.col("tokens").alias("n_tokens"), "copies")
    assert_same(out, queries.ORACLE["op1_mix"], None, documents=arrow)
    assert mixing.mix(empty, {}).count() == 0


def test_mixing_rows_are_the_chosen_ones(docs):
    total = {r.id: r.n for r in mixing.mix(docs, {"": 1}, 500, 3).groupBy("id").agg(F.sum("copies").alias("n")).collect()}
    rows_ = mixing.mix_rows(docs, {"": 1}, 500, 3)
    assert rows_.columns == docs.columns
    assert {str(r.doc_id or ""): r.n for r in rows_.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == total


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 1000)], "domain string, lang string, source string, tokens long")
    out = {r.source: r.share for r in mixing.allocate(leaves, {}, 800, 1).collect()}
    # a has 400: x and y 200 each; s1 can take but 10 of its 100, the rest goes to s2, not to y or b.
    assert out == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}
    out = {r.source: r.share for r in mixing.allocate(leaves, {"b": 0}, 10_000, 1).collect()}
    assert out == {"s1": 10, "s2": 1000, "s3": 1000, "s4": 0}
    with pytest.raises(ValueError):
        mixing.choose(leaves, {"a": -1}, 1, 1, 0)


def shard_query(docs, **options):
    out = sharding.assign_shards(docs, 24, **options)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@pytest.mark.parametrize("bucket_rows", [sharding.BUCKET_ROWS, 1, 0.1])
def test_shards_equal_sql(docs, arrow, empty, bucket_rows):
    short = [i for i, r in enumerate(ROWS) if len(r[1] or "") < 5000]  # the SQL's checksum is slow on long texts
    assert_same(shard_query(docs.filter("n_chars < 5000"), bucket_rows=bucket_rows), queries.ORACLE["op8_shards"], None, documents=arrow.take(short))
    got = sorted((r.shard, r.slot) for r in shard_query(docs, bucket_rows=bucket_rows).collect())
    n = len(ROWS)
    want = [n // 24 + (s < n % 24) for s in range(24)]
    assert got == [(s, k) for s in range(24) for k in range(want[s])]
    assert sharding.assign_shards(empty, 24).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, keep=("Shard",))


def test_equal_rows_are_dealt_out(spark):
    df = spark.createDataFrame([(None, "same", "en", "s")] * 300 + [(i, "x", "en", "s") for i in range(50)], "doc_id long, text string, lang string, source string")
    got = sorted((r.shard, r.slot) for r in sharding.assign_shards(df, 7, bucket_rows=2).collect())
    assert got == [(s, k) for s in range(7) for k in range(50)]


def test_files_of_shards_are_pruned_by_each_dimension(spark, tmp_path):
    from glob import glob

    import pyarrow.parquet as pq

    rows_ = [(i, "t" * R.randrange(1, 3000), f"l{R.randrange(8)}", f"host{R.randrange(900):04d}", 1) for i in range(6000)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, shard int")
    sharding.write_shards(df, f"{tmp_path}/out", 64)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(tuple(r) for r in back.select(*df.columns).collect()) == sorted(rows_)
    files = [pq.read_metadata(f) for f in glob(f"{tmp_path}/out/*/*.parquet")]

    def touched(column, value):
        at = [c for c in range(files[0].num_columns) if files[0].schema.column(c).name == column][0]
        stats = [f.row_group(0).column(at).statistics for f in files]
        return sum(s.min <= value <= s.max for s in stats) / len(files)

    assert touched("lang", "l3") < 0.4 and touched("source", "host0450") < 0.35


def test_shards_follow_the_curve(docs):
    rows_ = sharding.assign_shards(docs, 4).orderBy("shard", "slot").collect()
    assert [r.cell for r in rows_] == sorted(r.cell for r in rows_)


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 5), (3, 4), (4, 3)])
def test_hilbert_neighbours_touch(dims, bits):
    table = sharding.hilbert_table(dims, bits)
    cells = np.argsort(table)
    coords = np.stack([cells >> (bits * k) & ((1 << bits) - 1) for k in range(dims)])
    assert sorted(table) == list(range(1 << dims * bits)) and (np.abs(np.diff(coords, axis=1)).sum(axis=0) == 1).all()


def brute_windows(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    return w, {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()


@pytest.mark.parametrize("limit", [decontaminate.MAX_NODES, 900])
def test_decontamination_equals_brute_force(spark, limit):
    items = [(1, prose(20)), (2, "Beta gamma"), (3, None), (4, "--"), (5, prose(13)), (None, "the"), (6, "beta, GAMMA")]
    texts = [None, "", prose(50), "x " + items[0][1].upper() + " y", f"é{items[4][1]}", items[4][1] + " tail", prose(400) + " " + items[0][1], "a beta-gamma b"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, hits string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(d, bench, max_nodes=limit).collect()}
    left = decontaminate.drop_contaminated(d, bench, max_nodes=limit)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, r in got.items() if not r.contaminated)
    with pytest.raises(ValueError):
        decontaminate.decontaminate(d.withColumn("items", F.lit(1)), bench)
    for i, t in enumerate(texts):
        w, _ = brute_windows(t)
        mark, found = [False] * len(w), set()
        for item, it in items:
            for g in brute_windows(it)[1] if item is not None else ():
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        found.add(str(item))
                        mark[k : k + len(g)] = [True] * len(g)
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), sum(mark), sorted(found)), i
        assert r.contaminated == (sum(mark) > 0 and 20 * sum(mark) >= len(w))
        covered = [x for s in r.spans for x in brute_windows(t[s.begin : s.end])[0]]
        assert covered == [x for x, m in zip(w, mark) if m]
    assert decontaminate.drop_contaminated(d, bench).columns == d.columns
    assert decontaminate.decontaminate(d.limit(0), bench).count() == 0 and decontaminate.decontaminate(d, bench.limit(0)).filter("contaminated").count() == 0


def brute_fingerprint(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    short = docs.filter("n_chars < 5000")
    for r in short.join(simhash.near_duplicates(short).withColumnRenamed("fp", "found").withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i"))).collect():
        assert r.found & (2**64 - 1) == brute_fingerprint(r.text)


def brute_components(fps, limit=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = list(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= limit:
                root[find(a)] = find(b)
    out = {}
    for f in fs:
        out.setdefault(find(f), set()).add(f)
    return {frozenset(x) for x in out.values()}


def test_links_equal_brute_force(spark):
    seeds = [R.getrandbits(64) for _ in range(12)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(40):
            x = s
            for _ in range(R.randint(1, 7)):
                x ^= 1 << R.randrange(64)
            fps.add(x)
    fps |= {0, 1, 3, 2**64 - 1, 2**63}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {}
    for r in connected_components(simhash.links(df, len(signed))).collect():
        got.setdefault(r.root, set()).add(r.node & (2**64 - 1))
    assert {frozenset(x) for x in got.values()} == {x for x in brute_components(fps) if len(x) > 1}


@pytest.mark.parametrize("group_rows", [60, 5])
def test_longer_prefixes_give_the_same_links(spark, group_rows):
    """Clouds of near fingerprints, whose prefixes are made longer up to the whole word."""
    seeds = [R.getrandbits(64) for _ in range(3)]
    fps = set(seeds)
    for s in seeds:
        fps |= {s ^ (1 << R.randrange(64)) ^ (1 << R.randrange(64)) for _ in range(25)}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {}
    for r in connected_components(simhash.links(df, len(signed), group_rows=group_rows)).collect():
        got.setdefault(r.root, set()).add(r.node & (2**64 - 1))
    assert {frozenset(x) for x in got.values()} == {x for x in brute_components(fps) if len(x) > 1}


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows_ = [(3, b, 1), (5, a, 1), (5, b, 1), (5, a, 1), (None, a, 1), (None, "own text of a row", 2), (None, "own text of a row", 2), (7, a, 2)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, n int")
    kept = sorted(((r.doc_id, r.text, r.n) for r in simhash.drop_near_duplicates(df).collect()), key=str)
    assert kept == sorted([(3, b, 1), (5, a, 1), (None, "own text of a row", 2)], key=str)


def test_deep_splitting_gives_the_same_links(monkeypatch):
    base = R.getrandbits(64)
    fps = np.array(sorted({base ^ (1 << R.randrange(40)) ^ (1 << R.randrange(40)) ^ (1 << R.randrange(40)) for _ in range(60)}), np.uint64)
    full = simhash._link(np.arange(len(fps)), fps, fps, np.arange(len(fps)), np.full(len(fps), 2), 64, 4)
    monkeypatch.setattr(simhash, "CHUNK", 500)
    assert (simhash._link(np.arange(len(fps)), fps, fps, np.arange(len(fps)), np.full(len(fps), 2), 64, 4) == full).all()
    parts = {}
    for f, p in zip(fps.tolist(), full.tolist()):
        parts.setdefault(p, set()).add(f)
    assert {frozenset(x) for x in parts.values()} == brute_components(fps.tolist())


def test_one_document_of_each_group_stays(spark, docs, empty):
    d = docs.filter("n_chars < 5000")
    judged = simhash.near_duplicates(d).collect()
    assert len(judged) == d.count() and all(r.component_id is not None for r in judged)
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in judged})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_components_of_a_path_and_of_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (50, None)], "u long, v long")
    assert {(r.node, r.root) for r in connected_components(path).collect()} == {(i, 0) for i in range(41)}
    assert connected_components(path.limit(0)).count() == 0


def brute_clusters(texts, threshold=0.8):
    classes, places = {}, {}
    for i, t in enumerate(texts):
        for at, p, _ in passages.paragraphs(t):
            places.setdefault(p, []).append((i, at))
    for p in places:
        w = p.split()
        classes[p] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {p: p for p in classes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = list(classes)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if len(classes[a] & classes[b]) >= threshold * len(classes[a] | classes[b]):
                root[find(a)] = find(b)
    out = {}
    for p in ps:
        out.setdefault(find(p), []).extend(places[p])
    return {frozenset(x) for x in out.values() if len(x) > 1}


@pytest.mark.parametrize("block", [1000, 7])
def test_passages_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", "short line", " ".join(base), " ".join(base).upper() + "\n" + " ".join(base)]
    for _ in range(60):  # variants of one paragraph, many of them unlike the centre
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(60)] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(26, 90))) for _ in range(20)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(160))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(80)) + " " + passage + " " + " ".join(rng.choice(vocabulary) for _ in range(70)) for _ in range(2)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, s string, h int")
    rows_ = passages.repeated_passages(df).collect()
    got = {}
    for r in rows_:
        got.setdefault(r.cluster_id, []).append((r.doc_id, r.paragraph))
    assert {frozenset(x) for x in got.values()} == brute_clusters(texts)
    for c, places in got.items():
        own = [r for r in rows_ if r.cluster_id == c]
        assert [(r.doc_id, r.paragraph) for r in own if not r.removed] == [min(places)] and {r.kept_doc_id for r in own} == {min(places)[0]}
    assert {len(texts) - 1, len(texts) - 2} <= {r.doc_id for r in rows_}  # a passage inside two long lines
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_band_tuning():
    r, b = passages.tune_bands(0.8)
    assert 1 - (1 - 0.8**r) ** b >= 0.998
    with pytest.raises(ValueError):
        passages.tune_bands(0.1, 0.9999, 8, 2)


def test_passages_inside_other_text_are_found(spark):
    """Planted passages of 51 to 80 words, each in two texts, on one line or over many, against brute force over their words."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    planted, texts = {}, []
    for i in range(40):
        passage = words(rng.randint(51, 80))
        for copy in range(2):
            before, after = words(rng.randint(0, 60)), words(rng.randint(0, 60))
            planted[2 * i + copy] = (len(before), len(before) + len(passage))
            w = before + passage + after
            texts.append("".join(x + ("\n" if copy and rng.random() < 0.2 else " ") for x in w))
    alone = [" ".join(words(100)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts + alone)), "doc_id long, text string")
    found, removed = {}, {}
    for r in passages.repeated_passages(df, min_run=passages.MIN_RUN).collect():
        start = sum(n for at, _, n in passages.paragraphs((texts + alone)[r.doc_id]) if at < r.paragraph)
        found.setdefault(r.doc_id, []).append((start, start + r.n_words))
        removed.setdefault(r.doc_id, []).append(r.removed)
    assert set(found) == set(planted)
    for i, (a, b) in planted.items():
        assert all(min(y, b) - max(x, a) >= 0.7 * (y - x) for x, y in found[i])  # similar units may have a word or two more
        assert sum(y - x for x, y in found[i]) >= passages.MIN_RUN
        assert all(removed[i]) if i % 2 else not any(removed[i])


def test_prefixes_meet_every_similar_set():
    rng = random.Random(4)
    for _ in range(3000):
        n = rng.randint(1, 30)
        a = set(rng.sample(range(60), n))
        b = (a | set(rng.sample(range(60), rng.randint(0, 3)))) - set(rng.sample(sorted(a), min(n, rng.randint(0, 2))))
        if b and a != b and len(a & b) >= 0.8 * len(a | b):
            cut = [set(sorted(x)[: passages.prefix_size(len(x), 0.8)]) for x in (a, b)]
            assert cut[0] & cut[1]


def test_near_copies_of_the_pipeline_equal_brute_force(spark, docs, empty):
    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = [f"n{i}" for i in range(500)]
    texts = []
    for _ in range(15):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(90, 200))]
        texts.append(" ".join(w))
        for edits in (1, 2, 3, 6):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append("  ".join(v).title())
    texts += [texts[0], None, "", "  "]
    ids = list(range(len(texts)))
    rng.shuffle(ids)

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {i: grams(t) for i, t in zip(ids, texts)}, {i: i for i in ids}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    left = [r.doc_id for r in corpus_pipeline.simhash_stage(spark, df, "").collect()]
    assert sorted(left) == sorted({find(i) for i in ids})
    # Repeated rows, and rows without an id: one of each group stays.
    no_id = spark.createDataFrame([(None, texts[0]), (None, "a b c d e f"), (None, "A b c d e f")] + [(7, "x y z")] * 2, "doc_id long, text string")
    left = corpus_pipeline.simhash_stage(spark, df.unionByName(no_id), "").collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None and r.text != "x y z") == sorted({find(i) for i in ids})
    assert sum(r.doc_id is None for r in left) == 1 and sum(r.text == "x y z" for r in left) == 1
    assert simhash.drop_similar(docs).columns == docs.columns and simhash.drop_similar(empty).count() == 0


def test_near_copies_of_the_pipeline_are_found_by_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(3)
    base = [f"s{rng.randrange(4000)}" for _ in range(900)]
    texts = [" ".join(base), " ".join(base + ["tail"]), "Head " + " ".join(base), "p " * 200 + "x y z", "p " * 200 + "u v w"]
    fps = [brute_fingerprint(t) for t in texts]
    assert all(0 < (fps[0] ^ f).bit_count() <= 4 or f == fps[0] for f in fps[1:3]) and (fps[3] ^ fps[4]).bit_count() <= 4
    bands = simhash._band_keys
    monkeypatch.setattr(simhash, "_band_keys", lambda rows, similarity: bands(rows, similarity).limit(0))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # The last two have the same fingerprint, but are no near copies.
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, df, "").collect()) == [0, 3, 4]


def test_mixing_tells_rows_apart_by_the_column_of_a_null(spark):
    df = spark.createDataFrame([(1, "a b", "x", None), (1, "a b", None, "x")], "doc_id long, text string, lang string, source string")
    out = mixing.mix_rows(df, {}, budget=8, max_epochs=2).collect()
    assert sorted((str(r.lang), str(r.source)) for r in out) == [("None", "x")] * 2 + [("x", "None")] * 2


def test_removed_passages_leave_the_texts(spark):
    rng = random.Random(21)
    words = lambda n: [rng.choice(["\u00e9t\u00e9", "\U0001f600", ""]) + f"q{rng.randrange(4000)}" for _ in range(n)]
    passage = words(70)
    parts = [(words(40), words(30)) for _ in range(3)]
    rows_ = [(i, "\n ".join(a + passage + b)) for i, (a, b) in enumerate(parts)] + [(3, None), (4, ""), (None, "once " * 3)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    found = passages.repeated_passages(df, min_run=passages.MIN_RUN)
    got = {r.doc_id: r.text for r in passages.without_passages(df, found).collect()}
    assert len(got) == len(rows_) and got[0] == rows_[0][1] and got[3] is None and got[4] == ""
    for r in found.collect():
        assert len(rows_[r.doc_id][1][r.begin : r.end].split()) == r.n_words
    for i in (1, 2):
        cut = sorted((r.begin, r.end) for r in found.collect() if r.doc_id == i)
        text, want, at = rows_[i][1], "", 0
        for b, e in cut:
            want, at = want + text[at:b], e
        assert cut and got[i] == want + text[at:]


def test_mixing_cuts_among_rows_that_share_an_id(spark):
    """All rows without an id: the budget ends in the middle of one id's rows."""
    rows_ = [(None, f"t{i} " * 3, "en", "s") for i in range(200)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string").repartition(3)
    out = mixing.mix_rows(df, {}, budget=301, max_epochs=1)
    assert out.count() == 100 and out.distinct().count() == 100
    assert {r.text for r in mixing.mix_rows(df, {}, budget=301, max_epochs=1).collect()} == {r.text for r in out.collect()}


def test_a_very_long_text_has_its_fingerprint():
    """More shingles than are hashed at once."""
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_passages_with_null_ids_repeated_rows_and_long_texts(spark):
    rng = random.Random(31)
    words = lambda n: " ".join(f"z{rng.randrange(5000)}" for _ in range(n))
    passage, long = words(80), words(40_000)
    rows_ = [(None, words(20) + " " + passage), (None, words(30) + " " + passage), (4, passage), (4, passage), (9, long + " " + passage), (10, None), (11, "")]
    df = spark.createDataFrame(rows_, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("at", "row", "k1", "begin", "n")})
    found = passages.repeated_passages(df, min_run=passages.MIN_RUN).collect()
    assert {r.doc_id for r in found} == {None, 4, 9} and {r.kept_doc_id for r in found} <= {None, 4}
    by_text = {}
    for r in found:
        by_text.setdefault((r.doc_id, r.text_hash), []).append(r.n_words)
    assert len(by_text) == 4 and all(sum(n) >= 50 for n in by_text.values())
    assert len([r for r in found if r.doc_id == 4]) == 2 * len({r.paragraph for r in found if r.doc_id == 4})  # each row has its places


def test_token_counts_of_nothing(spark):
    from echoquorum.llm import edits

    P = pytest.importorskip("public_tokenizers")
    how = str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN
    none = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    counted = edits.count_tokens(none, *how, extra={"edits": queries.script(F.col("text"))})
    assert edits.apply_edits(counted, *how).count() == 0
    with pytest.raises(ValueError):
        edits.count_tokens(none, *how, extra={"tree": F.lit(1)})
