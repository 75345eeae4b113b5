"""Resampling, lexical search and language identification against SQL, brute force and held-out documents."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import assert_same
from conftest import SMALL
from pyspark.sql import functions as F
from test_text_operators import ROWS, arrow, docs, empty  # noqa: F401

from echoquorum.llm import langid, queries, resample, search

R = random.Random(11)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, " ".join(R.choice("alpha beta Gamma été the 日本 zz".split()) for _ in range(40))), (2, None), (3, ""), (4, "alpha, the ALPHA the"), (4, "one"), (None, "beta gamma"), (6, "nowhere to be found")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_resampling_equals_sql(docs, arrow, bench):  # noqa: F811
    out = resample.resample(docs, bench)
    assert_same(out, queries.ORACLE["op12_resample"], None, documents=arrow, benchmark=bench.toArrow())
    # Half of them, so that ranks go over the bounds of several ranges.
    sql = queries.ORACLE["op12_resample"].replace("5 * n // 100", "50 * n // 100")
    assert_same(resample.resample(docs, bench, percent=50), sql, None, documents=arrow, benchmark=bench.toArrow())


def test_resampling_of_nothing(docs, bench, empty):  # noqa: F811
    assert resample.resample(empty, bench).count() == 0
    out = resample.resample(docs, bench.limit(0), percent=100)
    assert out.count() == len(ROWS) and out.agg(F.max("rank")).first()[0] == out.filter("rank IS NOT NULL").count() > 0


def test_scoring_has_no_explode_and_shuffles_no_text(docs, bench):  # noqa: F811
    plan = resample.resample(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "run_" not in plan


def test_search_equals_sql(docs, arrow, bench, empty):  # noqa: F811
    out = search.search_documents(docs, bench)
    assert_same(out, queries.ORACLE["op13_search"], None, documents=arrow, benchmark=bench.toArrow())
    # A block for each query, and an index of two builds.
    out = search.search_documents(docs, bench, max_bytes=1)
    assert_same(out, queries.ORACLE["op13_search"], None, documents=arrow, benchmark=bench.toArrow())
    assert search.search_documents(empty, bench).count() == 0 == search.search_documents(docs, bench.limit(0)).count()


def test_an_index_takes_further_documents(spark, docs, arrow, bench, tmp_path):  # noqa: F811
    half = F.coalesce("doc_id", F.lit(0)) % 2
    search.build_index(docs.filter(half == 0), f"{tmp_path}/index")
    index = search.build_index(docs.filter(half == 1), f"{tmp_path}/index")
    twice = bench.unionByName(bench)
    assert_same(search.search(index, twice), queries.ORACLE["op13_search"], None, documents=arrow, benchmark=twice.toArrow())


def range_rows(texts, name):
    made = search._Range()
    for i, t in texts:
        made.add(i, t)
    import pyarrow as pa

    return made.rows(name, pa.int64()).to_pylist()


@pytest.mark.parametrize("n", [1, 16, 17, 300, 5000])
def test_trees_find_what_scoring_all_finds(n):
    """Ranges searched one after the other against the formula, over few different scores and so with many ties."""
    r = random.Random(n)
    vocabulary = [f"t{k}" for k in range(30)]
    texts = [(i if i % 7 else None, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(30)], k=r.choice([0, 1, 3, 3, 20])))) for i in range(n)]
    r.shuffle(texts)
    asked = [(q, q, Counter(w.encode() for w in r.choices(vocabulary, k=r.choice([1, 2, 8])))) for q in range(12)] + [(12, 12, Counter([b"none"]))]
    sizes = [len(t.split()) for _, t in texts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    if not n_terms:
        return
    df = Counter(w for _, t in texts for w in set(t.split()))
    weights = {w.encode(): int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * c + 1)))) for w, c in sorted(df.items())}
    block = search._Block(asked, weights, n_docs, n_terms)
    best, opened = [[] for _ in block.queries], 0
    for a in range(0, n, 1000):
        known = [x for x in range_rows(texts[a : a + 1000], str(a)) if x["term"] is None or x["term"].encode() in block.number]
        opened += search.search_range(known, block, best, 10)
    for (q, _), own in zip(block.queries, best):
        scored = []
        for (i, t), size in zip(texts, sizes):
            tf, m = Counter(t.split()), 25 + 75 * size * n_docs // n_terms
            score = sum(c * weights[w] * (10**9 * tf[w.decode()] // (1000 * tf[w.decode()] + 8 * m)) for w, c in asked[q][2].items() if w in weights and tf[w.decode()])
            scored.append((-score, i is None, i or 0))
        want = [x for x in sorted(scored)[:10] if x[0]]
        assert [(s, none, 0 if none else i) for s, none, i in own] == want
    if n == 5000:  # most of the 313 lowest nodes and their parents stay closed
        assert opened < 0.7 * len(block.queries) * (313 + 20)


def test_a_range_ends_with_its_documents_or_postings(monkeypatch):
    made = search._Range()
    monkeypatch.setattr(search, "RANGE_POSTINGS", 50)
    made.add(1, " ".join(f"w{k}" for k in range(49)))
    assert not made.full()
    made.add(2, "w0")
    assert made.full()


def test_gradients_through_time_are_those_of_differences():
    r = np.random.default_rng(3)
    net = langid.new_network(["a", "b", "c"], 4, 1)
    for name in ("table", "inner", "bias", "out", "out_bias"):
        setattr(net, name, r.normal(0, 0.7, getattr(net, name).shape))  # in doubles
    bytes_, target = r.integers(97, 102, (9, 5)).astype(np.int16), r.integers(0, 3, 5)
    bytes_[6:, 2], bytes_[4:, 4] = 256, 256

    def loss():
        return langid.gradients(net, bytes_, target)[0]

    _, grads = langid.gradients(net, bytes_, target)
    for w, g in zip(net.weights(), grads):
        places = [i for i in np.ndindex(*w.shape) if w.shape[-1] != 257 or 97 <= i[-1] < 102]
        for i in random.Random(1).sample(places, min(12, len(places))):
            old = w[i]
            w[i] = old + 1e-2
            up = loss()
            w[i] = old - 1e-2
            down = loss()
            w[i] = old
            assert abs((up - down) / 2e-2 - g[i]) < 2e-3 + 0.02 * abs(g[i])
        if w.shape[-1] == 257:
            assert not np.abs(g[..., 256]).max()  # pads teach nothing


def test_texts_have_the_labels_that_they_have_alone():
    net = langid.new_network(["a", "b"], 4, 1)
    texts = [b"x", b"abc " * 100, b"z" * langid.WINDOW, "été".encode() * 3, b"long " * 40_000]
    together = list(langid.pooled(net, iter(texts)))
    assert len(together) == len(texts)
    for t, p in zip(texts, together):
        (alone,) = langid.pooled(net, iter([t]))
        assert np.allclose(p, alone, atol=1e-5) and abs(p.sum() - 1) < 1e-5
        # Every position by itself, window by window.
        rows = [langid.label(net, langid.forward(net, np.frombuffer(t[a : a + langid.WINDOW], np.uint8).astype(np.int16)[:, None])[0])[:, :, 0].sum(axis=0) for a in range(0, len(t), langid.WINDOW)]
        assert np.allclose(np.sum(rows, axis=0) / len(t), p, atol=1e-4)


def test_languages_of_held_out_documents(spark):
    out = queries.op11_language(spark, SMALL)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows_ = out.collect()
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and {r.doc_id for r in rows_} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows_)
    held = [r for r in rows_ if r.held_out]
    assert len(held) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_unreadable_texts_have_no_language(spark, docs, empty):  # noqa: F811
    out = {(r.doc_id, r.lang_pred == "und", r.score > 0) for r in langid.identify_languages(docs).collect()}
    assert {(1, True, False), (2, True, False), (3, True, False), (7, False, True)} <= out and len(out) >= len({r[0] for r in ROWS})
    assert langid.identify_languages(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify_languages(unlabelled).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.excerpts(docs.selectExpr("doc_id id", "text", "string(doc_id) lang"), sample=3)


def test_the_sample_is_that_of_the_least_hashes(spark):
    df = spark.range(30_000).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 10 < 8, "a").when(F.col("id") < 100, "rare").otherwise("b").alias("lang"))
    got = langid.excerpts(df, sample=60)
    o = F.pmod(F.xxhash64(F.lit(6), "id", "text"), F.lit(1 << 52))
    want = [r.lang for lang in ("a", "b", "rare") for r in df.filter(F.col("lang") == lang).orderBy(o).limit(20).collect()]
    assert [lang for lang, _ in got] == want and len(got) == 60
    whole = {lang: [r.text for r in df.filter(F.col("lang") == lang).orderBy(o).limit(20).collect()] for lang in ("a", "b", "rare")}
    assert all(any(t in text for text in whole[lang]) for lang, t in got)


def test_held_out_documents_teach_nothing(spark, docs):  # noqa: F811
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.identify_languages(other).collect()), key=str) == sorted(map(tuple, langid.identify_languages(docs).collect()), key=str)
