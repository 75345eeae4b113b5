"""Token files, token counts, archives and the pipeline: round trips, damage, brute force."""

import io
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echoquorum.llm import edits, queries, rangecoder, tokens, warc

P = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " \n", "Don't stop, it's 12 o'clock!", "ÉTÉ été ﬁ é 日本語", "<|endoftext|>x <|startoftext|>", "a" * 5000, "w" + " b" * 9000, "tab\tand\x0bmore\x1cunits", "Don't stop, it's 12 o'clock!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(TEXTS)] + [(4, "twice", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int").repartition(3)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=400), st.integers(1, 60))
def test_range_coder_is_an_identity(ids, times):
    round_trip(np.array(ids * times, np.uint32)[:20000])


def round_trip(x):
    sizes = [min(rangecoder.BLOCK, len(x) - i) for i in range(0, len(x), rangecoder.BLOCK)]
    head, coded = rangecoder.encode(x)
    assert (rangecoder.decode(head, coded, sizes) == x).all()
    return len(head) + sum(map(len, coded))


@pytest.mark.parametrize("n", [1, 255, 256, 257, 8191, 8192, 8193, 16385])
def test_range_coder_at_the_edges_of_blocks_and_intervals(n):
    r = np.random.default_rng(n)
    round_trip(np.zeros(n, np.uint32))
    round_trip(r.geometric(0.05, n).astype(np.uint32))
    round_trip(np.tile(np.array([5, 2**32 - 1, 7], np.uint32), n)[:n])


def test_range_coder_takes_more_ids_than_a_table_has_room_for():
    r = np.random.default_rng(3)
    round_trip(r.permutation(np.arange(2 * rangecoder.SYMBOLS, dtype=np.uint32) * 3 + 11)[:200_000])
    round_trip(r.permutation(np.arange(rangecoder.SYMBOLS, dtype=np.uint32)))


def test_range_coder_predicts():
    r = random.Random(1)
    phrases = [[r.randrange(40000) for _ in range(8)] for _ in range(20)]
    ids = np.array([i for _ in range(3000) for i in r.choice(phrases)], np.uint32)
    assert round_trip(ids) < 0.25 * 2 * len(ids)


def test_range_coder_beats_order_0_alone():
    """Order 0 alone would take the ids' entropy, and the table as well."""
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column("text").combine_chunks()
    ids = np.concatenate([x for x, _ in tokens.encoder(queries.word_tokenizer()).encode(texts)])
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    round_trip(ids)
    assert 8 * sum(map(len, rangecoder.encode(ids)[1])) / len(ids) < 0.96 * -(p * np.log2(p)).sum()


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_tokenizer())
    return [[*t.encode(text or "", add_special_tokens=False).ids, 1] for _, text in rows]


def test_token_files_hold_what_the_library_says(spark, docs):
    out = tokens.read_tokens(tokens.write_tokens(docs, queries.word_tokenizer()), ids=True).collect()
    out.sort(key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i))
    want = sorted(map(tuple, expected([(r.doc_id, r.text) for r in docs.collect()])))
    assert sorted(tuple(r.ids) for r in out) == want
    at = 0
    for r in out:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    assert tokens.read_tokens(tokens.write_tokens(docs.limit(0), queries.word_tokenizer())).count() == 0


def test_words_are_enough_for_this_tokenizer_only():
    assert tokens.encoder(queries.word_tokenizer()).by_word and not tokens.encoder(str(P.path("byte_bpe_50k.json"))).by_word


def encoded(tokenizer, texts):
    out = []
    for ids, n in tokens.encoder(tokenizer).encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]]
    return out


def library(tokenizer, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer).encode_batch([t or "" for t in texts], add_special_tokens=False)]


LETTERS = st.characters(codec="utf-8")
ODD = st.sampled_from(["'s", "'RE", "'d", "<|endoftext|>", "<|", "\u0130", "\u03a3", "\u00df", "\u1e9e", "e\u0301", "\u00b2", "\x1c", "\x85", "\xa0", "\u2028", "\u01c5", " ", "\n", "12", "\U0001f600"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(LETTERS | ODD | st.characters(min_codepoint=33, max_codepoint=0x24F, codec="utf-8"), max_size=30).map("".join) | st.none(), max_size=6))
def test_random_texts_have_the_librarys_ids(texts):
    assert encoded(queries.word_tokenizer(), texts) == library(queries.word_tokenizer(), texts)


def test_range_coder_needs_few_bytes_an_id():
    """No 64-bit copies of all ids: before, 17.7 and 15.3 bytes an id."""
    ids = (np.random.default_rng(1).zipf(1.3, 1_000_000) % 40_000).astype(np.uint32)
    peaks = []
    for run in (lambda: rangecoder.encode(ids), lambda: rangecoder.decode(*made, [min(rangecoder.BLOCK, len(ids) - i) for i in range(0, len(ids), rangecoder.BLOCK)])):
        tracemalloc.start()
        made = run()
        peaks.append(tracemalloc.get_traced_memory()[1] / len(ids))
        tracemalloc.stop()
    assert (made == ids).all() and peaks[0] < 17 and peaks[1] < 13


def test_range_coder_copies_steps_by_interval():
    """Before, 15.7 and 11.3 bytes an id."""
    ids = (np.random.default_rng(1).zipf(1.3, 1_000_000) % 40_000).astype(np.uint32)
    tracemalloc.start()
    made = rangecoder.encode(ids)
    coded = tracemalloc.get_traced_memory()[1] / len(ids)
    tracemalloc.reset_peak()
    back = rangecoder.decode(*made, [min(rangecoder.BLOCK, len(ids) - i) for i in range(0, len(ids), rangecoder.BLOCK)])
    decoded = tracemalloc.get_traced_memory()[1] / len(ids) - sum(map(len, made[1])) / len(ids)
    tracemalloc.stop()
    assert (back == ids).all() and coded < 15 and decoded < 10.8


def test_every_plain_character_has_the_librarys_ids():
    each = [chr(i) for i in range(1, 0x260)]
    texts = each + [f"a{c}b" for c in each] + [f"{c}{c}'s1{c}" for c in each] + [f"'{c}" for c in each]
    assert encoded(queries.word_tokenizer(), texts) == library(queries.word_tokenizer(), texts)
    assert encoded(str(P.path("byte_bpe_50k.json")), texts[:50]) == library(str(P.path("byte_bpe_50k.json")), texts[:50])


def test_pieces_and_segments_join_up(spark, monkeypatch):
    """Many pieces, a text longer than a piece, a document longer than a segment."""
    texts = ["word " * n for n in (3, 0, 4000, 1, 90)] * 3
    monkeypatch.setattr(tokens, "PIECE", 500)
    assert encoded(queries.word_tokenizer(), texts) == library(queries.word_tokenizer(), texts)
    parts = [tokens.segment(np.array([(1, i, len(x))], tokens.DOC), np.array(x, np.uint32)) for i, x in enumerate(library(queries.word_tokenizer(), texts))]
    back = list(tokens.read_segments(io.BytesIO(b"".join(parts))))
    assert [ids.tolist() for _, ids in back] == library(queries.word_tokenizer(), texts)


def test_known_words_are_not_divided_again(monkeypatch):
    """What goes through the pattern and to the library, piece by piece; more words than are remembered."""
    monkeypatch.setattr(tokens, "REMEMBERED", 60)
    own, divided, given = tokens.Encoder(queries.word_tokenizer()), [], []
    replace, library_of = tokens.pc.replace_substring_regex, own.bare.encode_batch_fast
    monkeypatch.setattr(tokens.pc, "replace_substring_regex", lambda x, *how: divided.extend(x.to_pylist()) or replace(x, *how))

    class Bare:
        def encode_batch_fast(self, texts, **how):
            given.extend(w for t in texts for w in t.split())
            return library_of(texts, **how)

    own.bare = Bare()
    often = " ".join(f"often{a}{b}, it's" for a in "abcde" for b in "fgh")
    for i in range(6):
        texts = [often * 3, " ".join(f"rare{a}{b}{'xyzuvw'[i]}é" for a in "abcdef" for b in "ghijkl")]
        divided.clear(), given.clear()
        ((ids, n),) = own.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == library(queries.word_tokenizer(), texts)
        assert len(divided) == len(set(divided)) and len(given) == len(set(given))
        if i:
            assert len(divided) == len(given) == 36 and not any("often" in w for w in divided + given)
    assert max(len(own.words.known), len(own.pretokens.known)) <= 60 + 60
    ((ids, n),) = own.encode(pa.array(["it's  é", None, ""], pa.large_string()))
    assert np.split(ids, np.cumsum(n))[0].tolist() == library(queries.word_tokenizer(), ["it's  é"])[0] and list(n[1:]) == [0, 0]


def test_a_damaged_block_is_found():
    data = bytearray(tokens.segment(np.array([(1, 1, 9000), (0, 0, 0)], tokens.DOC), np.arange(9000, dtype=np.uint32)))
    docs, ids = next(tokens.read_segments(io.BytesIO(bytes(data))))
    assert list(docs["n"]) == [9000, 0] and list(docs["has"]) == [1, 0] and (ids == np.arange(9000)).all()
    for at in (30, len(data) - 5):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            next(tokens.read_segments(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        next(tokens.read_segments(io.BytesIO(bytes(data[:-3]))))


HOW = str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN


def test_counts_follow_random_edits():
    split, r = edits.pretokens(*HOW), random.Random(2)
    bits = ["a", "Z", "é", " ", "  ", "\n", "\t", "23", "'", "'s", "'re", "!", "　", "日本", "   \n"]
    for _ in range(150):
        text = "".join(r.choice(bits) for _ in range(r.choice([0, 1, 30, 1500])))
        tree = edits.Tree.of(text, split)
        for _ in range(5):
            pos, drop, put = r.randint(-1, len(text) + 2), r.choice([0, 1, 9, 400]), "".join(r.choice(bits) for _ in range(r.choice([0, 1, 30, 900])))
            at = min(max(pos, 0), len(text))
            want = text[:at] + put + text[at + drop :]
            text, tree, _ = edits.edit(text, tree, pos, drop, put, split)
            assert text == want and tree.tokens == len(split.encoding.encode_ordinary(text))
            assert edits.Tree.from_bytes(tree.to_bytes()).tokens == tree.tokens


def test_an_edit_encodes_little_of_a_long_text():
    split = edits.pretokens(*HOW)
    text = "some words of a long text, " * 4000
    _, _, n = edits.edit(text, edits.Tree.of(text, split), 50_000, 3, "XY", split)
    assert n < 4 * edits.LEAF


def test_edit_query_equals_brute_force(spark, docs):
    split = edits.pretokens(*HOW)
    counted = edits.count_tokens(docs, *HOW, extra={"edits": queries.script(F.col("text"))})
    out = {(r.doc_id, r.n_tokens_before, r.n_tokens, r.text) for r in edits.apply_edits(counted, *HOW).collect()}
    want = set()
    for d in docs.select("doc_id", "text", queries.script(F.col("text")).alias("e")).collect():
        text = d.text or ""
        n = len(split.encoding.encode_ordinary(text))
        for e in d.e:
            text = text[: e.pos] + e.put + text[e.pos + e["drop"] :]
        want.add((d.doc_id, n, len(split.encoding.encode_ordinary(text)), text))
    assert out == want
    no_edits = edits.count_tokens(docs, *HOW, extra={"edits": F.lit(None).cast(f"array<{edits.EDIT}>")})
    assert all(r.n_tokens == r.n_tokens_before and r.n_encoded == 0 for r in edits.apply_edits(no_edits, *HOW).collect())


PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://b/\r\nx é", "<p>x</p>"), (4, "u", ""), (5, "u", "é" * 200_000), (5, "u", "é" * 200_000), (None, "n", "<p>x</p>"), (6, "v", "only")]


def test_archives_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha1_x", F.lit(1))
    out = warc.read_archives(warc.write_archives(df, archive_bytes=200), payloads=True).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in out), key=str)
    text = {i: (h or "").encode() for i, _, h in PAGES}
    want = [(1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "revisit", 2), (5, "response", None), (5, "response", None), (None, "revisit", 1), (6, "response", None)]
    assert got == sorted(((i, k, f, len(text[i]), warc.digest(text[i])) for i, k, f in want), key=str)
    assert all(bytes(r.payload) == text[r.page_id] for r in out if r.record_type == "response")
    again = warc.read_archives(warc.write_archives(df, min_bytes=5)).filter("record_type = 'revisit'").collect()
    assert sorted(r.page_id or 0 for r in again) == [0, 3]
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


class Kept(io.BytesIO):
    def close(self):
        pass


def archive(n=100):
    out = Kept()
    a = warc.Archive(out)
    for i in range(n):
        a.add(warc.record("response", i, "http://x/", f"<html>page {i} {'text ' * (i % 7)}</html>".encode() * 20, None, "2024-01-01T00:00:00Z"))
    a.close()
    return out.getvalue()


def test_dictionary_frame_leads_and_damage_is_found():
    data = archive()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    records = [warc.parse(x) for x in warc.frames(io.BytesIO(data))]
    assert [r["page_id"] for r in records] == list(range(100))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"WARC/1.1\r\n\r\n")))
    good = warc.record("response", 1, "u", b"abc", None, "d")
    for bad in (good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"abc", b"abd"), good.replace(b"WARC-Type: response\r\n", b""), good[:-1], b"x" + good, good.replace(b"WARC-Date", b" WARC-Date")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_plain_archives_without_dictionary_are_read():
    import zstandard

    c = zstandard.ZstdCompressor()
    data = b"".join(c.compress(warc.record("response", i, None, b"x", None, "d")) for i in range(3))
    assert [warc.parse(x)["page_id"] for x in warc.frames(io.BytesIO(data))] == [0, 1, 2]


def brute_pipeline(docs, bench):
    """(start, doc_id, n_tokens, ids_crc32) by brute force; docs: (doc_id, text, lang, source) with ids of their own."""
    import re

    import duckdb
    from test_text_operators import brute_windows

    def documents(rows_):
        return pa.table({k: pa.array([r[i] for r in rows_], t) for i, (k, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())))})

    c = duckdb.connect()
    c.register("documents", documents(docs))
    good = {i for i, ok in c.execute(f"SELECT doc_id, kept FROM ({queries.ORACLE['op7_quality']})").fetchall() if ok}
    kept = sorted((r for r in docs if r[0] in good), key=lambda r: r[0])

    def grams(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {r[0]: grams(r[1]) for r in kept}, {r[0]: r[0] for r in kept}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [r for r in kept if find(r[0]) == r[0]]
    windows = set().union(set(), *(brute_windows(t)[1] for t in bench))
    sizes = {len(g) for g in windows}

    def clean(t):
        w, _ = brute_windows(t)
        hit = {k for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        return not (hit and 20 * len(hit) >= len(w))

    kept = [r for r in kept if clean(r[1])]
    c.register("documents", documents(kept))
    times = dict(c.execute(f"SELECT doc_id, copies FROM ({queries.ORACLE['op1_mix']})").fetchall())
    order = [i for i in sorted(times) for _ in range(times[i])]
    text = {r[0]: r[1] for r in kept}
    at, want = 0, []
    for i, ids in zip(order, expected([(i, text[i]) for i in order])):
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return want


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert got == brute_pipeline(docs, bench) and len(got) > 50


def test_pipeline_takes_nulls_repeats_clashing_names_and_nothing(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(7)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    item, near = text(30), text(200)
    rows = [(i, text(60), r.choice(["en", None]), r.choice(["s0", "s1", None])) for i in range(30)]
    rows += [(30, None, "en", "s0"), (31, "", None, None), (32, near, "en", "s0"), (33, near.upper() + " tail", "en", "s1"), (34, item + " " + text(20), "en", "s0"), (35, text(30_000), "de", "s1")]
    bench = [(1, item), (2, None), (3, "")]
    names = {c: F.lit(1) for c in ("row_", "kept", "k1", "n_words", "copies", "hits_", "id_", "norm", "failed", "bucket")}

    def put(folder, rows_):
        spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string").withColumns(names).repartition(2).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(folder))
            if k < 4:
                assert set(docs.columns) >= {"doc_id", "text", "lang", "source", *names}
                docs.write.parquet(f"{folder}/{k}")
                docs = spark.read.parquet(f"{folder}/{k}")
        return sorted(map(tuple, docs.select("start", "doc_id", "n_tokens", "ids_crc32").collect()))

    want = brute_pipeline(rows, [t for _, t in bench])
    assert {x[1] for x in want} & {30, 31, 33, 34} == set() and len(want) > 20  # the long text may be more than its leaf's budget
    assert put(tmp_path / "a", rows) == want
    # Repeated rows, with an id and without, are one group each; nothing in, nothing out.
    twice = put(tmp_path / "b", rows + rows[:5] + [(None, rows[6][1], "en", "s0")] * 2)
    assert {x[1] for x in twice} <= {r[0] for r in rows}
    assert put(tmp_path / "c", []) == []


def test_contexts_are_named_at_once_as_step_by_step():
    rng = np.random.default_rng(4)
    for none, top in ((300, 300), (100_000, 100_000)):
        x = np.minimum(rng.zipf(1.3, (700, 3)) - 1, top - 1).astype(np.uint32)
        contexts = rangecoder._Contexts(3, none)
        steps = []
        for row in x:
            steps.append(contexts.look())
            contexts.learn(row)
        for found, want in zip(rangecoder._named(x, none), zip(*steps)):
            assert (found == np.array(want)).all() and (found != none).any()
