"""Transcribed cases: votes and tiers, scores, codec, intake, catalogue changes, packs, streaming."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echoquorum import schema as S
from echoquorum.functions import scalar as fn
from echoquorum.functions import sketch
from echoquorum.operators import analytics, catalog, consensus, identify, intake, packs, versioned
from echoquorum.sources import adapters
from echoquorum.streaming import jobs

E = S.EPISODE
VOTE = "id long, received_at long, pseudonym string, tmdb_id long, season int, episode int, match_confidence double, match_source string, poison_check string, disc string, promoted_at long"
PERSON = "pseudonym string, flagged int"
TITLE = "title_index int, duration_seconds int, size_bytes long, assignment string, season int, episode int, match_confidence double, match_source string"
PRINT = "tmdb_id long, season int, episode int, hashes array<bigint>"


def vote(i, who, at=1000, conf=0.9, source="engram_asr", check="pass", disc=None, episode=(1, 1, 1), promoted=None):
    return (i, at, who, *episode, conf, source, check, disc or f"disc-{who}", promoted)


def tiers(spark, votes, flagged=()):
    people = spark.createDataFrame([(v[2], int(v[2] in flagged)) for v in votes], PERSON).distinct()
    return [tuple(r) for r in consensus.episode_tiers(spark.createDataFrame(votes, VOTE), people).select("tier", "unique_contributors").collect()]


def test_tiers_by_voters(spark):
    three = [vote(i, w) for i, w in enumerate("abc")]
    assert tiers(spark, three[:1]) == [("candidate", 1)]
    assert tiers(spark, three[:2]) == [("confirmed", 2)]
    assert tiers(spark, three) == [("canonical", 3)]
    assert tiers(spark, three, flagged="c") == [("confirmed", 3)]
    assert tiers(spark, three[:1], flagged="a") == []
    assert tiers(spark, three[:2], flagged="a") == [("confirmed", 2)]


def test_ineligible_votes_and_movies_are_left_out(spark):
    assert tiers(spark, [vote(1, "a", conf=0.5), vote(2, "b", source="network_disc", conf=0.95), vote(3, "c", check="flag_conflict")]) == []
    assert tiers(spark, [vote(1, "a", episode=(1, None, None))]) == []
    movie = spark.createDataFrame([vote(1, "a", episode=(1, None, None))], VOTE)
    assert consensus.unpromotable(movie).count() == 1


def test_latest_vote_counts_and_ties_stay(spark):
    v = spark.createDataFrame([vote(1, "a", 1000), vote(2, "a", 2000), vote(3, "a", 2000), vote(4, "b", 500)], VOTE)
    assert sorted(r.id for r in consensus.latest_votes(v).collect()) == [2, 3, 4]


def test_queue_is_oldest_first_and_stamps_all_rows(spark):
    v = spark.createDataFrame([vote(1, "a", 3000, episode=(3, 1, 1)), vote(2, "a", 1000, episode=(1, 1, 1)), vote(3, "a", 2000, episode=(1, 1, 1)), vote(4, "a", 1500, episode=(2, 1, 1))], VOTE)
    assert [r.tmdb_id for r in consensus.queue(v, 2).collect()] == [1, 2]
    out = {r.id: r.promoted_at for r in consensus.promote(v, 9, 2).collect()}
    assert out == {1: None, 2: 9, 3: 9, 4: 9}


def test_consensus_threshold_and_single_vote(spark):
    rows = [(i, 1, 1, 1, hs) for i, hs in enumerate([[1, 2, 3], [2, 3, 4, 2], [3, 9, 2], []])] + [(9, 2, 1, 1, [5, 3, 1, 4, 2, 5]), (10, 3, 1, 1, [])]
    df = spark.createDataFrame(rows, "id long, tmdb_id long, season int, episode int, hashes array<long>")
    out = {r.tmdb_id: r.hashes for r in consensus.consensus_canonical(df).collect()}
    assert out == {1: [2, 3], 2: [5, 3, 1, 4, 2, 5]}


def disc(i, who, shift=0, at=1000, conf=0.9, source="engram_discdb", flagged=False):
    return (i, at, who, "d", 1, "tv", 1, [(0, 10, 10, "episode", 1, 1 + shift, conf, source)], flagged, None)


DISC = f"id long, received_at long, pseudonym string, disc_content_hash string, tmdb_id long, content_type string, season int, titles array<struct<{', '.join(x.replace(' ', ':') for x in TITLE.split(', ')) }>>, flagged boolean, promoted_at long"


def winner(spark, rows):
    return [(r.tier, r.unique_contributors) for r in consensus.disc_canonical(spark.createDataFrame(rows, DISC)).collect()]


def test_disc_tiers_conflict_cap_and_taint(spark):
    three = [disc(i, w) for i, w in enumerate("abc")]
    assert winner(spark, three) == [("canonical", 3)]
    assert winner(spark, three + [disc(7, "x", 1), disc(8, "y", 1)]) == [("confirmed", 3)]
    assert winner(spark, three + [disc(7, "x", 1)]) == [("canonical", 3)]
    assert winner(spark, [disc(1, "a"), disc(2, "b", flagged=True)]) == [("candidate", 1)]
    assert winner(spark, [disc(1, "a"), disc(2, "b", source="network_disc")]) == [("candidate", 1)]
    assert winner(spark, [disc(1, "a", conf=0.6), disc(2, "a", at=2000, conf=0.95)]) == [("candidate", 1)]


def score(spark, query, ref, n_refs=1):
    q = spark.createDataFrame([(1, query)], "query_id long, hashes array<bigint>")
    r = spark.createDataFrame([(1, 1, 1, ref)], PRINT)
    return identify.scores(q, r.select(F.lit(1).cast("long").alias("query_id"), *E), r).first()


def test_scores(spark):
    s = score(spark, [1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 5, 6, 7])
    assert (s.hash_overlap_pct, s.temporal_coherence) == (0.75, 0.75) and s.rarity_weighted_score == pytest.approx(0.75)
    assert score(spark, [1, 9, 2, 9, 3, 9, 4], [1, 2, 3, 4]).temporal_coherence == 0


def test_identify_finds_the_episode_and_keeps_the_floor(spark):
    refs = spark.createDataFrame([(1, 1, 1, list(range(5000, 5240))), (2, 1, 1, list(range(900000, 900240)))], PRINT)
    qs = spark.createDataFrame([(1, list(range(5000, 5240))), (2, list(range(240))), (3, [])], "query_id long, hashes array<bigint>")
    rows = identify.identify(qs, refs, 5).collect()
    assert [(r.query_id, r.tmdb_id) for r in rows] == [(1, 1)] and rows[0].hash_overlap_pct > 0.9 and rows[0].temporal_coherence > 0.9
    with pytest.raises(ValueError):
        identify.identify(qs, refs, 5, float("nan"))
    assert [S.clamp_k(k) for k in (None, 0, -3, 7, 99, float("nan"))] == [5, 5, 5, 7, 20, 5]


def test_screen_flags_a_conflict_only_with_other_episodes(spark):
    hashes = [i * 7 + 13 for i in range(500)]
    refs = spark.createDataFrame([(1, 1, 1, hashes), (2, 1, 1, [i * 11 + 5000000 for i in range(300)])], PRINT)
    incoming = spark.createDataFrame([(1, 2, 1, 1, hashes), (2, 1, 1, 1, hashes), (3, 3, 1, 1, [])], "id long, " + PRINT)
    out = {r.id: r for r in identify.screen(incoming, refs).collect()}
    assert out[1].poison_check == "flag_conflict" and out[1].target_tmdb_id == 1 and out[1].overlap_pct == 1
    assert out[2].poison_check == "pass" and out[3].poison_check == "pass"
    for bad in (0.05, 1, float("nan"), "x"):
        with pytest.raises(ValueError):
            S.check_threshold(bad)


def test_sketch_values(spark):
    assert [int(c[0]) for c in sketch.coefficients()] == [2274908837, 358294691]
    assert list(sketch.mixed(np.array([0, 1, 42, 4294967295]))) == [0, 1364076727, 142593372, 2180083513]
    assert list(sketch.minhash([42, 100, 200, 300, 4242424])[:4]) == [1806048989, 1220086363, 245825927, 1118418899]
    assert (sketch.minhash([]) == 0xFFFFFFFF).all()
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5])], "k long, hashes array<bigint>")
    slow = {r.slot: r.v for r in sketch.native_minhash(df.select("k", F.explode("hashes").alias("h")), ["k"]).collect()}
    assert [slow[i] for i in range(128)] == df.select(sketch.minhash128("hashes").alias("s")).first().s
    row = df.select(sketch.pack_sketch(sketch.minhash128("hashes")).alias("b")).first()
    assert len(row.b) == 512
    assert df.select(fn.jaccard_estimate(sketch.minhash128("hashes"), sketch.minhash128("hashes")).alias("j")).first().j == 1.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_codec_is_an_identity(values):
    assert list(sketch.decode(sketch.encode(np.array(values, np.int64)))) == values


def test_varints():
    assert sketch.to_varints([42, 100, 255, 256]).hex() == "2a64ff018002" and sketch.to_varints([4294967295]).hex() == "ffffffff0f"
    with pytest.raises(ValueError):
        sketch.from_varints(b"\xff" * 6 + b"\x01")
    assert list(sketch.from_varints(b"\x01\x80")) == [1]


def test_broken_blobs_decode_to_null(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03"),), (None,)], "b binary")
    assert [r[0] for r in df.select(sketch.decode_fingerprint("b")).collect()] == [None, None]


def test_digest_ignores_order_and_confidence(spark):
    a, b = (0, 10, 10, "episode", 1, 1, 0.9, "engram_asr"), (1, 20, 20, "extra", None, None, 0.8, "engram_asr")
    c = (0, 99, 1, "episode", 1, 1, 0.1, "bootstrap")
    other = (0, 10, 10, "episode", 1, 2, 0.9, "engram_asr")
    kind = DISC.split("titles ")[1].split(", flagged")[0]
    out = [r[0] for r in spark.createDataFrame([([a, b],), ([b, c],), ([other, b],)], f"t {kind}").select(fn.titles_digest(F.col("t"))).collect()]
    assert out[0] == out[1] != out[2]
    parsed = spark.createDataFrame([("{",), ("null",), ("[]",)], "j string").select(fn.parse_titles(F.col("j"))).collect()
    assert [p[0] for p in parsed] == [None, None, []]


def request(**change):
    r = {
        "wire_format_version": 1, "pseudonym": "0a1b2c3d-0000-4000-8000-000000000001", "tmdb_id": 5, "season": 1, "episode": 2, "fingerprint_b64": "AQI=", "fingerprint_sha256_b64": "AQI=",
        "disc_content_hash_b64": None, "match_confidence": 0.9, "match_source": "engram_asr", "client_version": "1",
    }
    return r | change


def test_validation_names_the_field(spark):
    cases = [({}, None), ({"wire_format_version": 2}, "wire_format_version"), ({"pseudonym": "x"}, "pseudonym"), ({"tmdb_id": 0}, "tmdb_id"), ({"season": -1}, "season"), ({"fingerprint_b64": "YW!!Jj"}, "fingerprint_b64"),
             ({"match_confidence": 1.1}, "match_confidence"), ({"match_source": "guess"}, "match_source"), ({"client_version": ""}, "client_version"), ({"season": None, "episode": None}, None), ({"disc_content_hash_b64": "YQ=\n"}, "disc_content_hash_b64")]
    df = spark.createDataFrame([tuple(request(**c).values()) for c, _ in cases], S.CONTRIBUTION_REQUEST)
    assert [r[0] for r in df.select(intake.contribution_reason()).collect()] == [w for _, w in cases]


def test_disc_validation(spark):
    good = (0, 1, 1, "episode", 1, 1, 0.9, "engram_asr")
    cases = [([good], None), ([], "titles"), ([good[:4] + (None, 1) + good[6:]], "title"), ([good[:3] + ("main_movie",) + good[4:]], "title"), ([good] * 501, "titles"), ([good[:3] + ("extra", None, 3) + good[6:]], None)]
    rows = [(1, request()["pseudonym"], "A" * 24, 5, "tv", 1, t, "1") for t, _ in cases]
    assert [r[0] for r in spark.createDataFrame(rows, S.DISC_REQUEST).select(intake.disc_reason()).collect()] == [w for _, w in cases]


def test_deduplication_is_null_safe_and_within_the_batch(spark):
    kind = "id long, k string, season int"
    history = spark.createDataFrame([(1, "a", None)], kind)
    incoming = spark.createDataFrame([(5, "a", None), (6, "b", None), (7, "b", None), (8, "b", 1)], kind)
    new, repeats = intake.deduplicate(incoming, history, ["k", "season"], ["id"])
    assert sorted(r.id for r in new.collect()) == [6, 8]
    assert sorted((r.id, r.existing_id) for r in repeats.collect()) == [(5, 1), (7, 6)]


def test_fourth_conflict_flags_for_good(spark):
    rows = [("a", t, "flag_conflict") for t in range(3)] + [("b", t, "flag_conflict") for t in range(4)]
    first = intake.roll_up(None, spark.createDataFrame(rows, "pseudonym string, received_at long, poison_check string"))
    assert {r.pseudonym: (r.flagged, r.flag_count) for r in first.collect()} == {"a": (0, 3), "b": (1, 4)}
    later = intake.roll_up(first, spark.createDataFrame([("a", 9, "flag_conflict"), ("b", 9, "pass")], "pseudonym string, received_at long, poison_check string"))
    assert {r.pseudonym: (r.flagged, r.contribution_count) for r in later.collect()} == {"a": (1, 4), "b": (1, 5)}


def test_forget_and_cascade(spark):
    t = {
        "contribution": spark.createDataFrame([(1, "a"), (2, "b")], "id long, pseudonym string"), "contributor": spark.createDataFrame([("a",), ("b",)], "pseudonym string"),
        "disc_contribution": spark.createDataFrame([("a",)], "pseudonym string"), "overlap_observation": spark.createDataFrame([(1,), (2,)], "contribution_id long"),
    }
    out = catalog.forget(t, spark.createDataFrame([("a",)], "pseudonym string"))
    assert {k: v.count() for k, v in out.items()} == {"contribution": 1, "contributor": 1, "disc_contribution": 0, "overlap_observation": 1}


def test_retraction_outcomes(spark):
    kind = "pseudonym string, tmdb_id long, season int, episode int, sha string"
    before = spark.createDataFrame([("a", 1, 1, 1, "x"), ("b", 1, 1, 1, "x"), ("a", 2, None, None, "x")], kind)
    asked = spark.createDataFrame([("a", 1, 1, 1, "x"), ("a", 2, None, None, "x"), ("c", 1, 1, 1, "x")], kind)
    after = catalog.retract(before, asked, kind.replace(" string", "").replace(" long", "").replace(" int", "").split(", "))
    assert {(r.tmdb_id, r.outcome, r.remaining) for r in catalog.retraction_outcome(before, after).collect()} == {(1, "re_derived", 1), (2, "removed", 0)}


def test_seed_changes_only_its_columns(spark):
    kind = "k long, tier string, n int"
    out = catalog.seed(spark.createDataFrame([(1, "a", 5), (2, "b", 6)], kind), spark.createDataFrame([(2, "c", 0), (3, "d", 0)], kind), ["k"], ["tier"])
    assert sorted(map(tuple, out.collect())) == [(1, "a", 5), (2, "c", 6), (3, "d", 0)]


def test_disc_job(spark, tmp_path):
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat")
    jobs.disc_batch(c, spark.createDataFrame([disc(1, "a"), disc(2, "b"), disc(3, "a")], DISC), 10)
    assert c.read("disc_contribution").count() == 2 and {r.promoted_at for r in c.read("disc_contribution").collect()} == {10}
    assert [(r.tier, r.unique_contributors) for r in c.read("disc_canonical").collect()] == [("confirmed", 2)]
    jobs.disc_batch(c, spark.createDataFrame([disc(4, "c"), disc(5, "a")], DISC), 20)
    assert c.read("disc_contribution").count() == 3
    assert [(r.tier, r.unique_contributors, r.promoted_at) for r in c.read("disc_canonical").collect()] == [("canonical", 3, 20)]


def test_table_sort_and_sparkline(spark):
    df = spark.createDataFrame([("b", 2), ("A", 10), (None, None), ("c", 1)], "s string, n int")
    assert [r.s for r in analytics.table_sort(df, "s").collect()] == ["A", "b", "c", None]
    assert [r.n for r in analytics.table_sort(df, "n", True).collect()] == [10, 2, 1, None]
    one = spark.createDataFrame([("2024-01-01", 5)], "day string, n long")
    two = one.union(spark.createDataFrame([("2024-01-02", 2)], "day string, n long"))
    assert analytics.sparkline(one).count() == 0 and [r.total for r in analytics.sparkline(two).orderBy("day").collect()] == [5, 7]


def test_packs(spark, tmp_path):
    rows = [(7, 1, 2, "canonical", [2, 3, 4]), (7, 1, 1, "canonical", [1, 2, 3]), (7, 1, 3, "confirmed", [9]), (8, 1, 1, "candidate", [1])]
    df = spark.createDataFrame(rows, "tmdb_id long, season int, episode int, tier string, hashes array<bigint>")
    packs.write_packs(df, f"{tmp_path}/packs", 5)
    lines = [json.loads(x) for x in packs.read_pack(spark, f"{tmp_path}/packs", 7)]
    assert lines[0] == {"wire_format_version": 1, "pack_format_version": 2, "tmdb_id": 7, "n_episodes": 2, "generated_at": 5}
    assert [x["episode"] for x in lines[1:3]] == [1, 2] and dict(map(tuple, lines[3]["df"])) == {1: 1, 2: 2, 3: 2, 4: 1}
    assert packs.read_pack(spark, f"{tmp_path}/packs", 8) is None


def test_a_large_pack_is_many_frames(spark, tmp_path):
    import zstandard

    rows = [(7, 1, e, "canonical", list(range(e, e + 3000))) for e in range(1, 40)] + [(8, 1, 1, "canonical", [5]), (9, 1, 1, "canonical", [])]
    df = spark.createDataFrame(rows, "tmdb_id long, season int, episode int, tier string, hashes array<bigint>").repartition(4)
    packs.write_packs(df, f"{tmp_path}/packs", 5, frame_bytes=4096)
    frames = list(packs.pack_stream(spark, f"{tmp_path}/packs", 7))
    texts = [zstandard.ZstdDecompressor().decompressobj().decompress(f) for f in frames]
    assert len(frames) > 10 and max(len(t) for t in texts) < 4096 + 20_000  # a frame ends with the piece that fills it
    lines = [json.loads(x) for x in b"".join(texts).decode().split("\n")]
    assert lines == [json.loads(x) for x in packs.read_pack(spark, f"{tmp_path}/packs", 7)] and len(lines) == 41
    assert [x["episode"] for x in lines[1:40]] == list(range(1, 40)) and lines[0]["n_episodes"] == lines[40]["n_episodes"] == 39
    want = {}
    for *_, hashes in rows[:39]:
        for h in hashes:
            want[h] = want.get(h, 0) + 1
    assert [tuple(x) for x in lines[40]["df"]] == sorted(want.items())
    assert json.loads(packs.read_pack(spark, f"{tmp_path}/packs", 8)[2])["df"] == [[5, 1]] and json.loads(packs.read_pack(spark, f"{tmp_path}/packs", 9)[2])["df"] == []


def test_labels(spark):
    row = spark.range(1).select(
        fn.episode_label(F.lit(1), F.lit(2)), fn.episode_label(F.lit(None).cast("int"), F.lit(2)), fn.relative_time(F.lit(100), F.lit(190)), fn.relative_time(F.lit(0), F.lit(1)),
        fn.escape_html(F.lit("<a&'\">")), fn.strict_base64(F.lit("YW!!Jj")), fn.base64url(F.lit("-_8")), fn.exact_overlap(F.array(F.lit(1), F.lit(1), F.lit(2)), F.array(F.lit(1))),
    ).first()
    assert tuple(row) == ("S01E02", "—", "1m ago", "—", "&lt;a&amp;&#39;&quot;&gt;", None, bytearray(b"\xfb\xff"), pytest.approx(2 / 3))


def test_series_fall_back_to_all_days(spark):
    s = spark.createDataFrame([("2024-01-01", 2), ("2024-01-03", 1)], "day string, n long")
    assert [tuple(r) for r in analytics.growth({"x": s}, since="2024-01-02").collect()] == [("2024-01-03", 3)]
    assert analytics.growth({"x": s}, since="2025-01-01").count() == 2
    assert analytics.trailing_sum(s, "2024-01-03", 1).first().n == 1


def test_streaming_intake_is_idempotent(spark, tmp_path):
    who = [f"0a1b2c3d-0000-4000-8000-00000000000{i}" for i in range(3)]
    fp = __import__("base64").b64encode(sketch.encode(np.array([1, 2, 3]))).decode()
    good = [request(pseudonym=w, fingerprint_b64=fp, disc_content_hash_b64=None) for w in who]
    (tmp_path / "in").mkdir()
    text = "\n".join(json.dumps(r) for r in [*good, request(tmdb_id=0), request(fingerprint_b64="AQID")])
    (tmp_path / "in/1.json").write_text(text)
    root = f"file://{tmp_path}/cat"
    jobs.start_intake(spark, f"{tmp_path}/in", root, f"{tmp_path}/check", 100).awaitTermination()
    c = versioned.Catalog(spark, root)
    assert c.read("contribution").count() == 3 and c.read("quarantine").count() == 2
    jobs.promote_batch(c, 150)
    assert [(r.tier, r.unique_contributors) for r in c.read("episode_canonical").collect()] == [("canonical", 3)]
    (tmp_path / "in/2.json").write_text(text)
    jobs.start_intake(spark, f"{tmp_path}/in", root, f"{tmp_path}/check", 200).awaitTermination()
    assert c.read("contribution").count() == 3 and c.version() == 3


def test_windowed_rate_stream(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e/1.json").write_text("\n".join(json.dumps({"pseudonym": "a", "ts": f"2024-01-01T00:00:{i:02d}Z"}) for i in range(5)))
    events = spark.readStream.schema("pseudonym string, ts timestamp").json(f"{tmp_path}/e")
    q = jobs.intake_rate(events).writeStream.outputMode("complete").format("memory").queryName("rate").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("rate").collect()] == [5]


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"episodes": [{"tmdb_id": 1, "season": 1, "episode": 2, "hashes": [1, 2]}]}))
    assert [tuple(r) for r in adapters.read_seed_json(spark, f"{tmp_path}/s.json").collect()] == [(1, 1, 2, [1, 2])]
    (tmp_path / "c.json").write_text(json.dumps(request()) + "\n{broken\n")
    assert adapters.read_contribution_json(spark, f"{tmp_path}/c.json").filter(intake.contribution_reason().isNull()).count() == 1


def test_the_consensus_shuffles_no_fingerprints(spark):
    hashes = F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda i: F.pmod(F.xxhash64(i), F.lit(1 << 32)).cast("long"))
    votes = spark.range(0, 41, 1, 4).select("id", F.when(F.col("id") == 40, 8).otherwise(7).cast("long").alias("tmdb_id"), F.lit(1).alias("season"), F.lit(1).alias("episode"), hashes.alias("hashes"))
    written = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    out = {r.tmdb_id: r.hashes for r in consensus.consensus_canonical(votes).collect()}
    assert written() - before < 1_500_000  # 41 fingerprints of 80 KB would be more
    assert out[7] == sorted(out[8]) and out[8] != out[7] and len(set(out[7])) == len(out[7])


def test_round_trips_are_those_of_the_columns_functions(spark, monkeypatch):
    """Nulls, empty ones and many slices; one Arrow function, which no fingerprint leaves, as two held some copies of each batch."""
    monkeypatch.setattr(sketch, "ROUND_TRIPS", 3)
    rows = [(0, None), (1, []), (2, [4294967295, 0, 5])] + [(i, [i * 7919 * j % 2**32 for j in range(i)]) for i in range(3, 20)]
    df = spark.createDataFrame(rows, "k long, hashes array<long>").coalesce(1)
    out = sketch.round_trips(df, ["k"])
    blob = sketch.encode_fingerprint("hashes")
    want = df.select("k", F.size("hashes").alias("n"), F.length(blob).alias("bytes"), sketch.decode_fingerprint(blob).eqNullSafe(F.col("hashes")).alias("same"))
    assert out.columns == want.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and all(r.same for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
