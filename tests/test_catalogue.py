"""The versioned catalogue and the jobs over it: what is written, read and kept, replays, erasure, limits, deltas."""

import base64
import json
import os
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_operators import DISC, VOTE, disc, request, vote

from echoquorum import schema as S
from echoquorum.functions import sketch
from echoquorum.operators import consensus, deltas, intake, packs, versioned
from echoquorum.streaming import jobs

E = S.EPISODE
WHO = [f"0a1b2c3d-0000-4000-8000-00000000000{i}" for i in range(10)]


def b64(raw):
    return base64.b64encode(raw).decode()


def ask(who, tmdb, hashes, episode=1, n=0, **change):
    """A contribution request of contributor number ``who``."""
    return request(pseudonym=WHO[who], tmdb_id=tmdb, season=1, episode=episode, fingerprint_b64=b64(sketch.encode(np.array(hashes))), fingerprint_sha256_b64=b64(bytes([who, n]) * 16), disc_content_hash_b64=None, **change)


def feed(spark, rows):
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", S.CONTRIBUTION_REQUEST).alias("r")).select("r.*")


def gone(spark, rows):
    """Retractions (contributor, show, episode, n) as ``intake.UNIQUE`` has them."""
    kind = "pseudonym string, tmdb_id long, season int, episode int, fingerprint_sha256 binary"
    return spark.createDataFrame([(WHO[w], t, 1, e, bytes([w, n]) * 16) for w, t, e, n in rows], kind)


def on_disk(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith((".parquet", ".json"))}


def test_jobs_from_intake_to_retraction(spark, tmp_path):
    who = [f"0a1b2c3d-0000-4000-8000-00000000000{i}" for i in range(5)]
    b64 = lambda raw: __import__("base64").b64encode(raw).decode()
    own, other = list(range(1, 400)), list(range(5000, 5400))
    sha = lambda w: b64(bytes([w]) * 32)
    ask = lambda w, tmdb, hashes: request(pseudonym=who[w], tmdb_id=tmdb, season=1, episode=1, fingerprint_b64=b64(sketch.encode(np.array(hashes))), fingerprint_sha256_b64=sha(w), disc_content_hash_b64=None)
    feed = lambda rows: spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", S.CONTRIBUTION_REQUEST).alias("r")).select("r.*")
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat")
    jobs.intake_batch(c, feed([ask(0, 7, own), ask(1, 7, own), ask(2, 7, own[:390])]), 100)
    assert [r.poison_check for r in c.read("contribution").collect()] == ["pass"] * 3 and c.read("overlap_observation").count() == 3
    jobs.promote_batch(c, 150)
    assert [(r.tmdb_id, r.tier, r.unique_contributors) for r in c.read("episode_canonical").collect()] == [(7, "canonical", 3)]
    assert {r.promoted_at for r in c.read("contribution").collect()} == {150}
    assert [tuple(r) for r in jobs.sketch_batch(c, 160).collect()] == [(7, 1, 1, 399)] and jobs.sketch_batch(c, 170).count() == 0
    assert jobs.sketch_batch(c, 180, every=True).count() == 1
    blob = bytes(c.read("episode_canonical").first().fingerprint)
    assert jobs.hex_fingerprints(c.read("episode_canonical")).first().fingerprint_hex == blob.hex().upper()
    # The fingerprint of show 7, handed in as show 9, is a conflict; another fingerprint isn't.
    jobs.intake_batch(c, feed([ask(3, 9, own), ask(4, 9, other), ask(0, 7, own)]), 200)
    late = {r.pseudonym: r for r in c.read("contribution").filter("received_at = 200").collect()}
    assert {w: r.poison_check for w, r in late.items()} == {who[3]: "flag_conflict", who[4]: "pass"}
    seen = {r.contribution_id: r for r in c.read("overlap_observation").collect()}
    assert len(seen) == 5 and seen[late[who[3]].id].target_tmdb_id == 7 and seen[late[who[3]].id].max_overlap_pct == 1.0 and seen[late[who[3]].id].candidates_checked == 1
    assert {r.pseudonym: r.flag_count for r in c.read("contributor").collect()}[who[3]] == 1
    jobs.promote_batch(c, 250)
    jobs.sketch_batch(c, 260)
    assert sorted((r.tmdb_id, r.tier) for r in c.read("episode_canonical").collect()) == [(7, "canonical"), (9, "candidate")]
    jobs.pack_batch(c, f"file://{tmp_path}/packs", 300)
    state, lines = packs.answer(spark, f"{tmp_path}/packs", 7)
    tag = packs.pack_tag(spark, f"{tmp_path}/packs", 7)
    assert state == "ok" and len(lines) == 3 and packs.answer(spark, f"{tmp_path}/packs", 7, tag) == ("not_modified", None) and packs.answer(spark, f"{tmp_path}/packs", 9) == ("missing", None)
    rows = [(who[0], 7, 1, 1, bytes([0]) * 32), (who[4], 9, 1, 1, bytes([4]) * 32), (who[3], 9, 1, 1, bytes([3]) * 32), (who[1], 8, 1, 1, bytes(32))]
    gone = spark.createDataFrame(rows, "pseudonym string, tmdb_id long, season int, episode int, fingerprint_sha256 binary")
    told = {(r.pseudonym, r.tmdb_id): (r.outcome, r.deleted, r.remaining) for r in jobs.retract_batch(c, gone, 400).collect()}
    assert told == {(who[0], 7): ("re_derived", 1, 2), (who[4], 9): ("removed", 1, 0), (who[3], 9): ("removed", 1, 0), (who[1], 8): ("untouched", 0, 0)}
    assert [(r.tmdb_id, r.tier, r.unique_contributors) for r in c.read("episode_canonical").collect()] == [(7, "confirmed", 2)]
    assert [(r.tmdb_id, r.generated_at) for r in c.read("canonical_sketch").collect()] == [(7, 260 - 80)] and c.read("overlap_observation").count() == 2
    jobs.seed_batch(c, spark.createDataFrame([(7, 1, 1, [1, 2]), (70, 1, 1, [3])], S.SEED), 500)
    assert sorted((r.tmdb_id, r.tier) for r in c.read("episode_canonical").collect()) == [(7, "confirmed"), (70, "canonical")] and c.read("canonical_sketch").count() == 2


def test_versions(spark, tmp_path):
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat")
    assert c.version() == 0 and c.tables() == []
    c.commit({"a": spark.range(3), "b": spark.range(1)})
    c.commit({"a": spark.range(5)})
    assert c.version() == 2 and c.read("a").count() == 5 and c.read("b").count() == 1
    assert c.files("b", 1) == c.files("b", 2) and c.read("a", 1).count() == 3  # not written again; the old version stays
    # A run that ends between writing its tables and the manifest leaves the version before.
    c.write({"a": spark.range(9)})
    assert c.version() == 2 and c.read("a").count() == 5
    c.commit(added={"a": spark.range(2)})
    assert c.version() == 3 and c.read("a").count() == 7
    with pytest.raises(RuntimeError):  # a second writer that began at version 2
        c.commit({"a": spark.range(1)}, after=2)
    assert c.version() == 3 and c.read("a").count() == 7
    c.commit({"empty": spark.range(0)})
    assert c.read("empty").count() == 0 and c.read("empty").columns == ["id"]
    # Versions that are forgotten take along what only they name, and what no version ever named.
    before = len(on_disk(tmp_path))
    c.expire(keep=1)
    assert c.versions() == [4] and c.sweep() >= 2 and len(on_disk(tmp_path)) < before
    assert c.read("a").count() == 7 and c.read("b").count() == 1 and c.sweep() == 0


def test_a_lookup_reads_its_buckets_and_a_change_writes_its_files(spark, tmp_path):
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat", buckets=32)
    rows = spark.range(4000).select((F.col("id") % 200).alias("tmdb_id"), F.lit(1).alias("season"), F.when(F.col("id") % 7 > 0, 1).alias("episode"), F.col("id"), F.lit("x" * 50).alias("pad"))
    c.commit({"episode_canonical": rows})
    files = c.files("episode_canonical")
    assert len({b for _, b, _ in files}) == 32
    every = [tuple(r) for r in rows.collect()]
    for key in ((5, 1, 1), (5, 1, None)):
        found = c.lookup("episode_canonical", spark.createDataFrame([key], "tmdb_id int, season long, episode int"))  # of other types than the table's
        assert {tuple(r) for r in found.collect()} == {r for r in every if r[:3] == key} != set()
        assert len(found.inputFiles()) <= -(-len(files) // 32) + 1 < len(files) / 8
    # Three episodes are changed: at most three buckets' files are written, the others stay where they are.
    touched = spark.createDataFrame([(5, 1, 1), (77, 1, 1), (150, 1, 1)], "tmdb_id long, season int, episode int")
    paths, part = c.parts("episode_canonical", touched)
    assert 0 < len(paths) <= 3
    new = part.withColumn("pad", F.lit("y"))
    c.commit(replaced={"episode_canonical": (paths, new)})
    left = c.files("episode_canonical")
    assert len(set(files) - set(left)) == len(paths) and len(set(left) & set(files)) == len(files) - len(paths)
    assert sum(f[2] for f in set(left) - set(files)) < sum(f[2] for f in files) / 8
    assert c.read("episode_canonical").count() == 4000


def test_stamps_are_written_in_proportion(spark, tmp_path):
    """A promotion of few episodes writes the files that hold them, and stamps what ``consensus.promote`` does."""
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat")
    blob = sketch.encode(np.arange(300))
    rows = [(*vote(i, f"p{i % 50}", at=1000 + i, episode=(i % 400, 1, 1)), bytearray(blob)) for i in range(4000)]
    kind = VOTE + ", fingerprint binary"
    votes = spark.createDataFrame(rows, kind)
    c.commit({"contribution": votes, "contributor": spark.createDataFrame([(f"p{i}", 0) for i in range(50)], "pseudonym string, flagged int")})
    size = sum(f[2] for f in c.files("contribution"))
    before = set(c.files("contribution"))
    jobs.promote_batch(c, 9000, limit=2)
    written = set(c.files("contribution")) - before
    assert 0 < sum(f[2] for f in written) < size / 10
    want = consensus.promote(votes, 9000, 2)
    assert sorted((r.id, r.promoted_at or 0) for r in c.read("contribution").collect()) == sorted((r.id, r.promoted_at or 0) for r in want.collect())
    assert c.read("contribution").filter("promoted_at = 9000").count() == 20
    # A retraction writes the files that hold its episode.
    sha = F.col("id").cast("string").cast("binary")
    asked = votes.filter("id = 77").withColumn("fingerprint_sha256", sha)
    c.commit({"contribution": c.read("contribution").withColumn("fingerprint_sha256", sha)})
    size, before = sum(f[2] for f in c.files("contribution")), set(c.files("contribution"))
    assert [r.outcome for r in jobs.retract_batch(c, asked.select(*intake.UNIQUE), 9500).collect()] == ["re_derived"]
    assert 0 < sum(f[2] for f in set(c.files("contribution")) - before) < size / 10 and c.read("contribution").count() == 3999


def test_compaction_keeps_files_few(spark, tmp_path):
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat", buckets=2, fanout=4, unit=2000)
    for k in range(40):
        c.commit(added={"contributor": spark.range(k * 10, k * 10 + 10).select(F.col("id").cast("string").alias("pseudonym"), F.sha2(F.col("id").cast("string"), 512).alias("x"))})
        c.compact()
    files = c.files("contributor")
    assert len(files) <= 2 * 3 * 4 and c.read("contributor").count() == 400 == c.read("contributor").distinct().count()
    c.expire()
    c.sweep()
    assert len([f for f in on_disk(tmp_path) if f.endswith(".parquet")]) == len(files)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat")
    rows = feed(spark, [ask(0, 7, [1, 2, 3]), ask(1, 7, [1, 2]), ask(2, 0, [1])])
    jobs.intake_batch(c, rows, 100, done=("s", 0), host="a.example")
    state = {n: sorted(map(str, c.read(n).collect())) for n in c.tables()}
    assert c.read("quarantine").count() == 1 and c.read("contribution").count() == 2
    for number in (0, 0):
        jobs.intake_batch(c, rows, 900, done=("s", number))
    assert c.version() == 1 and {n: sorted(map(str, c.read(n).collect())) for n in c.tables()} == state
    jobs.intake_batch(c, rows, 100, done=("other", 0))  # another stream's batch counts for itself
    assert c.version() == 2 and c.read("quarantine").count() == 2 and c.read("contribution").count() == 2
    discs = spark.createDataFrame([disc(1, "a")], DISC)
    jobs.disc_batch(c, discs, 10, done=("d", 3))
    jobs.disc_batch(c, discs, 10, done=("d", 3))
    assert c.version() == 3
    assert {r.ingress_host for r in c.read("contribution").collect()} == {"a.example"}


def test_retraction_keeps_what_the_rules_keep(spark, tmp_path, monkeypatch):
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat")
    good, weak = [ask(0, 7, [1, 2, 3]), ask(1, 8, [5, 6]), ask(2, 8, [5, 6]), ask(3, 9, [8]), ask(4, 9, [8, 9])], [ask(5, 7, [1, 2], match_confidence=0.1)]
    jobs.intake_batch(c, feed(spark, good + weak), 100)
    jobs.promote_batch(c, 150)
    jobs.sketch_batch(c, 160)
    c.commit({"contributor": c.read("contributor").withColumn("flagged", F.when(F.col("pseudonym") == WHO[2], 1).otherwise(0))})
    assert {(r.tmdb_id, r.tier) for r in c.read("episode_canonical").collect()} == {(7, "candidate"), (8, "confirmed"), (9, "confirmed")}
    # Show 7 has an ineligible vote left, show 8 a flagged contributor's alone, show 9 an eligible one, show 99 never had a row.
    told = {r.tmdb_id: (r.outcome, r.deleted, r.remaining) for r in jobs.retract_batch(c, gone(spark, [(0, 7, 1, 0), (1, 8, 1, 0), (3, 9, 1, 0), (0, 99, 1, 0)]), 400).collect()}
    assert told == {7: ("kept", 1, 1), 8: ("kept", 1, 1), 9: ("re_derived", 1, 1), 99: ("untouched", 0, 0)}
    rows = {r.tmdb_id: (r.tier, r.unique_contributors, r.promoted_at) for r in c.read("episode_canonical").collect()}
    assert rows == {7: ("candidate", 1, 150), 8: ("confirmed", 2, 150), 9: ("candidate", 1, 400)}
    assert c.read("canonical_sketch").count() == 3 and c.read("contribution").count() == 3
    # A derivation that fails doesn't undo the deletion, and the next promotion makes up for it.
    def broken(*_):
        raise PySparkException("broken")

    jobs.intake_batch(c, feed(spark, [ask(6, 9, [8, 9, 10])]), 500)
    with monkeypatch.context() as m:
        m.setattr(jobs, "_derived", broken)
        assert [r.outcome for r in jobs.retract_batch(c, gone(spark, [(6, 9, 1, 0)]), 600).collect()] == ["re_derive_failed"]
    assert c.read("contribution").filter("tmdb_id = 9").count() == 1
    jobs.promote_batch(c, 700)
    assert {r.tmdb_id: (r.tier, r.promoted_at) for r in c.read("episode_canonical").collect()}[9] == ("candidate", 700)
    # Without any row left the canonical row and the sketch go.
    assert [r.outcome for r in jobs.retract_batch(c, gone(spark, [(4, 9, 1, 0)]), 800).collect()] == ["removed"]
    assert sorted(r.tmdb_id for r in c.read("episode_canonical").collect()) == [7, 8] == sorted(r.tmdb_id for r in c.read("canonical_sketch").collect())


def test_erased_contributors_are_nowhere_on_disk(spark, tmp_path):
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat")
    text = json.dumps(ask(1, 0, [1]))[:-1] + " broken " + WHO[1]
    lines = spark.createDataFrame([(text,)], f"{S.UNREADABLE} string")
    jobs.intake_batch(c, feed(spark, [ask(0, 7, [1, 2]), ask(1, 7, [1, 2, 3]), ask(1, 8, [4]), ask(1, 0, [1])]).unionByName(lines, allowMissingColumns=True), 100)
    jobs.disc_batch(c, spark.createDataFrame([disc(1, WHO[0]), disc(2, WHO[1])], DISC), 120)
    jobs.promote_batch(c, 150)
    jobs.sketch_batch(c, 160)
    jobs.intake_batch(c, feed(spark, [ask(0, 8, [4])]), 200)
    canonical = sorted(map(str, c.read("episode_canonical").collect()))

    def named():
        return {t for t in c.tables() for r in c.read(t).collect() if WHO[1] in str(r)} | {f for f in on_disk(tmp_path) if f.endswith(".parquet") and WHO[1] in str(spark.read.parquet(f"file://{f}").collect())}

    assert {"contribution", "disc_contribution", "contributor", "quarantine"} <= named() and len(named()) > 8
    told = jobs.forget_batch(c, spark.createDataFrame([(WHO[1],), ("nobody",)], "pseudonym string"))
    assert told == {"contribution": 2, "disc_contribution": 1, "contributor": 1, "rows_deleted": 4}
    assert named() == set() and c.versions() == [c.version()]
    assert sorted(map(str, c.read("episode_canonical").collect())) == canonical and c.read("disc_canonical").count() == 1
    assert c.read("contribution").count() == 2 == c.read("overlap_observation").count() and c.read("quarantine").count() == 0
    # The state counts the votes that are left: what is derived next doesn't know the erased ones.
    jobs.promote_batch(c, 300)
    state = {(r.tmdb_id, r.h): r.votes for r in c.read("consensus_state").collect()}
    assert state == {(7, -1): 1, (7, 1): 1, (7, 2): 1, (8, -1): 1, (8, 4): 1}


def test_state_of_deltas_equals_counting_all_votes(spark, tmp_path):
    r = random.Random(8)
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat", buckets=1)  # files that have several episodes
    for step in range(6):
        at = 1000 * (step + 1) if step != 3 else 10  # late votes, most of which replace none: episodes touched but not changed
        if step in (2, 5):
            rows = c.read("contribution").collect()
            picked = r.sample(rows, min(3, len(rows)))
            asked = spark.createDataFrame([tuple(x[k] for k in intake.UNIQUE) for x in picked], "pseudonym string, tmdb_id long, season int, episode int, fingerprint_sha256 binary")
            jobs.retract_batch(c, asked, at + 1)
        else:
            jobs.intake_batch(c, feed(spark, [ask(r.randrange(4), r.randrange(1, 4), r.choices(range(12), k=r.randrange(1, 8)), n=r.randrange(200)) for _ in range(8)]), at)
        jobs.promote_batch(c, at + 5)
        votes = consensus.latest_votes(c.read("contribution")).withColumn("hashes", sketch.decode_fingerprint("fingerprint"))
        want = {tuple(x[k] for k in E): list(x.hashes) for x in consensus.consensus_canonical(votes).collect()}
        got = {tuple(x[k] for k in E): list(x.hashes) for x in deltas.consensus(c.read("consensus_state"), votes).collect()}
        assert got == want and want
        stored = {tuple(x[k] for k in E): list(x.hashes) for x in c.read("episode_canonical").select(*E, sketch.decode_fingerprint("fingerprint").alias("hashes")).collect()}
        assert {k: stored.get(k) for k in want} == want


def test_regeneration_is_dry_until_it_is_applied(spark, tmp_path):
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat")
    jobs.intake_batch(c, feed(spark, [ask(0, t, list(range(t, t + 20))) for t in (1, 2, 3)]), 100)
    jobs.promote_batch(c, 150)
    jobs.sketch_batch(c, 160)
    old = c.read("canonical_sketch")
    bad = old.filter("tmdb_id <> 2").withColumn("sketch", F.when(F.col("tmdb_id") == 3, F.lit(bytearray(512))).otherwise(F.col("sketch")))
    c.commit({"canonical_sketch": bad.unionByName(old.filter("tmdb_id = 2").withColumn("tmdb_id", F.lit(9).cast("long")))})
    version = c.version()
    want = {(1, "equal"), (2, "missing"), (3, "changed"), (9, "orphaned")}
    assert {(r.tmdb_id, r.state) for r in jobs.regenerate_sketches(c, 500).collect()} == want and c.version() == version
    assert {(r.tmdb_id, r.state) for r in jobs.regenerate_sketches(c, 500, apply=True).collect()} == want
    assert {(r.tmdb_id, r.state) for r in jobs.regenerate_sketches(c, 600).collect()} == {(1, "equal"), (2, "equal"), (3, "equal"), (9, "orphaned")}
    assert {r.tmdb_id: r.generated_at for r in c.read("canonical_sketch").collect()} == {1: 160, 2: 500, 3: 500, 9: 160}


def test_every_line_is_accounted_for(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps(ask(0, 7, [1, 2])), json.dumps(ask(0, 7, [1, 2])), json.dumps(ask(1, 0, [1])), "{broken", json.dumps(ask(2, 7, [3]) | {"tmdb_id": "seven"}), "[1, 2]", json.dumps(ask(3, 7, [5]) | {"fingerprint_b64": "AQID"})]
    (tmp_path / "in/1.json").write_text("\n".join(lines))
    jobs.start_intake(spark, f"{tmp_path}/in", f"file://{tmp_path}/cat", f"{tmp_path}/check", 100, host="h").awaitTermination()
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat")
    kept = {(r.reason, r.raw if r.reason == "unreadable" else "") for r in c.read("quarantine").collect()}
    assert kept == {("tmdb_id", ""), ("unreadable", "{broken"), ("unreadable", lines[4]), ("unreadable", "[1, 2]"), ("fingerprint", "")}
    assert c.read("contribution").count() == 1 and len(lines) == 1 + 1 + c.read("quarantine").count()
    assert all(r.raw for r in c.read("quarantine").collect())
    # Disc requests, too, from their lines to rows and consensus.
    title = {"title_index": 0, "duration_seconds": 10, "size_bytes": 10, "assignment": "episode", "season": 1, "episode": 1, "match_confidence": 0.9, "match_source": "engram_asr"}
    whole = {"wire_format_version": 1, "disc_content_hash_b64": b64(bytes(range(20))), "tmdb_id": 5, "content_type": "tv", "season": 1, "titles": [title], "client_version": "1"}
    discs = [json.dumps(whole | {"pseudonym": w}) for w in (WHO[0], WHO[0], WHO[1])] + ["nonsense", json.dumps(whole | {"pseudonym": WHO[2], "titles": []})]
    (tmp_path / "discs").mkdir()
    (tmp_path / "discs/1.json").write_text("\n".join(discs))
    jobs.start_disc_intake(spark, f"{tmp_path}/discs", f"file://{tmp_path}/cat", f"{tmp_path}/check2", 100).awaitTermination()
    assert c.read("disc_contribution").count() == 2 and {r.reason for r in c.read("quarantine").filter("tmdb_id IS NULL OR tmdb_id = 5").collect()} >= {"unreadable", "titles"}
    assert [(r.disc_content_hash, r.tier, r.unique_contributors) for r in c.read("disc_canonical").collect()] == [(bytes(range(20)).hex(), "confirmed", 2)]


def test_requests_beyond_the_limit_are_refused_across_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, rows, at):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(tmp_path / f"in/{name}.json", (at, at))

    base = 1_700_000_040  # the first second of a window
    put("a", [ask(0, 7, [1], n=k) for k in range(4)], base + 1)
    put("b", [ask(0, 7, [1], n=k) for k in range(4, 7)] + [ask(1, 7, [2]), ask(0, 0, [1])], base + 20)
    put("c", [ask(0, 7, [1], n=7)], base + 61)  # the next window
    put("d", [ask(2, 7, [3])], base + 10_000)  # the watermark passes both
    put("e", [ask(2, 7, [3], n=1)], base + 20_000)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        q = jobs.start_intake(spark, f"{tmp_path}/in", f"file://{tmp_path}/cat", f"{tmp_path}/check", 100, max_files=1, limit=5)
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    c = versioned.Catalog(spark, f"file://{tmp_path}/cat")
    reasons = sorted(r.reason for r in c.read("quarantine").collect())
    assert reasons == ["rate_limited", "rate_limited", "tmdb_id"]
    assert sorted(r.pseudonym[-1] for r in c.read("contribution").collect()) == ["0"] * 6 + ["1", "2", "2"]
    # Windows that the watermark has passed have no state left.
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 2
