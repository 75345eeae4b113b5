"""Streaming wrappers: the batch operators inside ``foreachBatch`` over JSON files, and the windowed intake count.

State lives in the versioned catalogue, not in a state store: every vote counts whenever it comes, so no watermark
may drop it. Each commit notes the stream and the batch that it took in, so a batch that is run again changes nothing. The
rate limit alone keeps state in Spark's store. Promotion, sketches, packs, retractions and erasures are jobs of their own, run by
whatever schedules them; they write the files that hold a touched row, not whole tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema as S
from ..functions import scalar as fn
from ..functions import sketch
from ..operators import consensus, deltas, identify, intake, packs
from ..operators.catalog import anti, decided, outcomes, retract, seed, semi, sketch_diff, stale_sketches, upsert
from ..operators.versioned import Catalog
from ..sources import adapters

E = S.EPISODE
CONTRIBUTION = ["id", "received_at", "pseudonym", *E, "fingerprint", "fingerprint_sha256", "disc", "match_confidence", "match_source", "client_version", "poison_check", "promoted_at", "ingress_host"]


def _host(requests: DataFrame, host: str | None) -> Column:
    own = F.lit(host).cast("string")
    return F.coalesce("ingress_host", own) if "ingress_host" in requests.columns else own


def to_rows(valid: DataFrame, first_id: int, received_at: int, host: str | None = None) -> DataFrame:
    """Valid requests as contribution rows; ids count on from ``first_id`` in the order of the requests' contents."""
    order = F.sha2(F.concat_ws("|", "pseudonym", F.col("tmdb_id").cast("string"), F.coalesce(F.col("season").cast("string"), F.lit("")), F.coalesce(F.col("episode").cast("string"), F.lit("")), "fingerprint_sha256_b64"), 256)
    ranked = valid.withColumn("o_", order).repartitionByRange("o_").sortWithinPartitions("o_").withColumn("n_", F.monotonically_increasing_id())
    return ranked.select(
        (F.col("n_") + first_id).alias("id"), F.lit(received_at).cast("long").alias("received_at"), "pseudonym", *E,
        fn.strict_base64(F.col("fingerprint_b64")).alias("fingerprint"), fn.strict_base64(F.col("fingerprint_sha256_b64")).alias("fingerprint_sha256"),
        F.hex(F.when(F.length("disc_content_hash_b64") > 0, fn.strict_base64(F.col("disc_content_hash_b64")))).alias("disc"),
        "match_confidence", "match_source", "client_version", F.lit("pass").alias("poison_check"), F.lit(None).cast("long").alias("promoted_at"), _host(valid, host).alias("ingress_host"),
    )


def _there(catalog: Catalog, name: str) -> DataFrame | None:
    return catalog.read(name) if name in catalog.tables() else None


def _known(catalog: Catalog, name: str, keys: DataFrame) -> DataFrame | None:
    """The rows of a table that have one of the keys, read from those keys' buckets only; None without the table."""
    return catalog.lookup(name, keys) if name in catalog.tables() else None


def _upserted(catalog: Catalog, name: str, new: DataFrame, keys: list[str]) -> tuple[list[str], DataFrame]:
    """``new`` over the rows of the table with the same keys, for ``commit``: only the files that hold those are written."""
    if name not in catalog.tables():
        return [], new
    files, rows = catalog.parts(name, new.select(*keys))
    return files, upsert(rows, new, keys)


def _removed(catalog: Catalog, name: str, gone: DataFrame) -> tuple[list[str], DataFrame]:
    """A table without the rows that have one of the keys ``gone``, for ``commit``."""
    files, rows = catalog.parts(name, gone)
    return files, anti(rows, gone, gone.columns)


def canonical_prints(catalog: Catalog) -> DataFrame | None:
    """(keys, hashes, sketch, hash_count) of the stored canonical fingerprints with their stored sketches."""
    canonical, sketches = _there(catalog, "episode_canonical"), _there(catalog, "canonical_sketch")
    if canonical is None or sketches is None:
        return None
    decoded = canonical.select(*E, sketch.decode_fingerprint("fingerprint").alias("hashes")).filter("hashes IS NOT NULL")
    return decoded.join(sketches.select(*E, sketch.unpack_sketch("sketch").alias("sketch"), "hash_count"), E)


def screened_rows(rows: DataFrame, prints: DataFrame | None, asof: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their poison_check, observations): each row (with ``hashes``) against all episodes but the one it claims."""
    if prints is None:
        nothing = rows.select("id", F.lit(0.0).alias("overlap_pct"), F.lit(0).alias("candidates"), *[F.lit(None).cast(t).alias(f"target_{k}") for k, t in zip(E, ("long", "int", "int"))])
        return rows.withColumn("poison_check", F.lit("pass")), intake.observe(nothing, asof)
    judged = identify.screen(rows.select("id", *E, "hashes"), prints)
    every = prints.count()
    own = prints.select(*E).distinct().withColumn("own_", F.lit(1))
    met = rows.select("id", *E).alias("a").join(own.alias("b"), fn.same_episode("a", "b"), "left").select("id", (F.lit(every) - F.coalesce("own_", F.lit(0))).alias("candidates"))
    verdicts = judged.select("id", "poison_check")
    return rows.drop("poison_check").join(verdicts, "id"), intake.observe(judged.join(met, "id"), asof)


def rejected_rows(rejected: DataFrame) -> DataFrame:
    """``quarantine`` rows of rejected requests: who, what, why, and the request's text as it came or as it was read."""
    columns = rejected.columns
    read = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns if c not in (S.UNREADABLE, "reason")]))
    raw = F.coalesce(S.UNREADABLE, read) if S.UNREADABLE in columns else read
    return rejected.select("pseudonym", "tmdb_id", "reason", raw.alias("raw"))


def intake_batch(catalog: Catalog, requests: DataFrame, asof: int, done: tuple[str, int] | None = None, host: str | None = None) -> None:
    """One micro-batch of contributions: validate, quarantine, deduplicate, screen, count, observe; committed together.

    Only the new rows are screened and written; those there are stay where they are, and of the history only the buckets of
    the claimed episodes are read. The batch's rows are written once and read back for all that is made of them. ``done``
    names the (stream, batch): a batch that was committed changes nothing when it is run again. ``host`` is stored as
    the ingress host of requests that bring none. Refused requests (``refused``, of the rate limit) are quarantined as such.
    """
    if done and catalog.done(*done):
        return
    before = catalog.version()
    judged_requests = catalog.staged(intake.judged(requests, intake.contribution_reason()), "requests")
    valid, rejected = judged_requests.filter("reason IS NULL").drop("reason", "refused", S.UNREADABLE), judged_requests.filter("reason IS NOT NULL").drop("refused")
    top = catalog.read("contribution").agg(F.max("id")).first()[0] if "contribution" in catalog.tables() else None
    rows = to_rows(valid, (top or 0) + 1, asof, host).withColumn("hashes", sketch.decode_fingerprint("fingerprint"))
    rows = catalog.staged(rows)
    broken = rows.filter("hashes IS NULL").select("pseudonym", "tmdb_id", F.lit("fingerprint").alias("reason"), F.hex("fingerprint").alias("raw"))
    history = _known(catalog, "contribution", rows.select(*E))
    new, _ = intake.deduplicate(rows.filter("hashes IS NOT NULL"), history, intake.UNIQUE, ["id"])
    judged, observations = screened_rows(new, canonical_prints(catalog), asof)
    judged = catalog.staged(judged.select(*CONTRIBUTION), "judged")
    replaced = {"contributor": _people(catalog, judged)}
    quarantine = rejected_rows(rejected).unionByName(broken)
    catalog.commit(after=before, added={"contribution": judged, "overlap_observation": observations, "quarantine": quarantine}, replaced=replaced, done=done)


def _people(catalog: Catalog, added: DataFrame) -> tuple[list[str], DataFrame]:
    """Contributors after ``added``, for ``commit``: the files that hold one of them are written, with the others there."""
    who = added.select("pseudonym").distinct()
    if "contributor" not in catalog.tables():
        return [], intake.roll_up(None, added)
    files, rows = catalog.parts("contributor", who)
    own = rows.join(who, "pseudonym", "left_semi")
    return files, rows.join(who, "pseudonym", "left_anti").unionByName(intake.roll_up(own, added))


def _derived(catalog: Catalog, touched: DataFrame, own: DataFrame, counted: DataFrame, asof: int) -> tuple[DataFrame, tuple[list[str], DataFrame]]:
    """(canonical rows, the changed part of the consensus state) of the touched episodes.

    ``own`` has all their rows as they are to be, ``counted`` the votes that the state has so far. Only votes that come or
    go, and the one vote of an episode that has no other, are decoded.
    """
    after = consensus.latest_votes(own)
    if "consensus_state" not in catalog.tables():  # stamped rows of a table that came without its state
        counted = counted.limit(0)
    changes = deltas.changed_votes(counted, after).withColumn("hashes", sketch.decode_fingerprint("fingerprint"))
    changes = catalog.staged(deltas.deltas(changes.filter("hashes IS NOT NULL")), "changes")
    changed = changes.select(*E).distinct()
    files, rows = catalog.parts("consensus_state", changed) if "consensus_state" in catalog.tables() else ([], None)
    state = catalog.staged(deltas.applied(rows, changes), "state")
    # The files written have all rows of the changed episodes, and some of others.
    known = state if rows is None else semi(state, changed, E).unionByName(anti(_known(catalog, "consensus_state", touched), changed, E))
    single = semi(after, semi(known, touched, E).filter((F.col("h") == deltas.NONE) & (F.col("votes") == 1)), E)
    prints = deltas.consensus(semi(known, touched, E), single.withColumn("hashes", sketch.decode_fingerprint("fingerprint")).filter("hashes IS NOT NULL"))
    people = _known(catalog, "contributor", own.select("pseudonym").distinct())
    new = consensus.episode_tiers(own, people).join(prints, E).withColumn("promoted_at", F.lit(asof).cast("long"))
    canonical = new.select(*E, "tier", sketch.encode_fingerprint("hashes").alias("fingerprint"), "unique_contributors", "mean_confidence", "promoted_at")
    return catalog.staged(canonical, "derived"), (files, state)


def _stamped(rows: DataFrame, touched: DataFrame, asof: int) -> DataFrame:
    """``rows`` with the cursor on all eligible unprocessed rows of the touched episodes."""
    keys = touched.select(*E, F.lit(True).alias("touched_"))
    met = rows.alias("a").join(keys.alias("b"), fn.same_episode("a", "b"), "left").select("a.*", "touched_")
    stamp = F.col("promoted_at").isNull() & fn.eligible() & F.col("touched_").isNotNull()
    return met.withColumn("promoted_at", F.when(stamp, F.lit(asof).cast("long")).otherwise(F.col("promoted_at"))).drop("touched_")


def promote_batch(catalog: Catalog, asof: int, limit: int | None = None) -> None:
    """Tiers and consensus fingerprints of the queue's episodes; other episodes stay as they are.

    The consensus follows from the stored state and the votes that have come or been replaced since. Of ``contribution``
    only the files that hold a touched episode are written, with its rows stamped.
    """
    before = catalog.version()
    touched = catalog.staged(consensus.queue(catalog.read("contribution"), limit).select(*E), "queue")
    files, rows = catalog.parts("contribution", touched)
    own = semi(rows, touched, E)
    canonical, state = _derived(catalog, touched, own, deltas.counted(own), asof)
    replaced = {"contribution": (files, _stamped(rows, touched, asof)), "episode_canonical": _upserted(catalog, "episode_canonical", canonical, E), "consensus_state": state}
    catalog.commit(after=before, replaced=replaced)


def sketch_batch(catalog: Catalog, asof: int, limit: int | None = None, every: bool = False) -> DataFrame:
    """Make the sketches of stale episodes (or of ``every`` one) anew; returns what was made: (keys, hash_count)."""
    before, canonical, old = catalog.version(), catalog.read("episode_canonical"), _there(catalog, "canonical_sketch")
    stale = canonical if every or old is None else stale_sketches(canonical, old, limit)
    prints = semi(canonical, stale, E).select(*E, sketch.decode_fingerprint("fingerprint").alias("hashes")).filter("hashes IS NOT NULL")
    made = identify.sketches(prints, E).select(*E, sketch.pack_sketch("sketch").alias("sketch"), "hash_count", F.lit(asof).cast("long").alias("generated_at"))
    made = catalog.staged(made, "made")
    catalog.commit(after=before, replaced={"canonical_sketch": _upserted(catalog, "canonical_sketch", made, E)})
    return made.select(*E, "hash_count")


def regenerate_sketches(catalog: Catalog, asof: int, apply: bool = False) -> DataFrame:
    """Hold the stored sketches against ones made anew from the canonical fingerprints: the rows of ``catalog.sketch_diff``.

    A dry run unless ``apply`` is set; then the missing and changed sketches are stored, and nothing else is touched. Orphaned
    ones are reported only. An episode whose fingerprint can't be decoded has no sketch made and counts as having none.
    """
    before = catalog.version()
    prints = catalog.read("episode_canonical").select(*E, sketch.decode_fingerprint("fingerprint").alias("hashes")).filter("hashes IS NOT NULL")
    made = identify.sketches(prints, E).select(*E, sketch.pack_sketch("sketch").alias("sketch"), "hash_count", F.lit(asof).cast("long").alias("generated_at"))
    made = catalog.staged(made, "made")
    old = _there(catalog, "canonical_sketch")
    told = catalog.staged(sketch_diff(made, made.limit(0) if old is None else old), "diff")
    if apply:
        wanted = semi(made, told.filter("state IN ('missing', 'changed')"), E)
        catalog.commit(after=before, replaced={"canonical_sketch": _upserted(catalog, "canonical_sketch", wanted, E)})
    return told


def seed_batch(catalog: Catalog, episodes: DataFrame, asof: int) -> None:
    """Put seed episodes (keys, hashes) into the catalogue as canonical ones, with their sketches; a known episode gets the fingerprint only."""
    before = catalog.version()
    new = episodes.select(
        *E, F.lit("canonical").alias("tier"), sketch.encode_fingerprint("hashes").alias("fingerprint"), F.lit(1).cast("long").alias("unique_contributors"),
        F.lit(1.0).alias("mean_confidence"), F.lit(asof).cast("long").alias("promoted_at"),
    )
    new = catalog.staged(new, "seeds")
    drawn = identify.sketches(episodes, E).select(*E, sketch.pack_sketch("sketch").alias("sketch"), "hash_count", F.lit(asof + 1).cast("long").alias("generated_at"))
    drawn = catalog.staged(drawn, "drawn")
    merged: tuple[list[str], DataFrame] = ([], new)
    if "episode_canonical" in catalog.tables():
        files, rows = catalog.parts("episode_canonical", new.select(*E))
        merged = files, seed(rows, new, E, ["fingerprint", "promoted_at"]).select(*new.columns)
    catalog.commit(after=before, replaced={"episode_canonical": merged, "canonical_sketch": _upserted(catalog, "canonical_sketch", drawn, E)})


def hex_fingerprints(canonical: DataFrame) -> DataFrame:
    """(keys, fingerprint_hex): the stored bytes as text, for a rebuild outside the engine."""
    return canonical.select(*E, F.hex("fingerprint").alias("fingerprint_hex"))


def disc_rows(valid: DataFrame, first_id: int, received_at: int, host: str | None = None) -> DataFrame:
    """Valid disc requests as ``disc_contribution`` rows without the digest; ids count on in the order of the requests' contents."""
    order = F.sha2(F.concat_ws("|", "pseudonym", "disc_content_hash_b64", fn.titles_json(F.col("titles"))), 256)
    ranked = valid.withColumn("o_", order).repartitionByRange("o_").sortWithinPartitions("o_").withColumn("n_", F.monotonically_increasing_id())
    return ranked.select(
        (F.col("n_") + first_id).alias("id"), F.lit(received_at).cast("long").alias("received_at"), "pseudonym",
        F.lower(F.hex(fn.strict_base64(F.col("disc_content_hash_b64")))).alias("disc_content_hash"), "tmdb_id", "content_type", "season",
        fn.sorted_titles(F.col("titles")).alias("titles"), "client_version", _host(valid, host).alias("ingress_host"), F.lit(None).cast("long").alias("promoted_at"),
    )


def disc_request_batch(catalog: Catalog, requests: DataFrame, asof: int, done: tuple[str, int] | None = None, host: str | None = None) -> None:
    """One micro-batch of disc requests: validate, quarantine, make rows of them, insert or ignore, derive the touched discs."""
    if done and catalog.done(*done):
        return
    judged = catalog.staged(intake.judged(requests, intake.disc_reason()), "requests")
    valid, rejected = judged.filter("reason IS NULL"), judged.filter("reason IS NOT NULL").drop("refused")
    top = catalog.read("disc_contribution").agg(F.max("id")).first()[0] if "disc_contribution" in catalog.tables() else None
    rows = catalog.staged(disc_rows(valid, (top or 0) + 1, asof, host), "discs")
    disc_batch(catalog, rows, asof, done, quarantine=rejected_rows(rejected))


def disc_batch(catalog: Catalog, discs: DataFrame, asof: int, done: tuple[str, int] | None = None, quarantine: DataFrame | None = None) -> None:
    """Insert-or-ignore disc contributions (as ``disc_contributions`` has them), derive the touched discs, stamp their rows.

    The files that hold a touched disc are written, no others.
    """
    if done and catalog.done(*done):
        return
    before, there = catalog.version(), "disc_contribution" in catalog.tables()
    keyed = discs.withColumn("titles_digest", fn.titles_digest(F.col("titles")))
    hashes = catalog.staged(keyed.select("disc_content_hash").distinct(), "touched")
    waiting = catalog.staged(consensus.unpromoted_discs(catalog.read("disc_contribution")).unionByName(hashes).distinct(), "waiting") if there else hashes
    files, old = catalog.parts("disc_contribution", waiting) if there else ([], None)
    new, _ = intake.deduplicate(keyed, old, intake.DISC_UNIQUE, ["received_at", "id"])
    new = catalog.staged(new, "new")
    every = new if old is None else old.unionByName(new.select(*old.columns))
    person_files, people = _people(catalog, new.withColumn("poison_check", F.lit("pass")))
    people = catalog.staged(people, "people")
    own = catalog.staged(every.join(waiting, "disc_content_hash", "left_semi"), "own")
    voters = people if "contributor" not in catalog.tables() else people.unionByName(anti(_known(catalog, "contributor", own.select("pseudonym").distinct()), people, ["pseudonym"]))
    touched = consensus.unpromoted_discs(own)
    derived = consensus.disc_canonical(consensus.flag_discs(own.join(touched, "disc_content_hash", "left_semi"), voters)).withColumn("promoted_at", F.lit(asof).cast("long"))
    derived = catalog.staged(derived, "derived")
    replaced = {
        "disc_contribution": (files, consensus.stamp_discs(every, asof)), "contributor": (person_files, people),
        "disc_canonical": _upserted(catalog, "disc_canonical", derived, ["disc_content_hash"]),
    }
    catalog.commit(after=before, replaced=replaced, added={} if quarantine is None else {"quarantine": quarantine}, done=done)


def retract_batch(catalog: Catalog, requests: DataFrame, asof: int) -> DataFrame:
    """Delete the rows that the requests name and derive their episodes again; returns the outcomes.

    An episode without rows loses its canonical row and its sketch (removed). One with rows left is derived from its
    eligible votes; where these make no tier (none is left, or a flagged contributor's alone), the canonical row stays as it
    is (kept), and where an episode has no canonical row there is none to keep. A re-derived episode keeps its sketch
    until the next sketch job. If the derivation fails, the deletion is committed all the same and the episodes are reported
    as re_derive_failed: their cursor is taken off, so the next promotion derives them.
    """
    before = catalog.version()
    keys = catalog.staged(requests.select(*intake.UNIQUE).distinct(), "requests")
    own = catalog.staged(catalog.lookup("contribution", keys.select(*E).distinct()), "own")
    told = catalog.staged(outcomes(keys, own, intake.UNIQUE), "told")
    touched = catalog.staged(told.filter("outcome <> 'untouched'").select(*E).distinct(), "touched")
    left = retract(own, keys, intake.UNIQUE)
    files, rows = catalog.parts("contribution", touched)  # its other rows are stamped
    gone = catalog.staged(semi(own, keys, intake.UNIQUE).select(F.col("id").alias("contribution_id")), "gone")
    empty = told.filter("outcome = 'removed'").select(*E).distinct()
    replaced = {"overlap_observation": _removed(catalog, "overlap_observation", gone)} if "overlap_observation" in catalog.tables() else {}
    for name in ("canonical_sketch", "episode_canonical"):
        if name in catalog.tables():
            replaced[name] = _removed(catalog, name, empty)
    held = retract(rows, keys, intake.UNIQUE)
    try:
        canonical, state = _derived(catalog, touched, left, deltas.counted(own), asof)
        replaced["contribution"] = files, _stamped(held, touched, asof)
        replaced["consensus_state"] = state
        if "episode_canonical" in catalog.tables():
            files_, rows_ = catalog.parts("episode_canonical", touched)
            replaced["episode_canonical"] = files_, upsert(anti(rows_, empty, E), canonical, E)
        else:
            replaced["episode_canonical"] = [], canonical
        out = decided(told, canonical)
    except (PySparkException, Py4JJavaError):
        # The state keeps what it counts only as long as the rows do: the touched episodes are counted anew next time.
        if "consensus_state" in catalog.tables():
            replaced["consensus_state"] = _removed(catalog, "consensus_state", touched)
        reset = held.alias("a").join(touched.select(*E, F.lit(True).alias("t_")).alias("b"), fn.same_episode("a", "b"), "left").select("a.*", "t_")
        replaced["contribution"] = files, reset.withColumn("promoted_at", F.when(F.col("t_").isNull(), F.col("promoted_at"))).drop("t_")
        out = told.withColumn("outcome", F.when(F.col("outcome") == "re_derived", "re_derive_failed").otherwise(F.col("outcome")))
    catalog.commit(after=before, replaced=replaced)
    return out


def forget_batch(catalog: Catalog, pseudonyms: DataFrame) -> dict[str, int]:
    """Erase contributors (pseudonym): their contributions, discs, counters, observations and quarantined requests.

    Canonical tables are aggregates and stay; the consensus state no longer counts the erased votes. The files that hold
    an erased row are written anew without it, all older versions are forgotten, and files that no version names are deleted,
    so no file under the root has the pseudonym. No other writer may be at work. Returns the rows deleted by table, and
    as ``rows_deleted`` those of contributions, discs and contributors.
    """
    before, who = catalog.version(), catalog.staged(pseudonyms.select("pseudonym").distinct(), "who")
    replaced, counts, tables = {}, {}, catalog.tables()
    for name in ("contribution", "disc_contribution", "contributor"):
        if name in tables:
            files, rows = catalog.parts(name, who)
            counts[name] = rows.join(who, "pseudonym", "left_semi").count()
            replaced[name] = files, rows.join(who, "pseudonym", "left_anti")
    if "contribution" in tables:
        gone = catalog.staged(catalog.lookup("contribution", who), "gone")
        if "overlap_observation" in tables:
            replaced["overlap_observation"] = _removed(catalog, "overlap_observation", gone.select(F.col("id").alias("contribution_id")))
        if "consensus_state" in tables:
            touched = gone.select(*E).distinct()
            own = catalog.lookup("contribution", touched)
            votes = deltas.changed_votes(deltas.counted(own), deltas.counted(own.join(who, "pseudonym", "left_anti")))
            changes = catalog.staged(deltas.deltas(votes.withColumn("hashes", sketch.decode_fingerprint("fingerprint")).filter("hashes IS NOT NULL")), "changes")
            files, rows = catalog.parts("consensus_state", changes.select(*E).distinct())
            replaced["consensus_state"] = files, deltas.applied(rows, changes)
    if "quarantine" in tables:  # a request that couldn't be read may name anyone in its text
        named = F.concat(F.array("pseudonym"), F.regexp_extract_all(F.lower(F.coalesce("raw", F.lit(""))), F.lit(f"({S.UUID4[1:-2]})"), F.lit(1)))
        files, rows = [f[0] for f in catalog.files("quarantine")], catalog.read("quarantine")
        rows = rows.withColumn("row_", F.monotonically_increasing_id())
        hits = rows.select("row_", F.explode(named).alias("pseudonym")).join(who, "pseudonym", "left_semi").select("row_").distinct()
        replaced["quarantine"] = files, rows.join(hits, "row_", "left_anti").drop("row_")
    catalog.commit(after=before, replaced=replaced)
    catalog.expire(keep=1)
    catalog.sweep()
    return counts | {"rows_deleted": sum(counts.values())}


def pack_batch(catalog: Catalog, path: str, asof: int) -> None:
    """Write all shows' packs, in place of those there were, so a show without a canonical episode has none."""
    canonical = catalog.read("episode_canonical").withColumn("hashes", sketch.decode_fingerprint("fingerprint"))
    packs.write_packs(canonical.filter("hashes IS NOT NULL"), path, asof)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query has for good: it is written into its checkpoint folder."""
    text = spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0]
    return json.loads(text)["id"]


def _feed(stream: DataFrame, batch: Callable, catalog: Catalog, checkpoint: str, asof: int, host: str | None) -> StreamingQuery:
    """Run ``batch`` on every micro-batch, once: a batch that is replayed after its commit is passed over."""

    def run(df: DataFrame, number: int) -> None:
        batch(catalog, df, asof + number, (stream_id(catalog.spark, checkpoint), number), host)
        catalog.compact()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_intake(spark: SparkSession, source: str, root: str, checkpoint: str, asof: int, max_files: int = 100, limit: int | None = None, host: str | None = None) -> StreamingQuery:
    """Read all waiting JSON files under ``source`` in bounded micro-batches and feed them to the catalogue at ``root``.

    Lines that can't be read are quarantined with their text. With ``limit``, requests of a pseudonym beyond that many in a
    window are refused before they are decoded and screened; a request's time is that of its file.
    """
    stream = adapters.stream_json(spark, source, S.CONTRIBUTION_REQUEST, max_files)
    stream = stream if limit is None else limited(stream, intake.contribution_reason(), limit)
    return _feed(stream, intake_batch, Catalog(spark, root), checkpoint, asof, host)


def start_disc_intake(spark: SparkSession, source: str, root: str, checkpoint: str, asof: int, max_files: int = 100, limit: int | None = None, host: str | None = None) -> StreamingQuery:
    """As ``start_intake``, for disc requests."""
    stream = adapters.stream_json(spark, source, S.DISC_REQUEST, max_files)
    stream = stream if limit is None else limited(stream, intake.disc_reason(), limit)
    return _feed(stream, disc_request_batch, Catalog(spark, root), checkpoint, asof, host)


def limited(stream: DataFrame, reason: Column, limit: int = S.RATE_LIMIT, window: int = S.RATE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """``stream`` (requests with their arrival ``ts``) with ``refused``: whether the request is beyond ``limit`` in its window.

    The count of each pseudonym and window is kept in a state store from micro-batch to micro-batch. Windows are counted
    from the epoch; a state goes when the watermark passes its window, so only pseudonyms that are at work have one.
    Requests that validation rejects aren't counted. A request that comes later than ``late`` is dropped with its
    window's state, as event time has it; arrival times don't run backwards that far.
    """
    counts = F.coalesce(F.col(S.UNREADABLE).isNull() & reason.isNull(), F.lit(False))
    keyed = stream.withWatermark("ts", late).withColumn("counts", counts)
    # What isn't counted needs no state, and is dealt out.
    nobody = F.concat(F.lit("-"), F.pmod(F.xxhash64(*stream.columns), F.lit(1024)).cast("string"))
    keyed = keyed.withColumns({"who_": F.when(F.col("counts"), F.col("pseudonym")).otherwise(nobody), "window_": F.floor(F.col("ts").cast("double") / window).cast("long")})
    whole = T.StructType([*keyed.schema.fields, T.StructField("refused", T.BooleanType())])

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        for f in frames:
            own = f["counts"].astype(bool)
            nth = n + own.cumsum()
            n = int(nth.iloc[-1]) if len(f) else n
            yield f.assign(refused=own & (nth > limit))
        if n:
            state.update((n,))
            end = (int(key[1]) + 1) * window * 1000
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    grouped = keyed.groupBy("who_", "window_")
    judged = grouped.applyInPandasWithState(judge, whole, "n long", "append", GroupStateTimeout.EventTimeTimeout)
    return judged.drop("who_", "window_", "counts", "ts")


def intake_rate(events: DataFrame, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Requests by pseudonym and window of an event-time stream (pseudonym, ts): what a rate limiter looks at."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "pseudonym").agg(F.count("*").alias("n"))
