"""Votes to tiers and consensus fingerprints, for episodes and for discs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from ..sources.store import few

E = S.EPISODE


def queue(contributions: DataFrame, limit: int | None = 30) -> DataFrame:
    """Episodes with eligible votes that no run has processed, the oldest first: (keys, oldest). Movies have no tier and aren't offered."""
    numbered = F.col("season").isNotNull() & F.col("episode").isNotNull()
    waiting = contributions.filter(F.col("promoted_at").isNull() & fn.eligible() & numbered)
    out = waiting.groupBy(*E).agg(F.min("received_at").alias("oldest"))
    out = out.orderBy("oldest", *E)
    return out if limit is None else out.limit(limit)


def latest_votes(contributions: DataFrame) -> DataFrame:
    """The eligible votes of the latest second of each pseudonym and episode; ties in that second all stay."""
    order = W.partitionBy(*E, "pseudonym").orderBy(F.col("received_at").desc())
    return contributions.filter(fn.eligible()).withColumn("rank_", F.rank().over(order)).filter("rank_ = 1").drop("rank_")


def episode_votes(contributions: DataFrame, contributors: DataFrame) -> DataFrame:
    """A row for each episode: n_rows, independent (distinct pseudonym and disc), mean_confidence, any_flagged."""
    flagged = contributors.filter("flagged = 1").select("pseudonym", F.lit(True).alias("flagged_"))
    votes = latest_votes(contributions).join(flagged, "pseudonym", "left")
    pair = F.struct("pseudonym", F.coalesce(F.col("disc").cast("string"), F.lit("null")))
    return votes.groupBy(*E).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(pair).alias("independent"),
        F.avg("match_confidence").alias("mean_confidence"),
        F.bool_or(F.coalesce("flagged_", F.lit(False))).alias("any_flagged"),
        F.max("received_at").alias("last_vote"),
    )


def episode_tiers(contributions: DataFrame, contributors: DataFrame) -> DataFrame:
    """Tiers by episode. A flagged contributor alone makes no episode; episodes without season or episode aren't promoted."""
    v = episode_votes(contributions, contributors)
    v = v.filter(~((F.col("independent") == 1) & F.col("any_flagged")) & F.col("season").isNotNull() & F.col("episode").isNotNull())
    return v.select(
        *E,
        fn.tier(F.col("independent"), F.col("mean_confidence"), F.col("any_flagged")).alias("tier"),
        F.col("independent").alias("unique_contributors"),
        "mean_confidence",
        F.col("last_vote").alias("promoted_at"),
        "n_rows",
    )


def unpromotable(contributions: DataFrame) -> DataFrame:
    """Episodes with votes but without a season or an episode number, which the queue would offer again and again."""
    return contributions.filter(fn.eligible() & (F.col("season").isNull() | F.col("episode").isNull())).select(*E).distinct()


#: Not a hash: those are unsigned 32-bit numbers. Its row has an episode's number of votes.
NONE = -1


def counts(votes: DataFrame) -> DataFrame:
    """(keys, h, n): votes of each episode that have the hash, and under NONE all of them.

    A vote counts each of its hashes once, and one without hashes doesn't count. Hashes are summed up in each task before
    they are shuffled, and no fingerprint is shuffled.
    """
    hashes = F.concat(F.array(F.lit(NONE).cast("long")), F.array_distinct("hashes"))
    return votes.filter(F.size("hashes") > 0).select(*E, F.explode(hashes).alias("h")).groupBy(*E, "h").agg(F.count("*").alias("n"))


def agreed(counts: DataFrame) -> DataFrame:
    """(keys, h, n, n_votes) of the hashes that at least half of an episode's votes have."""
    n = F.max(F.when(F.col("h") == NONE, F.col("n"))).over(W.partitionBy(*E))  # a join would count all hashes twice
    return counts.withColumn("n_votes", n).filter((F.col("h") != NONE) & (F.col("n") >= F.ceil(F.col("n_votes") * 0.5)))


def consensus_hashes(votes: DataFrame) -> DataFrame:
    """(keys, h, n) of the hashes that at least half of an episode's votes have; votes are rows (id, keys, hashes)."""
    return agreed(counts(votes)).select(*E, "h", "n")


def consensus_canonical(votes: DataFrame) -> DataFrame:
    """(keys, hashes): the one vote's own hashes, order and repeats kept, or else the sorted consensus."""
    cast = votes.filter(F.size("hashes") > 0).select(*E, "hashes")
    single = few(cast.groupBy(*E).agg(F.count("*").alias("n_votes")).filter("n_votes = 1"))  # no other fingerprint is shuffled
    alone = cast.alias("a").join(single.alias("b"), fn.same_episode("a", "b"), "left_semi").select(*E, "hashes")
    many = agreed(counts(cast)).filter("n_votes > 1").groupBy(*E).agg(F.array_sort(F.collect_list("h")).alias("hashes"))
    return alone.unionByName(many)


def promote(contributions: DataFrame, asof: int, limit: int | None = None) -> DataFrame:
    """``contributions`` with the cursor stamped: all eligible unprocessed rows of the queue's episodes get ``asof``."""
    keys = queue(contributions, limit).select(*E, F.lit(True).alias("touched_"))
    out = contributions.alias("a").join(keys.alias("b"), fn.same_episode("a", "b"), "left").select("a.*", "touched_")
    stamp = F.col("promoted_at").isNull() & fn.eligible() & F.col("touched_").isNotNull()
    return out.withColumn("promoted_at", F.when(stamp, F.lit(asof)).otherwise(F.col("promoted_at"))).drop("touched_")


# Discs


def title_stats(discs: DataFrame) -> DataFrame:
    """Per contribution: number of titles, their mean confidence, network taint, eligibility."""
    t = F.col("titles")
    out = discs.withColumns({"n_titles": F.size(t), "mean_conf": fn.mean_title_confidence(t), "network": fn.from_network(t)})
    good = t.isNotNull() & ~F.col("flagged") & ~F.col("network") & (F.round("mean_conf", 12) >= S.MIN_CONFIDENCE)
    return out.withColumn("eligible", F.coalesce(good, F.lit(False)))


def digest_groups(discs: DataFrame) -> DataFrame:
    """Per disc and digest: voters, mean of the voters' means, and the representative vote (the latest)."""
    good = title_stats(discs).filter("eligible").withColumn("titles_digest", fn.titles_digest(F.col("titles")))
    order = W.partitionBy("disc_content_hash", "titles_digest", "pseudonym").orderBy(F.col("received_at").desc(), F.col("id").desc())
    kept = good.withColumn("rank_", F.row_number().over(order)).filter("rank_ = 1")
    return kept.groupBy("disc_content_hash", "titles_digest").agg(
        F.count("*").alias("voters"),
        F.avg("mean_conf").alias("mean_confidence"),
        F.max_by(F.struct("id", "tmdb_id", "content_type", "season", "titles"), F.struct("received_at", "id")).alias("representative"),
    )


def disc_winner(groups: DataFrame) -> DataFrame:
    """The best digest of each disc with its tier; a runner-up of two voters caps the tier at confirmed.

    Means are compared after rounding to 12 digits, so that the order in which they were summed decides nothing.
    """
    order = W.partitionBy("disc_content_hash").orderBy(F.col("voters").desc(), F.round("mean_confidence", 12).desc(), "titles_digest")
    ranked = groups.withColumns({"rank_": F.row_number().over(order), "runner_up": F.lead("voters").over(order)}).filter("rank_ = 1").drop("rank_")
    tier = fn.tier(F.col("voters"), F.round("mean_confidence", 12), F.lit(False))
    capped = (tier == "canonical") & (F.coalesce("runner_up", F.lit(0)) >= 2)
    return ranked.withColumns({"tier": F.when(capped, "confirmed").otherwise(tier), "capped": capped})


def disc_canonical(discs: DataFrame) -> DataFrame:
    w = disc_winner(digest_groups(discs))
    return w.select(
        "disc_content_hash", F.col("representative.tmdb_id").alias("tmdb_id"), F.col("representative.content_type").alias("content_type"),
        F.col("representative.season").alias("season"), F.col("representative.titles").alias("titles"), "titles_digest", "tier",
        F.col("voters").alias("unique_contributors"), "mean_confidence",
    )


def unpromoted_discs(discs: DataFrame) -> DataFrame:
    """Hashes of the discs with a contribution that no run has processed."""
    return discs.filter(F.col("promoted_at").isNull()).select("disc_content_hash").distinct()


def flag_discs(discs: DataFrame, contributors: DataFrame) -> DataFrame:
    """``discs`` with ``flagged``: whether the contributor is."""
    flagged = contributors.filter("flagged = 1").select("pseudonym", F.lit(True).alias("flagged"))
    return discs.drop("flagged").join(flagged, "pseudonym", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def stamp_discs(discs: DataFrame, asof: int) -> DataFrame:
    """All unprocessed rows get ``asof``, eligible or not."""
    return discs.withColumn("promoted_at", F.coalesce("promoted_at", F.lit(asof)))
