"""Changes to the stored tables: merges, erasure, retraction, backfill, staleness. ``versioned`` stores their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn

E = S.EPISODE


def _null_safe(keys: list[str], a: str = "a", b: str = "b"):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.alias("a").join(right.select(*keys).distinct().alias("b"), _null_safe(keys), "left_anti")


def semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.alias("a").join(right.select(*keys).distinct().alias("b"), _null_safe(keys), "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows of ``new`` replace those of ``old`` with the same keys."""
    return anti(old, new, keys).unionByName(new.select(*old.columns))


def seed(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """As ``upsert``, but where a key is there already only ``columns`` change."""
    rest = [c for c in old.columns if c not in keys]
    met = old.alias("a").join(new.alias("b"), _null_safe(keys), "full_outer")
    hit = F.coalesce(*[F.col(f"b.{k}").isNotNull() for k in keys[:1]])
    value = lambda c: F.when(hit & F.col(f"a.{keys[0]}").isNotNull(), F.col(f"b.{c}" if c in columns else f"a.{c}")).otherwise(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")))
    return met.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], *[value(c).alias(c) for c in rest])


def forget(tables: dict[str, DataFrame], pseudonyms: DataFrame) -> dict[str, DataFrame]:
    """The tables without the pseudonyms; observations follow their contributions, canonical tables don't change."""
    out = dict(tables)
    for name in ("contribution", "disc_contribution", "contributor"):
        if name in out:
            out[name] = out[name].join(pseudonyms, "pseudonym", "left_anti")
    if "overlap_observation" in out:
        out["overlap_observation"] = cascade(out["overlap_observation"], out["contribution"])
    return out


def cascade(observations: DataFrame, contributions: DataFrame) -> DataFrame:
    return observations.join(contributions.select(F.col("id").alias("contribution_id")), "contribution_id", "left_semi")


def retract(contributions: DataFrame, requests: DataFrame, unique: list[str]) -> DataFrame:
    """``contributions`` without the rows that the requests name; the pseudonym is part of the key."""
    return anti(contributions, requests, unique)


def outcomes(requests: DataFrame, contributions: DataFrame, unique: list[str]) -> DataFrame:
    """What each retraction does to its episode: (unique, deleted, remaining, outcome).

    untouched: the request names no row; re_derived: the episode has other contributions left; removed: it has none.
    Requests are taken together; one that is made twice has one row.
    """
    asked = requests.select(*unique).distinct()
    hits = contributions.groupBy(*unique).agg(F.count("*").alias("deleted"))
    met = asked.alias("a").join(hits.alias("b"), _null_safe(unique), "left").select("a.*", F.coalesce("deleted", F.lit(0)).alias("deleted"))
    left = retract(contributions, requests, unique).groupBy(*E).agg(F.count("*").alias("remaining"))
    out = met.alias("a").join(left.alias("b"), _null_safe(E), "left").select("a.*", F.coalesce("remaining", F.lit(0)).alias("remaining"))
    kind = F.when(F.col("deleted") == 0, "untouched").when(F.col("remaining") > 0, "re_derived").otherwise("removed")
    return out.withColumn("outcome", kind)


def without_orphans(canonical: DataFrame, sketches: DataFrame, contributions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical episodes and sketches less those of episodes without any contribution."""
    gone = orphans(canonical, contributions)
    return anti(canonical, gone, E), anti(sketches, gone, E)


def retraction_outcome(before: DataFrame, after: DataFrame) -> DataFrame:
    """Episodes that lost votes: (keys, deleted, remaining, outcome), outcome re_derived or removed."""
    b = before.groupBy(*E).agg(F.count("*").alias("n_before"))
    a = after.groupBy(*E).agg(F.count("*").alias("n_after"))
    met = b.alias("a").join(a.alias("b"), _null_safe(E), "left").select("a.*", F.coalesce("n_after", F.lit(0)).alias("remaining"))
    return met.filter("remaining < n_before").select(
        *E, (F.col("n_before") - F.col("remaining")).alias("deleted"), "remaining", F.when(F.col("remaining") > 0, "re_derived").otherwise("removed").alias("outcome")
    )


def orphans(canonical: DataFrame, contributions: DataFrame) -> DataFrame:
    """Canonical episodes without any contribution."""
    return anti(canonical, contributions, E)


def stale_sketches(canonical: DataFrame, sketches: DataFrame, limit: int | None = None) -> DataFrame:
    """Episodes whose sketch is missing or not younger than the promotion; the highest tier first, then the oldest."""
    met = canonical.alias("a").join(sketches.alias("b"), _null_safe(E), "left").select("a.*", F.col("b.generated_at").alias("generated_at"))
    late = met.filter(F.col("generated_at").isNull() | (F.col("generated_at") <= F.col("promoted_at")))
    rank = F.when(F.col("tier") == "canonical", 0).when(F.col("tier") == "confirmed", 1).otherwise(2)
    late = late.orderBy(rank, "promoted_at", *E)
    return late if limit is None else late.limit(limit)


def undercounted(canonical: DataFrame, contributions: DataFrame) -> DataFrame:
    """Episodes that store fewer contributors than have eligible votes: (keys, tier, stored, actual)."""
    actual = contributions.filter(fn.eligible()).groupBy(*E).agg(F.count_distinct("pseudonym").alias("actual"))
    met = canonical.alias("a").join(actual.alias("b"), _null_safe(E)).select("a.*", "actual")
    return met.filter(F.col("unique_contributors") < F.col("actual")).select(*E, "tier", F.col("unique_contributors").alias("stored"), "actual")


def reset_backfill(canonical: DataFrame, contributions: DataFrame) -> DataFrame:
    """``contributions`` with the cursor taken off all rows of undercounted episodes."""
    keys = undercounted(canonical, contributions).select(*E, F.lit(True).alias("hit_"))
    met = contributions.alias("a").join(keys.alias("b"), _null_safe(E), "left").select("a.*", "hit_")
    return met.withColumn("promoted_at", F.when(F.col("hit_").isNull(), F.col("promoted_at"))).drop("hit_")


def sketch_diff(fingerprints: DataFrame, sketches: DataFrame) -> DataFrame:
    """What a regeneration of all sketches would do: (keys, state, old_count, hash_count), a row for each episode of either side.

    ``fingerprints`` and ``sketches`` are (keys, sketch, hash_count), the first made anew from the canonical fingerprints. The
    state is missing (no sketch is stored), changed (its slots or its count differ), equal, or orphaned (no such episode).
    """
    met = fingerprints.alias("a").join(sketches.alias("b"), _null_safe(E), "full_outer")
    kind = (
        F.when(F.col("b.hash_count").isNull(), "missing").when(F.col("a.hash_count").isNull(), "orphaned")
        .when((F.col("a.sketch") == F.col("b.sketch")) & (F.col("a.hash_count") == F.col("b.hash_count")), "equal").otherwise("changed")
    )
    keys = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in E]
    return met.select(*keys, kind.alias("state"), F.col("b.hash_count").alias("old_count"), F.col("a.hash_count").alias("hash_count"))


def decided(told: DataFrame, derived: DataFrame) -> DataFrame:
    """``outcomes`` after the derivation: re_derived where the votes left make a canonical row (in ``derived``), else kept.

    An episode with rows of which none makes a tier keeps the canonical row that it has.
    """
    met = told.alias("a").join(derived.select(*E, F.lit(True).alias("new_")).alias("b"), _null_safe(E), "left").select("a.*", "new_")
    return met.withColumn("outcome", F.when((F.col("outcome") == "re_derived") & F.col("new_").isNull(), "kept").otherwise(F.col("outcome"))).drop("new_")
