"""Consensus kept up by signed changes of votes: (episode, hash, votes) rows that arrivals add to and replacements and
retractions take from, in place of counting all votes of a touched episode anew.

A vote counts each of its hashes once; a vote without hashes doesn't count. The hash ``NONE`` stands for the vote itself, so
its row has an episode's number of votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from ..sources.store import few
from .consensus import NONE, latest_votes

E = S.EPISODE


def counted(rows: DataFrame) -> DataFrame:
    """The votes that a state counts: the latest ones among the rows whose cursor is stamped."""
    return latest_votes(rows.filter("promoted_at IS NOT NULL"))


def changed_votes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Votes of either side that the other doesn't have, by id, with their ``sign``: -1 gone, 1 come. No fingerprint is decoded yet."""
    gone = before.join(after.select("id"), "id", "left_anti").withColumn("sign", F.lit(-1))
    come = after.join(before.select("id"), "id", "left_anti").withColumn("sign", F.lit(1))
    return gone.unionByName(come.select(*gone.columns))


def deltas(votes: DataFrame) -> DataFrame:
    """(keys, h, votes) of signed votes (keys, hashes, sign): what they change, without rows that change nothing."""
    cast = votes.filter(F.size("hashes") > 0)
    hashes = F.concat(F.array(F.lit(NONE).cast("long")), F.array_distinct("hashes"))
    rows = cast.select(*E, "sign", F.explode(hashes).alias("h"))
    return rows.groupBy(*E, "h").agg(F.sum("sign").cast("long").alias("votes")).filter("votes <> 0")


def applied(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The state after the changes; rows that no vote is left for are gone."""
    both = changes if state is None else state.select(*E, "h", "votes").unionByName(changes)
    return both.groupBy(*E, "h").agg(F.sum("votes").alias("votes")).filter("votes <> 0")


def needed(n: Column) -> Column:
    return F.ceil(n * 0.5)


def consensus(state: DataFrame, votes: DataFrame) -> DataFrame:
    """(keys, hashes) by the state: as ``consensus.consensus_canonical`` of ``votes`` (id, keys, hashes), of which those of
    episodes with a single vote alone are read."""
    n = state.filter(F.col("h") == NONE).select(*E, F.col("votes").alias("n_votes"))
    single = few(n.filter("n_votes = 1")).alias("b")
    alone = votes.filter(F.size("hashes") > 0).select(*E, "hashes").alias("a").join(single, fn.same_episode("a", "b"), "left_semi")
    met = state.filter(F.col("h") != NONE).alias("a").join(n.filter("n_votes > 1").alias("b"), fn.same_episode("a", "b")).select("a.*", "n_votes")
    many = met.filter(F.col("votes") >= needed(F.col("n_votes")))
    return alone.unionByName(many.groupBy(*E).agg(F.array_sort(F.collect_list("h")).alias("hashes")))
