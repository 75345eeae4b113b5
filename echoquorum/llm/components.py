"""Connected components of an edge table, by alternating large-star and small-star steps.

Everything stays in tables: a step is a grouped minimum joined back to the edges, and each round is written to the
shared folder, which cuts the lineage. No node's neighbours are ever gathered in one place. The number of rounds grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch


def _toward_minimum(arcs: DataFrame) -> DataFrame:
    """For arcs (u, v): join to each the least of u and all its v, as m."""
    least = arcs.groupBy("u").agg(F.min("v").alias("least"))
    return arcs.join(least, "u").withColumn("m", F.least("u", "least")).drop("least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_minimum(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _toward_minimum(down)
    own = met.select("u", F.col("m").alias("v"))
    others = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of longs -> (node, root): every node of a proper edge with the least node it can reach.

    Loops, repeated edges and null ends are dropped. No edges give an empty table.
    """
    now = scratch(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges"
    )
    sign = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = tuple(now.agg(*sign).first())
    for _ in range(max_rounds):
        if not before[0]:
            break
        new = scratch(_small_star(_large_star(now).distinct()).distinct(), "edges")
        after = tuple(new.agg(*sign).first())
        drop_scratch(now)
        now = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
