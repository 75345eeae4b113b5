"""Operator 1, mixing sources to target weights. DataFrame functions only.

The budget, in tokens, flows down the tree domain - language - source. A node can take no more than ``max_epochs``
times the tokens below it. Where siblings' weighted shares pass what some of them can take, those are filled and the
shortage goes to their siblings in proportion to the weights; only what a whole subtree can't take reaches the
siblings of its ancestor. All arithmetic is on integers, so the parts of a node's budget sum up exactly.

A leaf then reads its documents in seeded epochs: every whole epoch that its budget covers takes each document once,
and of the next epoch, ordered by a seeded hash, the longest prefix that still fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, join_by_weight, row_keys, scratch

#: Hexadecimal digits of the seeded hash that number the buckets of an epoch: a leaf's prefix sum is taken over 4,096
#: buckets, and only the one bucket in which the prefix ends is looked into. There the sum is taken over the whole
#: hash and as many digits of the row's own hash, so that rows which share an id aren't sorted in one place either.
BUCKET_DIGITS = 3


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def fill(nodes: DataFrame, parent: list[str], name: str, budget: str, weight: str, cap: str) -> DataFrame:
    """Add ``share``: each sibling's part of the parent's ``budget``, by ``weight`` and at most ``cap``.

    Siblings are taken in the order of cap / weight. One is full if its cap is at most its share of what those before
    it have left; the others divide the rest in proportion, rounded so that the parts sum up.
    """
    order = W.partitionBy(*parent).orderBy(
        F.when(F.col(weight) > 0, F.col(cap).cast("double") / F.col(weight)).asc_nulls_last(), F.col(name).asc_nulls_first()
    )
    to_end = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    big = "decimal(38,0)"
    out = nodes.withColumns(
        {
            "w_left_": F.sum(weight).over(to_end),
            "b_left_": F.greatest(F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0)), F.lit(0)),
        }
    )
    full = (F.col(weight) > 0) & (F.col(cap).cast("decimal(20,0)") * F.col("w_left_").cast("decimal(18,0)") <= F.col("b_left_").cast("decimal(20,0)") * F.col(weight).cast("decimal(18,0)"))
    out = out.withColumn("full_", full)
    # What is left for those that aren't full: the budget without all full caps.
    all_ = W.partitionBy(*parent)
    out = out.withColumns(
        {
            "rest_b_": F.greatest(F.col(budget) - F.coalesce(F.sum(F.when(F.col("full_"), F.col(cap))).over(all_), F.lit(0)), F.lit(0)),
            "rest_w_": F.coalesce(F.sum(F.when(~F.col("full_"), F.col(weight))).over(all_), F.lit(0)),
            "to_w_": F.sum(F.when(~F.col("full_"), F.col(weight)).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)),
        }
    )
    part = lambda w: f"cast(cast(rest_b_ as {big}) * ({w}) div greatest(rest_w_, 1) as long)"
    share = F.when(F.col("full_"), F.col(cap)).otherwise(F.expr(f"{part('to_w_')} - {part(f'to_w_ - `{weight}`')}"))
    return out.withColumn("share", share).drop("w_left_", "b_left_", "full_", "rest_b_", "rest_w_", "to_w_")


def allocate(leaves: DataFrame, weights: dict[str, int], budget: int, max_epochs: int) -> DataFrame:
    """Add ``share`` to the leaves (domain, lang, source, tokens, ...): their parts of the budget in tokens.

    weights has whole numbers by path ("domain", "domain/lang", "domain/lang/source"); a path not in it weighs 1. They go
    into the plan as a small table.
    """
    table = leaves.sparkSession.createDataFrame(sorted(weights.items()), "path_ string, weight long")

    def weighed(nodes: DataFrame, path: Column) -> DataFrame:
        met = nodes.withColumn("path_", path).join(table, "path_", "left").drop("path_")
        return met.withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))

    up = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    langs = up.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    domains = fill(
        weighed(domains.withColumns({"budget": F.lit(budget).cast("long"), "root_": F.lit(0)}), F.col("domain")),
        ["root_"], "domain", "budget", "weight", "cap",
    ).select("domain", F.col("share").alias("budget"))
    langs = fill(
        weighed(langs.join(domains, "domain"), F.concat_ws("/", "domain", "lang")),
        ["domain"], "lang", "budget", "weight", "cap",
    ).select("domain", "lang", F.col("share").alias("budget"))
    return fill(
        weighed(up.join(langs, ["domain", "lang"]), F.concat_ws("/", "domain", "lang", "source")),
        ["domain", "lang"], "source", "budget", "weight", "cap",
    ).drop("cap", "budget", "weight")


def choose(rows: DataFrame, weights: dict[str, int], budget: int | None, max_epochs: int, seed: int) -> DataFrame:
    """rows (k1, k2, id, domain, lang, source, tokens), a scratch table -> its columns and ``copies`` (at least 1)."""
    if max_epochs < 1 or any(w < 0 for w in weights.values()):
        raise ValueError("max_epochs must be at least 1 and weights mustn't be negative")
    path = ["domain", "lang", "source"]
    rows = rows.filter("tokens > 0")
    leaves = scratch(rows.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")), "leaves")
    have, n = leaves.agg(F.sum("tokens"), F.sum("n_rows")).first()
    shares = scratch(allocate(leaves, weights, have or 0 if budget is None else budget, max_epochs), "shares").select(
        *path, "n_rows", F.expr("share div tokens").alias("epochs"), (F.col("share") % F.col("tokens")).alias("rest")
    )
    epoch = join_by_weight(rows, shares, path, "n_rows", n or 0, "inner").withColumn(
        "order_", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("id")).cast("binary"))
    )
    epoch = scratch(epoch.withColumn("bucket", F.substring("order_", 1, BUCKET_DIGITS)), "epoch")
    sums = epoch.groupBy(*path, "bucket", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(W.partitionBy(*path).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    cuts = (
        sums.withColumn("upto", upto)
        .filter("upto > rest")
        .groupBy(*path)
        .agg(F.min("bucket").alias("cut"), F.min_by(F.col("upto") - F.col("tokens"), "bucket").alias("before"))
        .join(shares.select(*path, "n_rows"), path)
    )
    cuts = scratch(cuts, "cuts")
    met = join_by_weight(epoch, cuts, path, "n_rows", n or 0, "inner")
    away = met.filter("bucket <> cut").withColumn("in_", F.col("bucket") < F.col("cut"))
    own = F.lpad(F.hex("k1"), 16, "0")
    edge = scratch(met.filter("bucket = cut").withColumn("sub", F.concat("order_", F.substring(own, 1, BUCKET_DIGITS))), "edge")
    sums = edge.groupBy(*path, "sub", "rest", "before").agg(F.sum("tokens").alias("tokens"))
    upto = F.col("before") + F.sum("tokens").over(W.partitionBy(*path).orderBy("sub").rowsBetween(W.unboundedPreceding, W.currentRow))
    subs = (
        sums.withColumn("upto", upto)
        .filter("upto > rest")
        .groupBy(*path)
        .agg(F.min("sub").alias("sub_cut"), F.min_by(F.col("upto") - F.col("tokens"), "sub").alias("sub_before"))
    )
    edge = edge.join(scratch(subs, "sub-cuts"), path)
    cum = F.sum("tokens").over(W.partitionBy(*path).orderBy("order_", own, "k2").rowsBetween(W.unboundedPreceding, W.currentRow))
    here = edge.filter("sub = sub_cut").withColumn("in_", F.col("sub_before") + cum <= F.col("rest"))
    edge = edge.filter("sub <> sub_cut").withColumn("in_", F.col("sub") < F.col("sub_cut")).unionByName(here).select(*away.columns)
    out = away.unionByName(edge).withColumn("copies", F.col("epochs") + F.col("in_").cast("long"))
    return out.filter("copies > 0").select("k1", "k2", "id", *path, "tokens", "copies")


def leaf_rows(docs: DataFrame, domain: Column, lang: Column, source: Column, tokens: Column, id_col: Column) -> DataFrame:
    """The table that ``choose`` takes; k1 and k2 hash the whole row, so that it is found again even without an id."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return scratch(
        docs.select(
            *row_keys(docs), text(id_col).alias("id"),
            text(domain).alias("domain"), text(lang).alias("lang"), text(source).alias("source"), tokens.alias("tokens"),
        ),
        "leaf-rows",
    )


def mix(docs: DataFrame, weights: dict[str, int], budget: int | None = None, max_epochs: int = 2, seed: int = 0, domain: Column | None = None, lang: str = "lang", source: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, domain, lang, source, tokens, copies): the chosen documents and how often each is read.

    ``budget`` is in words; None stands for the words of the whole table. Cases: a null domain, lang or source is the
    empty name; documents without words have nothing to give and are never chosen; of rows with the same id each is
    weighed by itself, in the order of their hashes; an empty table gives an empty result; a leaf of weight 0 gets
    nothing.
    """
    rows = leaf_rows(docs, F.lit("") if domain is None else domain, F.col(lang), F.col(source), count_words(F.col(text)), F.col(id_col))
    return choose(rows, weights, budget, max_epochs, seed).drop("k1", "k2")


def mix_rows(docs: DataFrame, weights: dict[str, int], budget: int | None = None, max_epochs: int = 2, seed: int = 0, domain: Column | None = None, lang: str = "lang", source: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` themselves, each as many times as ``mix`` chooses it; the cases are those of ``mix``.

    Rows are found again by two hashes of all their columns, null flags included, so extra columns of any name are
    carried along; equal rows stand for each other.
    """
    rows = leaf_rows(docs, F.lit("") if domain is None else domain, F.col(lang), F.col(source), count_words(F.col(text)), F.col(id_col))
    chosen = scratch(
        choose(rows, weights, budget, max_epochs, seed)
        .groupBy("k1", "k2")
        .agg(F.sum("copies").alias("copies"), F.count("*").alias("n_equal")),
        "chosen",
    )
    whole = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*whole).alias("row_"), *row_keys(docs))
    equal = rows.groupBy("k1", "k2").agg(F.count("*").alias("n_equal")).filter("n_equal > 1").select("k1", "k2")
    met = keyed.join(chosen, ["k1", "k2"])
    if equal.limit(1).count():
        equal = scratch(equal, "equal")
        met = met.join(equal, ["k1", "k2"], "left_anti").unionByName(met.join(equal, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return met.select("row_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row_.*")
