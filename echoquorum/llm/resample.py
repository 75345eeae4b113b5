"""Operator 12, importance resampling toward a target distribution. DataFrame functions only.

A text's features are its runs of one to three words, hashed into buckets. A bucket's gain compares its share of the
target's features with its share of the corpus's; a document weighs the sum of its features' gains. Scoring doesn't
explode: higher-order functions make each document's array of buckets, which is written once, and the weight is an
aggregate over the array that looks each gain up in a literal array. Only the buckets' totals are shuffled, a row a bucket and task at most,
beside the narrow rows (id, score) that the draw puts in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, drop_scratch, scratch

#: Characters that separate words: all ASCII but letters and digits (the text is lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N_BUCKETS, MAX_RUN = 10_000, 3


def feature_words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def bucketed(docs: DataFrame, keep: list[str], text: str, n_buckets: int = N_BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """(keep, n_words, buckets): the bucket, from 0, of every run of one to ``max_run`` consecutive words, repeats included.

    Each array has a projection of its own, so that none is computed for every use that the next ones make of it.
    """
    out = docs.select(*[F.col(f"`{c}`") for c in keep], feature_words(F.col(f"`{text}`")).alias("run_1"))
    pair = lambda a, b: F.concat(a, F.lit(" "), b)
    for k in range(2, max_run + 1):
        # The run that begins at a word, and the word that ends the longer run; the last k - 1 runs have none and are cut off.
        n = F.greatest(F.size("run_1") - (k - 1), F.lit(0))
        out = out.withColumn(f"run_{k}", F.slice(F.zip_with(f"run_{k - 1}", F.slice("run_1", F.lit(k), n), pair), F.lit(1), n))
    every = F.concat(*[F.col(f"run_{k}") for k in range(1, max_run + 1)])
    return out.select(*keep, F.size("run_1").cast("long").alias("n_words"), F.transform(every, lambda f: (F.crc32(f.cast("binary")) % n_buckets).cast("int")).alias("buckets"))


def totals(rows: DataFrame) -> DataFrame:
    """(bucket, n): features in each bucket that has any. ``rows`` are read, not computed: a filter on the array's size goes below."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> list[int]:
    """1,000 times the logarithm of the smoothed ratio of shares, a whole number for each bucket; ``n_buckets`` rows."""
    every = corpus.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    met = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    met = met.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    sums = met.agg(F.sum("s").alias("sum_s"), F.sum("t").alias("sum_t"))
    ratio = ((F.col("t") + 1) * (F.col("sum_s") + n_buckets)) / ((F.col("s") + 1) * (F.col("sum_t") + n_buckets))
    gain = F.floor(1000 * F.log(ratio)).cast("long").alias("gain")
    return [r.gain for r in met.crossJoin(F.broadcast(sums)).select("bucket", gain).orderBy("bucket").collect()]


def literal(values: list[int]) -> Column:
    """An array of whole numbers that the plan holds as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def noise(doc_id: Column, seed: int) -> Column:
    """Whole-numbered Gumbel noise of a document: that of its place among 2^32 by a hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place_``, their number in ``order`` from 1, gapless; no task holds more than its range of the order.

    The rows are sorted by ranges and written; a row's place is its number in its range after the sizes of the ranges before,
    of which there are no more than partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    ordered = scratch(ordered, "ordered").withColumns({"part_": F.shiftright("at_", 33), "in_": F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ordered.groupBy("part_").agg(F.count("*").alias("size_"))
    before = sizes.select("part_", (F.sum("size_").over(W.orderBy("part_")) - F.col("size_")).alias("before_"))
    return ordered.join(F.broadcast(before), "part_").withColumn("place_", F.col("before_") + F.col("in_") + 1).drop("at_", "part_", "in_", "before_")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text: str = "text", target_text: str = "text", n_buckets: int = N_BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """Draw ``percent`` of the documents that have ``min_words`` words or more, without replacement, by weight and noise.

    Returns for every row of ``docs`` its id, n_features, weight (the sum of its features' gains, 0 for none), score (weight
    and Gumbel noise of its id) and rank, from 1 in the order of the drawn, null for a row that isn't drawn. Ties in score
    go to the smaller id, a null id last; rows that share an id have the same noise, and equal ones are ranked in any
    order. A null or empty text has no features. An empty table gives an empty result; with an empty target all gains come
    from the corpus alone. Other columns play no part.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = scratch(bucketed(src, ["doc_id"], "text", n_buckets, max_run), "buckets")
    goal = scratch(bucketed(target.select(F.col(f"`{target_text}`").alias("text")), [], "text", n_buckets, max_run), "target")
    table = literal(gains(totals(rows), totals(goal), n_buckets))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))
    scored = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("out_", F.col("n_words") < min_words)
    placed = numbered(scored, [F.col("out_"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")])
    quota = placed.filter("NOT out_").agg(F.floor(F.count("*") * percent / 100)).first()[0]
    drawn = ~F.col("out_") & (F.col("place_") <= quota)
    drop_scratch(rows, goal)  # what follows reads the written order
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place_")).alias("rank"))
