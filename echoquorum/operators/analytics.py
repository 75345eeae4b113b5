"""The catalogue's analytics: counts, breakdowns, rankings, series and histograms. Plain DataFrame operators.

Rankings end with the key, so that ties have one order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schema as S
from ..functions import scalar as fn

E = S.EPISODE


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def breakdown(df: DataFrame, by: str) -> DataFrame:
    """Counts by a column, the largest first."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by)


def table_sort(df: DataFrame, column: str, descending: bool = False, key: tuple[str, ...] = ()) -> DataFrame:
    """A table by one of its columns: numbers by value, strings without regard to case; nulls last; ties by ``key``."""
    c = F.lower(column) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *key)


def sparkline(series: DataFrame) -> DataFrame:
    """(day, n, total) of one series of days with the running total; nothing if it has fewer than two days."""
    # A row a day: the window is over a bounded table.
    enough = series.agg(F.count("*").alias("days_")).filter("days_ >= 2")
    running = F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow))
    return series.crossJoin(F.broadcast(enough)).drop("days_").withColumn("total", running)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n"))


def promotable(contributions: DataFrame) -> DataFrame:
    """Waiting rows that pass; rows from network discs count here although promotion leaves them out."""
    return total(contributions.filter(F.col("promoted_at").isNull() & (F.col("poison_check") == "pass") & (F.col("match_confidence") >= S.MIN_CONFIDENCE)))


def confidence_by_tier(canonical: DataFrame) -> DataFrame:
    c = "mean_confidence"
    return canonical.groupBy("tier").agg(F.avg(c).alias("avg_conf"), F.min(c).alias("min_conf"), F.max(c).alias("max_conf"))


def by_day(df: DataFrame, at: str, *also: str) -> DataFrame:
    return df.groupBy(fn.day(F.col(at)).alias("day"), *also).agg(F.count("*").alias("n"))


def overlap_stats(observations: DataFrame) -> DataFrame:
    c = "max_overlap_pct"
    return observations.agg(F.count("*").alias("n"), F.coalesce(F.avg(c), F.lit(0.0)).alias("avg_overlap"), F.coalesce(F.max(c), F.lit(0.0)).alias("max_overlap"))


def shows(canonical: DataFrame) -> DataFrame:
    tiers = [F.count_if(F.col("tier") == t).alias(t) for t in reversed(S.TIERS)]
    return canonical.groupBy("tmdb_id").agg(F.count("*").alias("episodes"), *tiers, F.avg("mean_confidence").alias("avg_conf"))


def top(df: DataFrame, order: list[str], key: list[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order], *key).limit(n)


def named(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names, "tmdb_id", "left").withColumn("name", fn.show_name(F.col("name"), F.col("tmdb_id")))


def find_shows(named_shows: DataFrame, text: str) -> DataFrame:
    """Shows whose name, or tmdb:id, holds the text; case and outer white space don't matter."""
    q = text.strip().lower()
    return named_shows.filter(F.lower("name").contains(q) | F.concat(F.lit("tmdb:"), F.col("tmdb_id").cast("string")).contains(q))


def show_detail(canonical: DataFrame, sketches: DataFrame, contributions: DataFrame, tmdb_id: int) -> DataFrame:
    if not isinstance(tmdb_id, int) or tmdb_id <= 0:
        raise ValueError("tmdb_id must be a positive whole number")
    one = F.col("tmdb_id") == tmdb_id
    n = contributions.filter(one).groupBy("season", "episode").agg(F.count("*").alias("contributions"))
    out = canonical.filter(one).join(sketches.filter(one).select(*E, "hash_count"), E, "left").join(n, ["season", "episode"], "left")
    return out.select(
        "season", "episode", "tier", "mean_confidence", "unique_contributors", "promoted_at",
        F.coalesce("hash_count", F.lit(0)).alias("hash_count"), F.coalesce("contributions", F.lit(0)).alias("contributions"),
    )


def show_tier_summary(canonical: DataFrame, tmdb_id: int) -> DataFrame:
    return canonical.filter(F.col("tmdb_id") == tmdb_id).groupBy("tier").agg(F.count("*").alias("n"), F.avg("mean_confidence").alias("avg_conf"))


def tier_page(canonical: DataFrame, sketches: DataFrame, tier: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of a tier's episodes; ``has_more`` on each row says whether the page is full."""
    if tier not in S.TIERS:
        raise ValueError(f"tier must be one of {S.TIERS}")
    limit, offset = S.clamp_page(limit, offset)
    page = canonical.filter(F.col("tier") == tier).orderBy(*E).offset(offset).limit(limit)
    out = page.join(sketches.select(*E, "hash_count"), E, "left")
    full = F.count("*").over(W.partitionBy(F.lit(0))) == limit  # at most 500 rows
    return out.select(*E, "mean_confidence", "unique_contributors", "promoted_at", F.coalesce("hash_count", F.lit(0)).alias("hash_count"), full.alias("has_more"))


def flagged_activity(contributions: DataFrame, contributors: DataFrame) -> DataFrame:
    out = contributions.join(contributors.filter("flagged = 1").select("pseudonym"), "pseudonym", "left_semi")
    return out.agg(F.count("*").alias("total"), F.count_if(F.col("poison_check") == "pass").alias("passed"), F.count_if(F.col("promoted_at").isNotNull()).alias("promoted"))


def confidence_histogram(discs: DataFrame) -> DataFrame:
    bucket = F.least(F.lit(19), F.floor(F.round(F.col("mean_confidence") * 20, 9)).cast("int"))
    return discs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def filled_histogram(histogram: DataFrame) -> DataFrame:
    """Every bucket from the lowest to the highest, zero where there is none."""
    span = histogram.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).filter("lo IS NOT NULL")
    return span.select(F.explode(F.sequence("lo", "hi")).alias("bucket")).join(histogram, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def top_disc_shows(discs: DataFrame, n: int = 20) -> DataFrame:
    out = discs.groupBy("tmdb_id").agg(F.count_distinct("disc_content_hash").alias("discs"), F.count("*").alias("contributions"), F.count_distinct("pseudonym").alias("contributors"))
    return top(out, ["discs", "contributions"], ["tmdb_id"], n)


def growth(series: dict[str, DataFrame], cumulative: bool = True, since: str | None = None) -> DataFrame:
    """Series (day, n) side by side on all their days; running totals count from the first day even if only the days
    from ``since`` are shown. If no day is that late, all are shown. Rows without a day are left out."""
    long = reduce(DataFrame.unionByName, [df.filter("day IS NOT NULL").select("day", F.lit(name).alias("s"), "n") for name, df in series.items()])
    out = long.groupBy("day").pivot("s", list(series)).agg(F.sum("n")).fillna(0, list(series))
    if cumulative:  # a row for each calendar day
        w = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
        out = out.withColumns({s: F.sum(s).over(w) for s in series})
    if since is not None:
        last = F.max("day").over(W.partitionBy(F.lit(0)))
        out = out.withColumn("last_", last).filter((F.col("day") >= since) | (F.col("last_") < since)).drop("last_")
    return out


def trailing_sum(series: DataFrame, asof: str, days: int) -> DataFrame:
    """Sum over the days from ``days`` days before ``asof`` on, that day included."""
    cutoff = F.date_sub(F.lit(asof).cast("date"), days).cast("string")
    return series.agg(F.coalesce(F.sum(F.when(F.col("day") >= cutoff, F.col("n"))), F.lit(0)).alias("n"))


def episode_grid(canonical: DataFrame) -> DataFrame:
    """Every episode from 1 to the season's last for each show, with its tier or "missing"."""
    last = canonical.groupBy("tmdb_id", "season").agg(F.max("episode").alias("last")).filter("last > 0")
    every = last.select("tmdb_id", "season", F.explode(F.sequence(F.lit(1), "last")).alias("episode"))
    return every.join(canonical.select(*E, "tier"), E, "left").withColumn("tier", F.coalesce("tier", F.lit("missing")))


def verdict_share(contributions: DataFrame) -> DataFrame:
    """All four verdicts with their number and share of the rows."""
    spark = contributions.sparkSession
    fixed = spark.createDataFrame([(i, v) for i, v in enumerate(S.VERDICTS)], "place int, poison_check string")
    counts = breakdown(contributions, "poison_check")
    out = fixed.join(counts, "poison_check", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", fn.share(F.col("n"), F.sum("n").over(W.partitionBy(F.lit(0)))))  # four rows


def funnel(contributions: DataFrame, canonical: DataFrame) -> DataFrame:
    """Contributions, episodes and the tiers' shares of the episodes; pass_rate is null without contributions."""
    c = contributions.agg(F.count("*").alias("contributions"), F.count_if(F.col("poison_check") == "pass").alias("passed"))
    t = canonical.agg(F.count("*").alias("episodes"), *[F.count_if(F.col("tier") == x).alias(x) for x in S.TIERS])
    both = c.crossJoin(t)  # one row each
    return both.select(
        "contributions", "episodes", F.try_divide("passed", "contributions").alias("pass_rate"),
        *[fn.share(F.col(x), F.col("episodes")).alias(f"{x}_share") for x in S.TIERS],
    )


def show_ids(*tables: DataFrame) -> DataFrame:
    """Distinct show ids of the tables in ascending order, zero left out."""
    return reduce(DataFrame.union, [t.select("tmdb_id") for t in tables]).filter("tmdb_id <> 0").distinct().orderBy("tmdb_id")
