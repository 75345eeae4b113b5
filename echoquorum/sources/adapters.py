"""The engine's tables over the driver's Parquet tables, and readers for the request formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalar as fn
from ..functions import sketch
from . import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contribution`` without fingerprints, from events."""
    e = table(spark, sf_dir, "events")
    i, movie = F.col("event_id"), F.col("event_id") % 10 == 0
    source = (
        F.when(F.col("event_type") == "error", S.NETWORK_DISC)
        .when(F.col("event_type") == "signup", S.BOOTSTRAP)
        .when(F.col("event_type") == "purchase", S.ASR)
        .when(F.col("event_type") == "view", S.DISCDB)
        .otherwise(S.USER_REVIEW)
    )
    out = e.select(
        i.alias("id"),
        fn.seconds(F.col("ts")).cast("long").alias("received_at"),
        F.col("user_id").cast("string").alias("pseudonym"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("tmdb_id"),
        F.when(~movie, (1 + F.floor(i / 10) % 2).cast("int")).alias("season"),
        F.when(~movie, (1 + F.floor(i / 20) % 5).cast("int")).alias("episode"),
        (0.5 + ((i * 37) % 51) / 100.0).alias("match_confidence"),
        source.alias("match_source"),
        F.when(i % 17 == 0, "flag_conflict").when(i % 23 == 0, "pending").otherwise("pass").alias("poison_check"),
        (F.col("user_id") % 7).alias("disc"),
    )
    # Some of the older votes have been processed already.
    return out.withColumn("promoted_at", F.when(fn.eligible() & (F.col("id") % 3 == 0), F.col("received_at") + 3600))


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contributions(spark, sf_dir)
    return c.groupBy("pseudonym").agg(
        F.min("received_at").alias("first_seen"),
        F.max("received_at").alias("last_seen"),
        F.count("*").alias("contribution_count"),
        F.max((F.col("pseudonym").cast("long") % 10 == 0).cast("int")).alias("flagged"),
        F.count_if(F.col("poison_check") == "flag_conflict").alias("flag_count"),
    )


def shingled(text: Column, k: int = 3) -> Column:
    """Fingerprint of a text: the 32-bit hashes of its k-word shingles (words at white space), in order."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")
    grams = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.zip_with(grams, F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.slice(grams, F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(0)))
    return F.transform(grams, fn.hash32)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tmdb_id, season, episode, hashes, sketch, hash_count): one episode for each document, stored once."""
    i = F.col("doc_id")

    def build() -> DataFrame:
        docs = store.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        rows = docs.select(
            (F.floor(i / 20) + 1).cast("long").alias("tmdb_id"),
            (F.floor((i % 20) / 10) + 1).cast("int").alias("season"),
            (i % 10 + 1).cast("int").alias("episode"),
            shingled(F.col("text")).alias("hashes"),
        )
        return rows.withColumns({"sketch": sketch.minhash128("hashes"), "hash_count": F.size("hashes")})

    return store.stored(spark, "catalogue", [f"{sf_dir}/documents.parquet"], build)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_, hashes_): the fingerprint of every document, stored once."""

    def build() -> DataFrame:
        docs = store.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        return docs.select(F.col("doc_id").alias("doc_"), shingled(F.col("text")).alias("hashes_"))

    return store.stored(spark, "fingerprints", [f"{sf_dir}/documents.parquet"], build)


def identify_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), shingled(F.col("text")).alias("hashes"))


#: Fingerprints that are broadcast at most.
BROADCAST_DOCUMENTS = 10_000


def fingerprinted(spark: SparkSession, sf_dir: str, votes: DataFrame) -> DataFrame:
    """votes (id, pseudonym, tmdb_id, season, episode, ...) with ``hashes``: each vote's own cut of its document."""
    docs = fingerprints(spark, sf_dir)
    n = docs.count()
    doc = (F.col("tmdb_id") * 20 + F.coalesce("season", F.lit(0)) * 10 + F.coalesce("episode", F.lit(0))) % max(n, 1)
    # A vote is a short row that gets a long fingerprint, so few splits of votes are too few for what follows.
    met = votes.repartition(8 * spark.sparkContext.defaultParallelism, "id").withColumn("doc_", doc)
    wanted = votes.select(doc.alias("doc_")).distinct()
    some = wanted.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS
    docs = docs.join(F.broadcast(wanted) if some else wanted, "doc_", "left_semi")
    met = met.join(F.broadcast(docs) if some else docs, "doc_")  # where few documents are voted on, no vote is shuffled by them
    own = F.col("pseudonym").cast("long")
    return met.select(*votes.columns, F.filter("hashes_", lambda h, i: (i + own) % 5 != 0).alias("hashes"))


def disc_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``disc_contribution`` with titles as an array, from orders; flagged is the contributor's."""
    o = table(spark, sf_dir, "orders")
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    shift = F.when((i % 4 == 0) & (c % 2 == 0), 1).otherwise(0)
    titles = F.transform(
        F.sequence(F.lit(0).cast("long"), c % 3),
        lambda t: F.struct(
            t.cast("int").alias("title_index"),
            (1200 + t * 60).cast("int").alias("duration_seconds"),
            (t * 1000000).cast("long").alias("size_bytes"),
            F.lit("episode").alias("assignment"),
            F.lit(1).alias("season"),
            (t + 1 + shift).cast("int").alias("episode"),
            (0.75 + ((i * 7 + t * 3) % 26) / 100.0).alias("match_confidence"),
            F.when((i + t) % 19 == 0, S.NETWORK_DISC).otherwise(S.DISCDB).alias("match_source"),
        ),
    )
    return o.select(
        i.alias("id"),
        fn.seconds(F.col("o_orderdate")).cast("long").alias("received_at"),
        (i % 97).cast("string").alias("pseudonym"),
        F.md5((c * 2 + (i % 7 == 0).cast("long")).cast("string").cast("binary")).alias("disc_content_hash"),
        (c % 200 + 1).alias("tmdb_id"),
        F.lit("tv").alias("content_type"),
        F.lit(1).alias("season"),
        titles.alias("titles"),
        ((i % 97) % 10 == 0).alias("flagged"),
        F.when(i % 3 == 0, fn.seconds(F.col("o_orderdate")).cast("long") + 86400).alias("promoted_at"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``overlap_observation``: a stored figure for each contribution that isn't pending."""
    return contributions(spark, sf_dir).filter("poison_check <> 'pending'").select(
        F.col("id").alias("contribution_id"), ((F.col("id") * 13 % 101) / 100.0).alias("max_overlap_pct")
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tmdb_id, name) of the shows that have a name."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tmdb_id"), F.col("p_name").alias("name")).filter("tmdb_id % 4 <> 0")


def with_unreadable(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(S.UNREADABLE, T.StringType())])


def parsed(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """``lines`` with the fields of the JSON requests in ``column`` in place of it, unreadable ones with their text, as the readers have it."""
    read = F.from_json(F.col(column), with_unreadable(schema), {"columnNameOfCorruptRecord": S.UNREADABLE})
    return lines.withColumn("r_", read).select(*[F.col(f"`{c}`") for c in lines.columns if c != column], "r_.*")


def read_contribution_json(spark: SparkSession, path: str) -> DataFrame:
    """Contribution requests, one JSON object a line. Lines that are no object, or whose values have other types, keep their
    text in ``_corrupt_record``, and fail validation."""
    return spark.read.schema(with_unreadable(S.CONTRIBUTION_REQUEST)).option("columnNameOfCorruptRecord", S.UNREADABLE).json(path)


def read_disc_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(with_unreadable(S.DISC_REQUEST)).option("columnNameOfCorruptRecord", S.UNREADABLE).json(path)


def stream_json(spark: SparkSession, path: str, schema: T.StructType, max_files: int) -> DataFrame:
    """Requests from the JSON files that come to a folder, with the text of unreadable ones and ``ts``, the arrival of their file."""
    read = spark.readStream.schema(with_unreadable(schema)).option("columnNameOfCorruptRecord", S.UNREADABLE).option("maxFilesPerTrigger", max_files)
    return read.json(path).withColumn("ts", F.col("_metadata.file_modification_time"))


def read_seed_json(spark: SparkSession, path: str) -> DataFrame:
    """Seed files {"episodes": [...]} -> a row for each episode."""
    whole = T.StructType().add("episodes", T.ArrayType(S.SEED))
    return spark.read.schema(whole).option("multiLine", True).json(path).select(F.explode("episodes").alias("e")).select("e.*")


