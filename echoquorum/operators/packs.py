"""Packs: per show, the canonical episodes' fingerprints and their document frequencies as compressed JSON lines.

A pack is made as a stream. Its text comes in pieces (the header, a line for each episode, an item for each hash), which are
sorted by ranges of (show, place) and compressed one after the other into frames of bounded size; a pack is its frames
end to end. No show's lines or hashes are ever brought together in one row or one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..functions import sketch
from .identify import document_frequency

WIRE_VERSION, PACK_VERSION = 1, 2
#: Bytes of text of a frame.
FRAME_BYTES = 1 << 20


def pack_df(canonical: DataFrame) -> DataFrame:
    """(tmdb_id, h, df) over each show's canonical episodes (tmdb_id, season, episode, tier, hashes)."""
    return document_frequency(canonical.filter("tier = 'canonical'"), ["tmdb_id"])


def pack_pieces(canonical: DataFrame, asof: int) -> DataFrame:
    """(tmdb_id, part, season, episode, h, text): the pieces of all packs, ordered within a show by part and key.

    Part 0 is the header and 1 the episodes, lines each; 2 are the items of the last line and 3 its end. The first item has the
    line's beginning before it, the others a comma.
    """
    own = canonical.filter("tier = 'canonical'").withColumn("blob", sketch.encode_fingerprint("hashes"))
    n = own.groupBy("tmdb_id").agg(F.count("*").cast("int").alias("n_episodes"))
    zero, none = F.lit(0), F.lit(-1).cast("long")
    place = lambda part, season=zero, episode=zero, h=none: [F.lit(part).alias("part"), season.alias("season"), episode.alias("episode"), h.alias("h")]
    header = n.select(
        "tmdb_id", *place(0),
        F.to_json(F.struct(F.lit(WIRE_VERSION).alias("wire_format_version"), F.lit(PACK_VERSION).alias("pack_format_version"), "tmdb_id", "n_episodes", F.lit(asof).alias("generated_at"))).alias("text"),
    )
    episodes = own.select(
        "tmdb_id", *place(1, F.col("season"), F.col("episode")),
        F.to_json(F.struct("season", "episode", fn.to_base64(F.col("blob")).alias("fingerprint_b64"))).alias("text"),
    )
    df = pack_df(canonical)
    begin = F.concat(F.lit('{"kind":"df","n_episodes":'), F.col("n_episodes").cast("string"), F.lit(',"df":['))
    first = df.groupBy("tmdb_id").agg(F.min("h").alias("h")).join(n, "tmdb_id").select("tmdb_id", "h", begin.alias("begin"))
    item = F.concat(F.coalesce("begin", F.lit(",")), F.lit("["), F.col("h").cast("string"), F.lit(","), F.col("df").cast("string"), F.lit("]"))
    items = df.join(first, ["tmdb_id", "h"], "left").select("tmdb_id", *place(2, h=F.col("h")), item.alias("text"))
    empty = n.join(first.select("tmdb_id"), "tmdb_id", "left_anti").select("tmdb_id", *place(2), begin.alias("text"))
    ends = n.select("tmdb_id", *place(3), F.lit("]}").alias("text"))
    return header.unionByName(episodes).unionByName(items).unionByName(empty).unionByName(ends)


def pack_frames(pieces: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(tmdb_id, at, frame): compressed frames, in the order of ``at`` within a show. A task holds one frame's text."""
    order = ["tmdb_id", "part", "season", "episode", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        first = TaskContext.get().partitionId() << 32
        show, text, size, n = None, [], 0, 0

        def frame() -> pa.RecordBatch:
            body = zstandard.ZstdCompressor(level=sketch.LEVEL).compress("".join(text).encode())
            return pa.RecordBatch.from_arrays([pa.array([show], pa.int64()), pa.array([first + n], pa.int64()), pa.array([body], pa.binary())], names=["tmdb_id", "at", "frame"])

        for b in batches:
            for tmdb_id, part, t in zip(b.column("tmdb_id").to_pylist(), b.column("part").to_pylist(), b.column("text").to_pylist()):
                if text and (tmdb_id != show or size >= frame_bytes):
                    yield frame()
                    text, size, n = [], 0, n + 1
                show = tmdb_id
                text.append(t + "\n" if part < 2 else t)
                size += len(text[-1])
        if text:
            yield frame()

    return pieces.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "tmdb_id long, at long, frame binary")


def pack_objects(canonical: DataFrame, asof: int) -> DataFrame:
    """(tmdb_id, name, n_episodes, generated_at): the name and the metadata of each pack."""
    n = canonical.filter("tier = 'canonical'").groupBy("tmdb_id").agg(F.count("*").cast("string").alias("n_episodes"))
    return n.select("tmdb_id", F.concat(F.col("tmdb_id").cast("string"), F.lit(".zstd")).alias("name"), "n_episodes", F.lit(str(asof)).alias("generated_at"))


def write_packs(canonical: DataFrame, path: str, asof: int, frame_bytes: int = FRAME_BYTES) -> None:
    """Packs as a Parquet table partitioned by show: a show's frames are read without touching the others."""
    pack_frames(pack_pieces(canonical, asof), frame_bytes).write.mode("overwrite").partitionBy("tmdb_id").parquet(path)


def frames_of(spark: SparkSession, path: str, tmdb_id: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("tmdb_id") == tmdb_id).select("at", "frame")


def pack_tag(spark: SparkSession, path: str, tmdb_id: int) -> str | None:
    """A show's pack as a tag that changes with its bytes, None if it has none; some 40 bytes of each frame are gathered."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("at", F.md5("frame").alias("m")))), lambda x: x["m"])
    row = frames_of(spark, path, tmdb_id).agg(F.count("*").alias("n"), F.md5(F.array_join(each, ",").cast("binary")).alias("tag")).first()
    return row.tag if row.n else None


def answer(spark: SparkSession, path: str, tmdb_id: int, known_tag: str | None = None) -> tuple[str, list[str] | None]:
    """("missing", None), ("not_modified", None) where the caller's tag still holds, or ("ok", lines)."""
    tag = pack_tag(spark, path, tmdb_id)
    if tag is None:
        return "missing", None
    return ("not_modified", None) if tag == known_tag else ("ok", read_pack(spark, path, tmdb_id))


def pack_stream(spark: SparkSession, path: str, tmdb_id: int) -> Iterator[bytes]:
    """A show's frames in order, one at a time: end to end they are the pack's body."""
    for row in frames_of(spark, path, tmdb_id).orderBy("at").toLocalIterator():
        yield bytes(row.frame)


def read_pack(spark: SparkSession, path: str, tmdb_id: int) -> list[str] | None:
    """Lines of one show's pack, None if it has none."""
    import zstandard

    text = b"".join(zstandard.ZstdDecompressor().decompressobj().decompress(f) for f in pack_stream(spark, path, tmdb_id))
    return text.decode().split("\n") if text else None
