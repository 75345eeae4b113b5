"""MinHash sketches of 128 slots, and the fingerprint codec; Arrow functions over numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from . import scalar

LONGS, BYTES = T.ArrayType(T.LongType()), T.BinaryType()

SLOTS = 128
#: Seed of the generator of the 128 linear maps, zstd level of stored fingerprints.
SEED = 0x12345678
LEVEL = 11


@cache
def coefficients() -> tuple[np.ndarray, np.ndarray]:
    """The odd factors and the addends of the linear maps, drawn in turns from a 32-bit xorshift."""

    def stream(x: int):
        while True:
            for shift in (13, -17, 5):
                x ^= (x << shift) & 0xFFFFFFFF if shift > 0 else x >> -shift
            yield x

    drawn = stream(SEED)
    pairs = [(next(drawn) | 1, next(drawn)) for _ in range(SLOTS)]
    return tuple(np.array(c, np.uint32) for c in zip(*pairs))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """128 uint32 slots; all ones for an empty fingerprint."""
    a, b = coefficients()
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    x = mixed(np.unique(np.asarray(hashes, np.int64)))
    for i in range(0, len(x), 4096):
        out = np.minimum(out, (x[i : i + 4096, None] * a + b).min(axis=0))
    return out


@F.pandas_udf(LONGS)
def minhash128(hashes: pd.Series) -> pd.Series:
    """Sketch of a fingerprint (array of bigint); null for null."""
    return hashes.map(lambda h: None if h is None else minhash(h).astype(np.int64))


@F.pandas_udf(BYTES)
def pack_sketch(slots: pd.Series) -> pd.Series:
    """512 bytes, little-endian."""
    return slots.map(lambda s: None if s is None else np.asarray(s).astype("<u4").tobytes())


@F.pandas_udf(LONGS)
def unpack_sketch(raw: pd.Series) -> pd.Series:
    """Slots of a 512-byte sketch; null for any other length."""
    return raw.map(lambda r: np.frombuffer(r, "<u4").astype(np.int64) if r is not None and len(r) == 4 * SLOTS else None)


def native_minhash(exploded: DataFrame, keys: list[str], h: str = "h") -> DataFrame:
    """The same sketch from rows (keys, h) by DataFrame functions alone: (keys, slot, v). Slower; a cross-check."""
    maps = coefficient_table(exploded.sparkSession)
    x = exploded.select(*keys, scalar.fmix32(F.col(h)).alias("x")).distinct()
    low = F.col("x").bitwiseAND(F.lit(0xFFFF)) * F.col("a")
    high = (F.shiftright("x", 16) * F.col("a")).bitwiseAND(F.lit(0xFFFF)) * 65536
    v = (low + high + F.col("b")).bitwiseAND(F.lit(0xFFFFFFFF))
    return x.crossJoin(F.broadcast(maps)).groupBy(*keys, "slot").agg(F.min(v).alias("v"))


def to_varints(hashes: np.ndarray) -> bytes:
    """LEB128: seven bits a byte, the lowest first."""
    v = np.asarray(hashes, np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    digits = (v[:, None] >> (np.uint64(7) * np.arange(5, dtype=np.uint64))) & np.uint64(127)
    n = np.maximum(1, 5 - (digits[:, ::-1] != 0).argmax(axis=1))
    n[v == 0] = 1
    at = np.arange(5)
    more = at < (n - 1)[:, None]
    return ((digits | (more * np.uint64(128))).astype(np.uint8))[at < n[:, None]].tobytes()


def from_varints(raw: bytes) -> np.ndarray:
    """Values of LEB128 bytes. More than five bytes for a value is an error; an unfinished last value is dropped."""
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    tail = len(b) - (ends[-1] + 1 if len(ends) else 0)
    if (len(ends) and (ends - starts).max() > 4) or tail > 5:
        raise ValueError("varint of more than five bytes")
    b = b[: ends[-1] + 1] if len(ends) else b[:0]
    if not len(b):
        return np.zeros(0, np.int64)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)


def encode(hashes: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL).compress(to_varints(hashes))


def decode(blob: bytes) -> np.ndarray:
    import zstandard

    return from_varints(zstandard.ZstdDecompressor().decompressobj().decompress(blob))


def _decoded(blob: bytes | None) -> np.ndarray | None:
    import zstandard

    try:
        return None if blob is None else decode(blob)
    except (ValueError, zstandard.ZstdError):
        return None


@F.pandas_udf(BYTES)
def varints(hashes: pd.Series) -> pd.Series:
    """The bytes of a fingerprint before they are compressed."""
    return hashes.map(lambda h: None if h is None else to_varints(h))


@F.pandas_udf(BYTES)
def encode_fingerprint(hashes: pd.Series) -> pd.Series:
    return hashes.map(lambda h: None if h is None else encode(h))


@F.pandas_udf(LONGS)
def decode_fingerprint(blob: pd.Series) -> pd.Series:
    """Hashes of a stored fingerprint; null for a malformed one, so that one bad blob fails no job."""
    return blob.map(_decoded)


#: Fingerprints that are coded at once in ``round_trips``.
ROUND_TRIPS = 256


def round_trips(fingerprints: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, bytes, same): the hashes of each fingerprint, the bytes it takes when stored, and whether it is read back as it was.

    One worker a task encodes, decodes and compares, some fingerprints at a time, and no fingerprint leaves it. Nulls for a null one, which is the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROUND_TRIPS):
                part = batch.slice(begin, ROUND_TRIPS)
                lists = part.column(part.num_columns - 1)
                hashes, at = lists.values, lists.offsets.to_pylist()
                sizes, same = [], []
                for here, i, j in zip(lists.is_valid().to_pylist(), at[:-1], at[1:]):
                    h = hashes.slice(i, j - i).to_numpy(zero_copy_only=False) if here else None
                    blob = None if h is None else encode(h)
                    sizes.append(None if h is None else len(blob))
                    same.append(h is None or np.array_equal(_decoded(blob), h))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes, pa.int32()), pa.array(same, pa.bool_())], names=[*keys, "n", "bytes", "same"])

    src = fingerprints.select(*keys, F.size("hashes").alias("n"), "hashes")
    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], T.StructField("bytes", T.IntegerType()), T.StructField("same", T.BooleanType())]))


def coefficient_table(spark: SparkSession) -> DataFrame:
    a, b = coefficients()
    return spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))], "slot int, a long, b long")
