"""Helpers shared by the corpus operators: scratch tables, ASCII text columns and joins that survive hot keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it, as a Java/Python character class body.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key that holds at least 1/HEAVY_SHARE of all rows is "heavy"; there can be at most HEAVY_SHARE of those,
#: which is what bounds the broadcast in ``join_by_weight``.
HEAVY_SHARE = 4096

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a folder of our own only where that is unset in local mode."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="echoquorum-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path, not used before, in the shared folder."""
    return f"{shared_root(spark)}/echoquorum/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, path: str) -> str:
    """Create a folder through Hadoop's file systems; its full URI."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(p)
    return system.makeQualified(p).toUri().toString()


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what follows rereads the files, whichever executor wrote them. The frame returned
    remembers its folder, so that ``drop_scratch`` can remove it once nothing reads it any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_scratch(*frames: DataFrame) -> None:
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives back the memory that its Python worker has freed but still holds."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Scratch paths written within each open ``scratch_scope``.
_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the scratch tables written within it; what is needed later must be stored elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same on pure ASCII and is much faster than ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(c: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), "")


def join_by_weight(big: DataFrame, lookup: DataFrame, on: list[str], weight: str, total: int, how: str = "left", heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """Join ``lookup`` (unique on ``on``; ``weight`` = rows of ``big`` with that key) to ``big``, which may be skewed.

    Keys with at least total/heavy_share rows, at most heavy_share of them, are broadcast. No other key can hold
    more than that share, so the rest is an ordinary shuffled join without a hot partition. ``how`` is "left" or
    "inner". ``big`` is read twice: pass a scratch table or a plain scan.
    """
    floor = max(2, -(-total // heavy_share))
    (flag,) = fresh(big, "heavy_")
    heavy = lookup.filter(F.col(weight) >= floor).drop(weight).withColumn(flag, F.lit(True))
    light = lookup.filter(F.col(weight) < floor).drop(weight)
    marked = big.join(F.broadcast(heavy), on, "left")
    hot = marked.filter(F.col(flag)).drop(flag)
    rest = marked.filter(F.col(flag).isNull()).select(*big.columns).join(light, on, how)
    return hot.unionByName(rest.select(*hot.columns))


def mark_by_weight(big: DataFrame, lookup: DataFrame, on: list[str], weight: str, total: int, salt: Column, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """The rows of ``big`` whose key is in ``lookup``, as ``join_by_weight`` divides the keys, with ``big`` read once.

    All rows meet the heavy keys by a broadcast join and the light keys by a shuffled one; there the rows of heavy keys,
    which match nothing, are dealt out by ``salt`` (whole numbers), so that none of them makes a hot partition.
    """
    floor = max(2, -(-total // heavy_share))
    heavy_, light_, deal = fresh(big, "heavy_", "light_", "deal_")
    heavy = lookup.filter(F.col(weight) >= floor).select(*on, F.lit(True).alias(heavy_))
    light = lookup.filter(F.col(weight) < floor).select(*on, F.lit(0).alias(deal), F.lit(True).alias(light_))
    marked = big.join(F.broadcast(heavy), on, "left")
    marked = marked.withColumn(deal, F.when(F.col(heavy_), 1 + F.pmod(salt, F.lit(1 << 20)).cast("int")).otherwise(0))
    met = marked.join(light, [*on, deal], "left")
    return met.filter(F.col(heavy_) | F.col(light_)).select(*big.columns)


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a whole row. A column's null flag goes along with its value, as xxhash64 passes over nulls."""
    whole = [x for c in docs.columns for x in (F.isnull(f"`{c}`"), F.col(f"`{c}`"))]
    return F.xxhash64(F.lit(1), *whole).alias("k1"), F.xxhash64(F.lit(2), *whole).alias("k2")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that don't clash with any column of ``df`` (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
