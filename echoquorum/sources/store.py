"""Derived tables that are written once and read by every later query: fingerprints and sketches of the catalogue.

A table lies in the folder that the cluster shares (spark.checkpoint.dir) under a name made of its inputs' paths, sizes
and times and of the code that makes it, so a change of either gives a new table.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, reduce
from math import ceil
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as file_systems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

_own_root: str | None = None


def root(spark: SparkSession) -> str:
    """The shared folder; a folder of our own only where none is set and all runs on this machine."""
    global _own_root
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if shared:
        return shared.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="echoquorum-store-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


def state_of(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of all files below a path, whatever its depth."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return ";".join(sorted(out))


@cache
def code_version() -> str:
    """A digest of the package's modules, so that a table made by other code is made anew."""
    top, out = Path(__file__).parents[1], hashlib.md5()
    for name in ("schema.py", "functions/scalar.py", "functions/sketch.py", "sources/adapters.py", "operators/consensus.py", "operators/deltas.py", "plans/queries.py"):
        out.update((top / name).read_bytes())
    return out.hexdigest()


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], keep: int = 4) -> DataFrame:
    """The table ``name`` derived from the files ``inputs``; ``build`` makes it if it isn't stored yet.

    A table is written into a folder of its own and then renamed to its place, so of two sessions that make the same one
    the second finds it there and drops its own. Beyond ``keep`` tables of a name the oldest are removed.
    """
    sign = hashlib.md5("|".join([code_version(), *(state_of(spark, i) for i in inputs)]).encode()).hexdigest()
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = f"{root(spark)}/echoquorum/store/{name}"
    final, fs = new_path(f"{folder}/{sign}"), new_path(root(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(final):
        draft = f"{folder}/.draft-{uuid.uuid4().hex}"
        build().write.option("compression", "zstd").parquet(draft)
        if fs.exists(final) or not fs.rename(new_path(draft), final):
            fs.delete(new_path(draft), True)
        if fs.exists(new_path(f"{folder}/{sign}/{new_path(draft).getName()}")):  # renamed into the folder of a faster session
            fs.delete(new_path(f"{folder}/{sign}/{new_path(draft).getName()}"), True)
        others = sorted((f.getModificationTime(), f.getPath().getName()) for f in fs.listStatus(new_path(folder)) if not f.getPath().getName().startswith("."))
        for _, old in others[:-keep]:
            if old != sign:
                fs.delete(new_path(f"{folder}/{old}"), True)
    return spark.read.parquet(f"{folder}/{sign}")


def few(keys: DataFrame) -> DataFrame:
    """``keys``, marked to be broadcast where there are few of them, so that what is looked up by them isn't shuffled."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def kept(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The ``rows`` whose key is among ``keys`` (without repeats), with what ``keys`` say of it, by broadcasts of some BROADCAST_KEYS keys: no row is shuffled.

    ``keys`` must be cheap to read; with more of them the rows are read as many times.
    """
    k = ceil(keys.count() / BROADCAST_KEYS)
    if k <= 1:
        return rows.join(F.broadcast(keys), on)
    part = F.pmod(F.xxhash64(*on), F.lit(k))
    return reduce(DataFrame.unionByName, [rows.filter(part == i).join(F.broadcast(keys.filter(part == i)), on) for i in range(k)])


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read back, so that what reads it doesn't make it again; ``drop`` deletes it."""
    spark = df.sparkSession
    path = f"{root(spark)}/echoquorum/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 1 << 25).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``scratch`` has written for ``df``; other frames are left alone."""
    if hasattr(df, "_scratch_path"):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def batches_of(files: list[str], rows: int) -> Iterator[pa.Table]:
    """The rows of Parquet files in the shared folder, some ``rows`` at a time; for workers, through Arrow's file systems."""
    parts, n = [], 0
    for uri in files:
        uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3a:", "s3:", uri))
        system, path = file_systems.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(rows, use_threads=False):
                while n + batch.num_rows >= rows:
                    yield pa.Table.from_batches([*parts, batch.slice(0, rows - n)])
                    batch, parts, n = batch.slice(rows - n), [], 0
                if batch.num_rows:
                    parts, n = [*parts, batch], n + batch.num_rows
    if parts:
        yield pa.Table.from_batches(parts)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out to all cores where its files give too few splits for the work on each row.

    Only small tables are dealt out: larger ones, and those of as many files, have as many splits as there are cores
    anyway, and aren't shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < cores * split and len(df.inputFiles()) < cores else df
