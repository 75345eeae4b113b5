"""Operator 3, line deduplication over levelled sorted runs. DataFrame functions only.

The state is a set of runs in the shared folder, ordered into levels like a log-structured merge tree. A run holds
(key hash, number of documents) in buckets of the hash, sorted within each. A batch of documents counts its own line
keys, merge-anti-joins them with the keys that each run already holds as settled (found in ``min_docs`` documents or
more, so that more counts change nothing), and adds what is left as a new run of level 0. The runs are bucketed alike,
and the batch's counts are dealt to as many partitions, so these joins need no exchange. When a level has ``fanout``
runs they are merged into one run of the next level, so each count is rewritten once per level.

A manifest in the state's folder lists the runs after each batch; a later session reopens the state by it.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, SPACES, ascii_lower, mark_by_weight, new_path, scratch

#: The two halves of a key's 128-bit hash: two XXH64 of the key under different seeds.
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def split_lines(text: Column) -> Column:
    """Lines of a text at newlines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_counts(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, n_docs): line keys of at least ``min_chars`` code points and the number of rows they are found in."""
    keys = F.array_distinct(F.transform(split_lines(F.col(text)), line_key))
    rows = docs.select(F.explode(keys).alias("key")).filter(F.char_length("key") >= min_chars)
    return rows.select(*_hashes(F.col("key"))).groupBy(*HASH).agg(F.count("*").alias("n_docs"))


class LineRuns:
    """The runs of one corpus. ``levels[i]`` lists the runs of level i, the oldest first, by the names of their folders.

    ``folder`` is a new folder of its own for the state (default: one in the shared folder), or one that holds a state
    already, which is then carried on with its own settings. One writer at a time.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 4, folder: str | None = None):
        if min_docs < 1 or fanout < 2:
            raise ValueError("min_docs must be at least 1 and fanout at least 2")
        self.spark, self.folder = spark, folder or new_path(spark, "line-runs")
        self.min_docs, self.min_chars, self.fanout = min_docs, min_chars, fanout
        self.n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.version = 0
        self._tables: dict[str, str] = {}
        self._load()

    def _fs(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _load(self) -> None:
        fs, path = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        done = [int(n.removeprefix("state-").removesuffix(".json")) for n in names if n.startswith("state-") and n.endswith(".json")]
        if done:
            self.version = max(done)
            text = "".join(r.value for r in self.spark.read.text(f"{self.folder}/state-{self.version}.json", wholetext=True).collect())  # one small row
            for k, v in json.loads(text).items():
                setattr(self, k, v)

    def _save(self) -> None:
        """A manifest of a new number: written under another name and renamed, so that a reader sees all of it or nothing."""
        state = {k: getattr(self, k) for k in ("min_docs", "min_chars", "fanout", "n_buckets", "levels")}
        fs, draft = self._fs(f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(draft, self._fs(f"state-{self.version + 1}.json")[1]):
            raise RuntimeError("another writer has added a batch to this state")
        self.version += 1

    def table(self, run: str) -> DataFrame:
        """A run as a table whose buckets Spark knows of."""
        if run not in self._tables:
            name = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {name} (h1 LONG, h2 LONG, n_docs LONG) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.n_buckets} BUCKETS LOCATION '{self.folder}/{run}'"
            )
            self._tables[run] = name
        return self.spark.table(self._tables[run])

    def runs(self) -> list[DataFrame]:
        return [self.table(r) for level in self.levels for r in level]

    def _merged(self, runs: list[str]) -> DataFrame:
        """One table of the runs, a row for each hash; counts stop mattering at min_docs but are kept whole.

        The runs are read as plain files here. As bucketed tables their union would count as dealt out by the hash, though
        it lays their partitions side by side, and no exchange would bring the rows of a key together.
        """
        if len(runs) == 1:
            return self.table(runs[0])
        files = [self.spark.read.schema("h1 LONG, h2 LONG, n_docs LONG").parquet(f"{self.folder}/{r}") for r in runs]
        dealt = reduce(DataFrame.unionByName, files).repartition(self.n_buckets, *HASH)
        return dealt.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"))

    def _store(self, counts: DataFrame) -> str:
        run, name = f"run-{uuid.uuid4().hex}", f"line_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.n_buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{run}").format("parquet").saveAsTable(name)
        self._tables[run] = name
        return run

    def _forget(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(run)}")
        fs, path = self._fs(run)
        fs.delete(path, True)

    def close(self) -> None:
        """Forget the tables' names; the files and the manifest stay."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables = {}

    def delete(self) -> None:
        """Remove the whole state."""
        self.close()
        fs, path = self._fs()
        fs.delete(path, True)

    def settled(self) -> DataFrame | None:
        """(h1, h2, n_docs) of the keys found in at least min_docs documents so far."""
        return self._merged([r for level in self.levels for r in level]).filter(F.col("n_docs") >= self.min_docs) if self.levels else None

    def new_counts(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The counts of a batch without the keys that a run holds as settled."""
        own = key_counts(docs, text, self.min_chars)
        for run in self.runs():
            # min_docs of one run are enough; a key that only several runs settle together is counted on.
            done = run.filter(F.col("n_docs") >= self.min_docs).withColumnsRenamed({c: f"{c}_" for c in (*HASH, "n_docs")})
            same = (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_"))
            # The last, which always holds, keeps the join above the counting; below, it would meet every line.
            own = own.join(done.hint("merge"), same & (F.col("n_docs") + F.col("n_docs_") > 0), "left_anti")
        return own

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Count a batch of documents and add its run."""
        run = self._store(self.new_counts(docs, text))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        old = self._compact()
        self._save()
        for r in old:
            self._forget(r)

    def _compact(self) -> list[str]:
        """Merge full levels; the runs that are no longer needed once the new state is saved."""
        gone = []
        for i in range(len(self.levels)):
            if len(self.levels[i]) < self.fanout:
                break
            old = self.levels[i]
            run = self._store(self._merged(old))
            self.levels[i] = []
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(run)
            gone += old
        return gone

    def drop_lines(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", heavy_share: int = HEAVY_SHARE) -> DataFrame:
        """(doc_id, n_lines, n_dropped, text): each row of ``docs`` without the lines whose key is settled.

        Of each line a hash, its number and the row's hashes are shuffled once to meet the settled keys; what comes back
        is, for each text with a dropped line, the sorted list of their numbers, which is joined to the texts.
        """
        src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
        tagged = src.select("doc_id", "text", F.xxhash64(F.lit(1), "doc_id", "text").alias("t1"), F.xxhash64("text").alias("t2"))
        settled = self.settled()
        if settled is None:
            hits = None
        else:
            lines = tagged.select("t1", "t2", F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
            key = line_key(F.col("line"))
            lines = lines.withColumn("key", key).filter(F.char_length("key") >= self.min_chars).select("t1", "t2", "at", *_hashes(F.col("key")))
            settled = scratch(settled, "settled")
            total = settled.agg(F.sum("n_docs")).first()[0] or 0
            met = mark_by_weight(lines, settled, HASH, "n_docs", total, F.xxhash64("t1", "t2", "at"), heavy_share)
            hits = met.groupBy("t1", "t2").agg(F.sort_array(F.collect_set("at")).alias("at"))
        parts = split_lines(F.col("text"))
        if hits is None:
            return src.select("doc_id", F.size(parts).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("text"))
        joined = tagged.join(hits, ["t1", "t2"], "left").withColumn("parts", parts)
        kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("at"))
        rest = F.when(F.col("at").isNull(), F.coalesce("text", F.lit(""))).otherwise(
            F.array_join(F.transform("kept_at", lambda i: F.get(F.col("parts"), i)), "\n")
        )
        return joined.withColumn("kept_at", kept).select(
            "doc_id",
            F.size("parts").cast("long").alias("n_lines"),
            F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"),
            rest.alias("text"),
        )


def _plain_scan(docs: DataFrame) -> bool:
    """Whether the frame is a table's files and nothing else: all their rows and columns, without partition columns."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.partitionSchema().length() == 0


def batches_of(docs: DataFrame, n: int, text: str = "text") -> list[DataFrame]:
    """The rows of a frame dealt into at most ``n`` batches, each row into one.

    The files of a plain Parquet scan are dealt out, so each is read once. Any other frame (filtered, derived, united,
    partitioned) is divided by a hash of the text; it must give the same rows whenever it is read.
    """
    if n < 2:
        return [docs]
    if not _plain_scan(docs):
        return [docs.filter(F.pmod(F.xxhash64(F.lit(3), text), F.lit(n)) == k) for k in range(n)]
    spark, files = docs.sparkSession, sorted(docs.inputFiles())
    n = min(n, len(files))
    return [spark.read.schema(docs.schema).parquet(*files[k::n]) for k in range(n)] if n > 1 else [docs]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, n_batches: int = 4, fanout: int = 4) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for every row: lines whose key is found in ``min_docs`` rows or more are gone.

    The table is fed to the runs in ``n_batches`` batches (``batches_of``); the result doesn't depend on their number.
    A row counts as a document, so repeated rows count each. Null and empty texts are one empty line, and keys of less
    than ``min_chars`` code points are never dropped. A text that loses all lines becomes empty. An empty table gives
    an empty result. Other columns of ``docs`` play no part.
    """
    runs = LineRuns(docs.sparkSession, min_docs, min_chars, fanout)
    for batch in batches_of(docs, n_batches, text):
        runs.add(batch, text)
    out = runs.drop_lines(docs, id_col, text)
    runs.delete()  # drop_lines has written the settled keys to a table of their own
    return out
