"""Operator 8, sharding along a Hilbert curve. DataFrame functions only.

Several metadata columns are quantised to a few bits each, a row's cell is the Hilbert index of those values, and the
rows, sorted by cell, are cut into runs of equal length. Neighbours on the curve are neighbours in all dimensions, so a
file covers a small box of the metadata and the file statistics prune scans on any of the columns. Quantisation
keeps the order of the values: a column's level is that of a value's rank among the column's distinct values.

The global rank of a row is the sum of three counts: rows in earlier cells (at most 4,096 cells, one small table),
rows of the cell in earlier buckets of a hash, and the rank within the bucket. So even a cell with a third of all rows
is never sorted by one task; a bucket that equal rows make too large is divided by a number that each row has got.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, join_by_weight, scratch

MAX_BITS = 12
#: Levels of a column, rows that a bucket should have at most, and hexadecimal digits that deal out equal rows.
LEVELS, BUCKET_ROWS, DEAL_DIGITS = 16, 50_000, 3


@cache
def hilbert_table(dims: int, bits: int) -> tuple[int, ...]:
    """The Hilbert index of every cell; cell number = the coordinates' bits side by side, the first dimension highest.

    The curve is walked by its Gray-code recursion: each index is turned into its coordinates level by level.
    """
    if dims < 1 or bits < 1 or dims * bits > MAX_BITS:
        raise ValueError(f"dims * bits must be from 1 to {MAX_BITS}")
    side, mask = 1 << dims, (1 << dims) - 1
    rol = lambda x, k: ((x << (k % dims)) | (x >> (dims - k % dims))) & mask if dims > 1 else x
    gray = lambda i: i ^ (i >> 1)
    table = [0] * (1 << dims * bits)
    for index in range(len(table)):
        entry, turn, coords = 0, 0, [0] * dims
        for level in reversed(range(bits)):
            i = (index >> (dims * level)) & (side - 1)
            corner = rol(gray(i), turn + 1) ^ entry
            for d in range(dims):
                coords[d] |= (corner >> d & 1) << level
            entry ^= rol(gray(2 * ((i - 1) // 2)) if i else 0, turn + 1)
            ones = i if i & 1 else i - 1
            turn = (turn + (0 if i == 0 else (ones ^ (ones + 1)).bit_length() - 1) + 1) % dims
        cell = 0
        for c in coords:
            cell = cell << bits | c
        table[cell] = index
    return tuple(table)


def ranked_levels(values: DataFrame, column: str, levels: int = LEVELS) -> DataFrame:
    """(column, level, n_rows) for each distinct value (null is the empty string): its rank in equal parts of the distinct values.

    The rank is a position within a range partition plus the sizes of the partitions before it, so no task sorts all values.
    """
    named = values.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column))
    distinct = named.groupBy(column).agg(F.count("*").alias("n_rows")).repartitionByRange(column).sortWithinPartitions(column)
    placed = scratch(distinct.withColumn("at_", F.monotonically_increasing_id()), "distinct-values")
    part, within = F.shiftright("at_", 33), F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))  # a row for each partition
    ahead = F.coalesce(F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part_", ahead.alias("ahead_"))
    n = placed.count()
    met = placed.select(column, "n_rows", part.alias("part_"), within.alias("within_")).join(F.broadcast(sizes), "part_")
    return met.select(column, F.expr(f"(ahead_ + within_) * {levels} div {max(n, 1)}").cast("int").alias("level"), "n_rows")


def magnitude(c: Column, least_bits: int = 4) -> Column:
    """A count in 16 levels, by its number of binary digits."""
    return F.least(F.lit(15), F.greatest(F.lit(0), F.length(F.bin(c)) - least_bits))


def hilbert_index(levels: list[Column], bits: int = 4) -> Column:
    cell = F.lit(0)
    for c in levels:
        cell = cell * (1 << bits) + c
    return F.get(F.array(*[F.lit(x) for x in hilbert_table(len(levels), bits)]), cell)


def assign_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, cell, shard, slot, and the columns ``keep``) for every row of ``docs``.

    size is the text's UTF-8 bytes (null: none) plus 8; it is the curve's last dimension after ``dims``. The law is
    ``rows``: the shards' row counts differ by at most one, the first shards having the more; slots count from 0
    without gaps. Rows of a cell are ordered by a hash of id and text, then id, size and checksum; equal rows are
    interchangeable. Nulls count as the empty string in a dimension; a null text has checksum 0. An empty table gives
    an empty result. A name in ``keep`` that is one of the result's raises ValueError.
    """
    if taken := {c.lower() for c in keep} & {"doc_id", "size", "text_crc32", "cell", "shard", "slot"}:
        raise ValueError(f"columns named like results must not be in keep: {sorted(taken)}")
    raw = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(raw) + 8).cast("long")
    inner = [f"in_{i}" for i in range(len(keep))]
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")).cast("binary"))
    src = docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"),
        *[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"dim_{i}") for i, d in enumerate(dims)],
        *[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)],
    )
    # The number that deals out equal rows is written here once; whichever task reads the table reads the same.
    rows = scratch(src.withColumn("order_", order).withColumn("deal_", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    for i in range(len(dims)):
        levels = ranked_levels(rows, f"dim_{i}").withColumnRenamed("level", f"level_{i}")
        rows = join_by_weight(rows, scratch(levels, "levels"), [f"dim_{i}"], "n_rows", total)
    cell = hilbert_index([*[F.col(f"level_{i}") for i in range(len(dims))], magnitude(F.col("size"))])
    rows = scratch(rows.select("doc_id", "size", "text_crc32", cell.alias("cell"), "order_", "deal_", *inner), "shard-cells")
    digits = 3
    while total / 16**digits > bucket_rows:
        digits += 1
    rows = rows.withColumn("bucket_", F.substring("order_", 1, digits))
    counts = scratch(rows.groupBy("cell", "bucket_").agg(F.count("*").alias("n")), "shard-counts")
    hot = scratch(counts.filter(F.col("n") > 8 * bucket_rows).select("cell", "bucket_", F.lit(True).alias("hot_")), "hot-buckets")
    if hot.limit(1).count():  # at most one bucket for each 8 * bucket_rows rows
        deal = F.substring(F.md5(F.col("deal_").cast("string").cast("binary")), 1, DEAL_DIGITS)
        met = rows.join(F.broadcast(hot), ["cell", "bucket_"], "left")
        rows = met.withColumn("bucket_", F.when(F.col("hot_"), F.concat("order_", deal)).otherwise(F.col("bucket_"))).drop("hot_")
        counts = scratch(rows.groupBy("cell", "bucket_").agg(F.count("*").alias("n")), "shard-counts")
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"))  # at most 2 ** MAX_BITS rows
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("cell", earlier(W.partitionBy(F.lit(0)).orderBy("cell")).alias("cells_before"))
    starts = counts.withColumn("before", earlier(W.partitionBy("cell").orderBy("bucket_"))).join(F.broadcast(cells), "cell")
    rank = F.row_number().over(W.partitionBy("cell", "bucket_").orderBy("order_", F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "deal_"))
    ranked = rows.join(starts.select("cell", "bucket_", (F.col("before") + F.col("cells_before")).alias("start_")), ["cell", "bucket_"])
    ranked = ranked.withColumn("rank_", F.col("start_") + rank - 1)
    base, extra = divmod(total, n_shards)
    first = extra * (base + 1)  # rows in the shards that have one more
    shard = F.when(F.col("rank_") < first, F.expr(f"rank_ div {base + 1}")).otherwise(extra + F.expr(f"(rank_ - {first}) div {max(base, 1)}"))
    slot = F.when(F.col("rank_") < first, F.col("rank_") % (base + 1)).otherwise((F.col("rank_") - first) % max(base, 1))
    return ranked.select(
        "doc_id", "size", "text_crc32", "cell", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), *[F.col(i).alias(c) for c, i in zip(keep, inner)]
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, **options) -> None:
    """Write ``docs`` as Parquet in one folder per shard (``shard_=0`` on), rows in slot order within each file; columns as given."""
    (row,) = fresh(docs, "row_")
    whole = docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    out = assign_shards(whole, n_shards, keep=(row,), **options).select(f"{row}.*", F.col("shard").alias("shard_"), F.col("slot").alias("slot_"))
    out = out.repartitionByRange(n_shards * 2, "shard_", "slot_").sortWithinPartitions("shard_", "slot_").drop("slot_")
    out.write.partitionBy("shard_").parquet(path)
