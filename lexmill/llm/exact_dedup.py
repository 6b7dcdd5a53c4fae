"""Exact duplicates through an extendible-hash index on shared files, in DataFrame functions only.

1. Every row gets the key of its normalised text, xxhash64 of its bytes, read as a bit address.
2. Slots: one per key, with the smallest doc_id (the head of its chain) and the number of rows; partial
   aggregation makes a group that holds a third of all rows one slot before anything is shuffled.
3. Directory: addresses of ``depth`` leading bits. Starting from one bucket, an overfull bucket is split by
   one more bit until each holds at most ``capacity`` slots; the directory doubles with each level, without an
   end. It is broadcast while it has at most BROADCAST_CELLS entries.
4. Owners: slots are dealt by bucket, a contiguous range of keys, and written to the shared folder. Rows
   with a key of more than one row are joined with the head's text there and compared byte by byte.
5. Chains: rows whose bytes differ from the head's (a collision of keys) go on to the next link of the
   chain, with a head of their own, until none is left over.

The joins with hot keys read written tables by plain exchanges, which adaptive execution splits.

Defined results: null text counts as empty and equals other empty texts; text of white space only equals one
space. Rows with null doc_id take part; a group of only such rows has keep_id null. Documents are known by
doc_id: repeated rows with the id that stays are all marked kept. An empty table gives an empty result.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, save, spread

WHITE = r"[\x20\x09-\x0D]+"
#: Addresses are of at most so many bits, and a bucket spans at most 2 ** LEVELS of them.
LAST_DEPTH, LEVELS = 63, 20
#: Entries of the directory that are sent to every task; a larger one is joined by a shuffle.
BROADCAST_CELLS = 1 << 14
PREFIX = "shiftright(cell, {depth} - bits)"
#: Keys that are sent to every task (16 bytes each) when a table of texts is filtered by them; more are joined.
BROADCAST_KEYS = 500_000


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def _leading_of(cell: str, depth: int) -> Column:
    return F.expr(PREFIX.format(depth=depth))


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def directory(slots: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Rows (cell, bucket) for each address of the returned number of leading bits that holds slots.

    The directory doubles until no bucket is overfull; keys differ, so 64 bits always part them.
    """
    depth, total = 3, slots.count()  # room for uneven buckets
    while depth < LAST_DEPTH and total > capacity << depth - 3:
        depth += 1
    while True:
        cells, path = save(slots.groupBy(_leading(F.col("key"), depth).alias("cell")).agg(F.count("*").alias("n")), "dedup-cells")
        if depth == LAST_DEPTH or cells.where(F.col("n") > capacity).isEmpty():
            break
        drop(slots.sparkSession, path)
        depth = min(LAST_DEPTH, depth + 4)
    # the shortest prefix whose bucket isn't overfull; a level at a time, so a cell leaves as soon as it has one
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(max(0, depth - LEVELS)), F.lit(depth))).alias("bits")).withColumn("prefix", _leading_of("cell", depth))
    sums = levels.groupBy("bits", "prefix").agg(F.sum("n").alias("held")).where((F.col("held") <= int(capacity)) | (F.col("bits") == depth))
    first = levels.join(sums, ["bits", "prefix"]).groupBy("cell").agg(F.min("bits").alias("bits"))
    return first.select("cell", F.expr(f"shiftleft({PREFIX.format(depth=depth)}, {depth} - bits)").alias("bucket")), depth


def exact_duplicates(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    key: of the normalised text, a long; a weak one only makes chains longer.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", normalised().alias("norm"))
    entries, _ = save(rows.select("doc_id", key(F.col("norm")).cast("long").alias("key"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "dedup-entries")
    slots = entries.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n"))
    slots, slots_path = save(slots, "dedup-slots")
    cells, depth = directory(slots, capacity)
    cells, cells_path = save(cells, "dedup-directory")
    small = cells.count() <= BROADCAST_CELLS
    index = slots.withColumn("cell", _leading(F.col("key"), depth)).join(F.broadcast(cells) if small else cells, "cell").drop("cell")
    index, _ = save(index.repartition(spread(spark), "bucket").sortWithinPartitions("bucket", "key"), "dedup-index")
    drop(spark, cells_path, slots_path)

    shared = index.where("n > 1").select("key", "head")
    small = shared.count() <= BROADCAST_KEYS
    texts = rows.withColumn("key", key(F.col("norm")).cast("long")).join(F.broadcast(shared) if small else shared, "key")
    heads, _ = save(texts.where(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("key").agg(F.min("norm").alias("head_text")), "dedup-heads")
    compared = texts.join(heads, "key").select("doc_id", "key", "head", "norm", (F.col("norm") == F.col("head_text")).alias("same"))
    left_over, _ = save(compared.where("not same").select("doc_id", "key", "norm"), "dedup-chain")

    found = entries.join(index.select("key", "head", "n"), "key").select("doc_id", "key", "text_sha256", F.col("head").alias("keep_id"), F.col("n").alias("group_size"))
    if not left_over.isEmpty():
        found = _chained(found, left_over)
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _chained(found: DataFrame, left_over: DataFrame) -> DataFrame:
    """found, with the rows that differ from their key's head moved to later links of its chain."""
    moved = None
    while True:
        heads = left_over.groupBy("key").agg(F.min_by("norm", F.struct("doc_id", "norm")).alias("head_text"))
        link, _ = save(left_over.join(heads, "key").select("doc_id", "key", "norm", (F.col("norm") == F.col("head_text")).alias("same")), "dedup-link")
        groups = link.where("same").groupBy("key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")).agg(F.min("doc_id").alias("link_id"), F.count("*").alias("link_size"))
        moved = groups if moved is None else moved.union(groups)
        left_over = link.where("not same").select("doc_id", "key", "norm")
        if left_over.isEmpty():
            break
    moved, _ = save(moved, "dedup-moved")
    gone = moved.groupBy("key").agg(F.sum("link_size").alias("gone"))
    first = found.join(gone, "key", "left").join(moved, ["key", "text_sha256"], "left")
    return first.select("doc_id", "text_sha256", F.when(F.col("link_size").isNull(), F.col("keep_id")).otherwise(F.col("link_id")).alias("keep_id"), F.coalesce("link_size", F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"))
