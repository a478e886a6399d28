"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS places. Every shard owns VNODES of them, a document's place is a hash
of its doc_id, and it belongs to the first virtual node clockwise. A shard takes no more
rows than its bound, the even share, so counts are at most one apart (law "rows"); what
overflows a full shard continues clockwise to the next one with room. A change of the
shard count moves the cells of the new virtual nodes and the overflow only.

The ring is walked for cells, not for rows: the driver sees one count for each cell,
CELLS numbers whatever the input, and turns them into segments (cell, ranks, shard, first
slot). Rows get their rank inside the cell from a window over that cell alone; a cell that
holds far more rows than the others, through repeated or missing doc_ids, is ranked in
PARTS parts whose counts are summed up.

Null texts have no bytes (size 1, crc 0); null doc_ids share a place; repeated rows are
ranked one after another; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

CELLS = 1 << 16
VNODES = 128
#: Rows from which a cell is ranked in parts, if it holds UNEVEN times the mean as well.
LARGE, UNEVEN, PARTS = 100_000, 8, 256


def owners(shards: int) -> np.ndarray:
    """The virtual nodes of the ring in clockwise order: (place, shard), several may share a place."""
    made = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "little") % CELLS, s) for s in range(shards) for v in range(VNODES))
    return np.array(made, np.int64)


def segments(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): cells take turns in a fixed random order."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    ring = owners(shards)
    home = np.searchsorted(ring[:, 0], np.arange(CELLS))
    order = list(range(CELLS))
    random.Random(97).shuffle(order)
    found = []
    for cell in order:
        n, at, rank = counts.get(cell, 0), int(home[cell]), 0
        while n:
            shard = int(ring[at % len(ring), 1])
            take = min(n, room[shard] - used[shard])
            if take:
                found.append((cell, rank, rank + take, shard, used[shard]))
                used[shard] += take
                rank += take
                n -= take
            at += 1
    return found


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("cell", F.shiftrightunsigned("h", 48).cast("int")).withColumn("number", F.monotonically_increasing_id())
    rows = saved(rows, "shard-rows")  # numbered as they are written
    counts = {r[0]: r[1] for r in rows.groupBy("cell").count().collect()}
    found = spark.createDataFrame(segments(counts, shards), "cell int, lo long, hi long, shard int, first long")
    many = max(LARGE, UNEVEN * sum(counts.values()) // CELLS)
    large = spark.createDataFrame([(c,) for c, n in counts.items() if n > many], "cell int")
    if not large.isEmpty():  # at most CELLS / UNEVEN cells
        rows = rows.join(F.broadcast(large.withColumn("large", F.lit(True))), "cell", "left").withColumn("part", F.when(F.col("large"), F.pmod("number", F.lit(PARTS))).otherwise(0))
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("h", "doc_id", "text_crc32", "size")).cast("long") - 1
    ranked = rows.withColumn("rank", rank)
    if not large.isEmpty():
        before = F.sum("n").over(Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        parts = rows.where("large").groupBy("cell", "part").agg(F.count("*").alias("n")).select("cell", "part", F.coalesce(before, F.lit(0)).alias("base"))
        split = ranked.where("large").join(parts, ["cell", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base")
        ranked = ranked.where("large is null").unionByName(split)
    # at most CELLS + shards * VNODES segments: fit to broadcast at any input size
    placed = ranked.join(F.broadcast(found), "cell").where("rank >= lo and rank < hi")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
