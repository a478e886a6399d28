"""Exact duplicates, with the frequent texts split off before the shuffle.

Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]; null
counts as empty. A Misra-Gries pass over the digests of the normalised texts names at
most 1 / SUPPORT candidates for frequent texts. Their exact counts and winners come from
an aggregation with partial results on every task; the verified ones, at most
1 / SUPPORT rows, are broadcast, so that rows of frequent texts are settled where they
are read. The rest is shuffled by digest, and no group there holds more than SUPPORT of
all rows. DataFrame operations only.

Of equal texts the row with the most code points, then the smallest doc_id (null last)
stays. Of rows that repeat the winner's doc_id and text one stays. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, saved, table

#: A text that makes up this part of all rows is frequent.
SUPPORT = 0.001

ORACLE_SQL = {
    "op7_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept,
       h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id ASC NULLS LAST)
"""
}


def normalised(text):
    """The text without [\\x20\\x09-\\x0D]."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, h, row, key) for each row; row and key are hashes of (doc_id, text) and text."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    columns = [id_.alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("chars"), F.sha2(normalised(text).cast("binary"), 256).alias("h"), F.xxhash64(id_, text).alias("row"), F.xxhash64(text).alias("key")]
    # numbered as they are written: of rows that repeat the winner one has the least number
    rows = saved(docs.select(*columns).withColumn("number", F.monotonically_increasing_id()), "digests")
    candidates = rows.stat.freqItems(["h"], SUPPORT).select(F.explode("h_freqItems").alias("h"))  # at most 1 / SUPPORT
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("x"), "doc_id", "number")).alias("best")
    heavy = rows.join(F.broadcast(candidates), "h").groupBy("h").agg(F.count("*").alias("size"), best).where(F.col("size") >= rows.count() * SUPPORT)
    marked = rows.join(F.broadcast(heavy), "h", "left")  # at most 1 / SUPPORT rows
    light = marked.where("best is null").drop("size", "best")
    light = light.join(light.groupBy("h").agg(F.count("*").alias("size"), best), "h")
    out = marked.where("best is not null").unionByName(light)
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("number") == F.col("best.number")).alias("kept"), "h", "row", "key")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row."""
    return _judged(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.col("h").alias("text_sha256"))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; texts move only where many rows go."""
    key = ["_skarn_row", "_skarn_key"]
    found = _judged(docs, id_col, text_col).where("group_size > 1").groupBy(F.col("row").alias(key[0]), F.col("key").alias(key[1])).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    found = saved(found, "repeated")
    lost, twice = few(found.where("not kept").select(*key), "lost"), found.where("kept and n > 1").select(*key)
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    left = docs.withColumn(key[0], F.xxhash64(id_, text)).withColumn(key[1], F.xxhash64(text)).join(lost, key, "left_anti")
    if not twice.limit(1).count():
        return left.select(*docs.columns)
    one = left.join(twice, key, "left_semi").withColumn("_skarn_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).where("_skarn_n = 1")
    return left.join(twice, key, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
