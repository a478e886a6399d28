"""Lines that many documents share, dropped from all but one of them; DataFrame operations only.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z in lower case;
keys are compared by 128 bits of their SHA-256. Keys of at least MIN_CHARS code points that
MIN_DOCS documents hold lose their lines except in the document with the largest doc_id.

1. Lines with long keys become rows of (digest, doc_id, hash of the text, position), some
   40 bytes each. The text itself goes no further.
2. A Misra-Gries pass names the digests that make up SUPPORT of all lines, at most
   1 / SUPPORT. Their documents are counted by an aggregation that combines in every task,
   and the result is broadcast.
3. All other rows are range-partitioned by digest, each partition sorted by digest, then
   document (largest first) and position. Windows stream over that order, with neither
   another shuffle nor another sort: the first occurrence of a digest is in the document
   that keeps it, a running count of documents says how many hold it.
4. The positions that go are folded into a keep bitmap for each document: words of 64
   lines, of which only those that drop some line are stored.

Rows that share a doc_id are one document. Rows without a doc_id are one document too,
smaller than any other. Null and empty texts are one empty line. Repeated rows are judged
alike. Every row is returned; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, saved, table

MIN_CHARS, MIN_DOCS = 40, 5
#: A digest that makes up this part of all lines is settled apart.
SUPPORT = 0.001
_BLANK = " \t\n\x0b\x0c\r"

ORACLE_SQL = {
    "op12_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM x),
shared AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 40
           GROUP BY k HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::int) >= 5),
j AS (SELECT k.*, s.k IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM k LEFT JOIN shared s ON k.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
}


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_BLANK))
    # lower() is the faster one, and the same where all characters are ASCII
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _dropped(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, key, pos, gone) of lines with long keys, of rows (doc, key, text); a line goes where one of its rows says so."""
    lines = docs.select("doc", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc", "key", "pos", line_key(F.col("line")).alias("line"))
    digest = F.substring(F.unhex(F.sha2(F.col("line").cast("binary"), 256)), 1, 16)
    lines = saved(lines.where(F.char_length("line") >= min_chars).select(digest.alias("h"), "doc", "key", "pos"), "lines")
    frequent = saved(lines.stat.freqItems(["h"], SUPPORT).select(F.explode("h_freqItems").alias("h")), "frequent")  # at most 1 / SUPPORT
    frequent = F.broadcast(frequent)
    # lines of other digests count under no digest, once for each document and task
    marked = lines.join(frequent.withColumn("often", F.lit(True)), "h", "left").withColumn("h", F.when(F.col("often"), F.col("h")))
    held = marked.groupBy("h", "doc").agg(F.max("often").alias("often"))
    held = held.groupBy("h").agg(F.max("often").alias("often"), F.count("*").alias("docs"), F.max("doc").alias("keeper")).where("often").drop("often")
    of_heavy = lines.join(F.broadcast(held), "h", "left")
    light = lines.join(frequent, "h", "left_anti").repartitionByRange("h").sortWithinPartitions("h", F.desc("doc"), "pos")
    order = Window.partitionBy("h").orderBy(F.desc("doc"))
    of_light = light.withColumn("keeper", F.first("doc").over(order)).withColumn("nth", F.dense_rank().over(order))
    of_light = of_light.withColumn("docs", F.max("nth").over(Window.partitionBy("h")))
    gone = (F.coalesce("docs", F.lit(0)) >= min_docs) & ~F.col("doc").eqNullSafe(F.col("keeper"))
    out = ["doc", "key", "pos", gone.alias("gone")]
    return of_heavy.select(*out).unionByName(of_light.select(*out).where("gone"))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text")).select("doc", F.xxhash64("text").alias("key"), "text")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, key, n_dropped, keep) of the documents that lose lines; key is xxhash64 of the text.

    keep is an array of (word, bits) in order: bit i of a word says whether line
    64 * word + i stays. Words that keep all their lines are left out.
    """
    judged = _dropped(_read(docs, id_col, text_col), min_chars, min_docs)
    bit = F.when(F.col("gone"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64))
    words = judged.groupBy("doc", "key", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("gone")).where("gone is not null")
    keep = F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits"))))
    return words.groupBy("doc", "key").agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), keep.alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The text's lines that a keep bitmap leaves, joined by newlines; the text itself where there is no bitmap."""

    def full(keep: Column) -> Column:
        """All words up to the last stored one."""
        before = lambda k: F.coalesce(F.get(keep, k - 1)["word"], F.lit(-1))
        gap = lambda w, k: F.array_repeat(F.lit(-1).cast("long"), w["word"] - before(k) - 1)
        return F.flatten(F.transform(keep, lambda w, k: F.concat(gap(w, k), F.array(w["bits"]))))

    def left(v: Column) -> Column:
        bits = lambda i: F.coalesce(F.get(v["words"], F.shiftright(i, 6)), F.lit(-1).cast("long"))
        return F.filter(v["lines"], lambda x, i: F.call_function("shiftright", bits(i), i % 64).bitwiseAND(F.lit(1).cast("long")) == 1)

    bound = F.array(F.struct(F.split(text, "\n").alias("lines"), full(keep).alias("words")))  # evaluated once, not for each line
    return F.when(keep.isNull(), text).otherwise(F.array_join(F.get(F.transform(bound, left), F.lit(0)), "\n"))


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row, the text without the lines that go."""
    maps = few(keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), "bitmaps")
    rows = _read(docs, id_col, text_col).withColumnsRenamed({"doc": "doc_id", "key": "text_key"})
    met = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_key") == F.col("key")), "left")
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return met.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept_text(F.col("text"), F.col("keep")).alias("text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
