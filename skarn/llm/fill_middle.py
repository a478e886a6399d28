"""Fill-in-middle transformation of documents.

The tokenizers library's Split pre-tokenizer cuts a text at the isolated matches of a
pattern and gives their code-point offsets; nothing is trained. The number of offsets is
the number of units n; two ranks from a hash of the doc_id choose where the prefix and
the middle end, and the offsets at those ranks give the slices.

Prefix, middle and suffix are arranged as prefix-suffix-middle (psm) or
suffix-prefix-middle (spm) behind their marks, or the text stays plain: where it is empty,
where it contains a mark, and for the share of documents outside `rate`.

Choices depend on the doc_id alone, so rows that repeat one are cut at the same ranks; a
missing doc_id counts as an empty one. Null texts are empty. Every row is returned; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, slices, table

#: A unit: a line with its end, or what is left.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

ORACLE_SQL = {
    "op13_fill_middle": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
             ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2, ('0x' || h[17:24])::bigint AS h3, ('0x' || h[25:32])::bigint AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, len(u) AS n, form, array_to_string(u[1:a], '') AS prefix,
             array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
}


def choices(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that depend on seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def _cut(text: str, doc_id: object, splitter, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = np.array([0] + [end for _, (_, end) in splitter.pre_tokenize_str(text)] if text else [0], np.int64)
    n = len(ends) - 1
    h1, h2, h3, h4 = choices(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (int(x) for x in ends[np.sort([h1 % (n + 1), h2 % (n + 1)])])
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, pattern: str = LINES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row.

    rate is the percentage of documents that are rearranged, spm the percentage of those
    that take the form spm. The pattern's matches must cover the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        splitter = Split(Regex(pattern), "isolated")
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(batch.column(2).to_numpy()):
                rows = [_cut(text, doc, splitter, seed, rate, spm) for doc, text in zip(ids[lo:hi].to_pylist(), texts[lo:hi].to_pylist(), strict=True)]
                cols = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids[lo:hi], *cols], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("size"))
    return arrow_map(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form alone.

    A rearranged text holds no mark, and no mark can begin inside one and end in another,
    so the first occurrence of each mark is the one that was put there.
    """

    def after(x: Column, mark: str) -> Column:
        return F.substr(x, F.char_length(F.substring_index(x, mark, 1)) + len(mark) + 1)

    def parts(x: Column, first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(x, F.lit(len(first) + 1))
        rest = after(body, second)
        return F.substring_index(body, second, 1), F.substring_index(rest, MIDDLE, 1), after(rest, MIDDLE)

    prefix, suffix, middle = parts(output, PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(output, SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    rebuilt = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(rebuilt).alias("restored_sha256"))
