"""Spelling variants: words that differ by one inserted, deleted or replaced letter.

Words are maximal runs of [A-Za-z\\u00C0-\\u00FF], A-Z in lower case, counted over all texts.

1. Tasks count the words of their texts; counts combine before the shuffle. The words with
   enough letters and occurrences are written once, numbered.
2. Every word gives integer keys, in numpy, for many words at once: a prefix and a suffix
   polynomial over the letters give the hash of the word without any one letter in a few
   passes. One kind of key is (hash without letter i, i): its words differ at i only. The
   other is the hash without a letter, and the hash of whole words: a longer word meets the
   shorter one. Equal keys of one word count once.
3. Keys are partitioned by their leading bits and sorted within partitions. Keys of one
   word alone, and shortened words that are no word, go at once; rows hold a key and a
   number only, so that a long run's many keys stay small.
4. What is left gets its strings and is partitioned and sorted again. Strings that share a
   key are told apart by the shortened string itself. A group's words are neighbours of
   each other, or of its one shorter word: each takes the group's size and its best other
   member, no pairs are made. Two neighbours meet in exactly one group, so sizes add up.
5. A word's form is its most frequent neighbour, where that is FACTOR times as frequent;
   roots are found by doubling steps along the forms.

A group differs in one letter, so it has no more members than letters times places. Moduli
are primes and bases are drawn for each run.

Null texts have no words; a missing doc_id counts as an empty one where letters are taken
out by doc_id. Repeated rows count again; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import re
import secrets
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import arrow_map, few, saved, table

MIN_CHARS, MIN_COUNT, FACTOR = 7, 2, 10
#: Two primes, whose hashes together make a key of 62 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
#: Leading bits of a key that partition it.
RADIX = 16
#: Words that a task counts before it hands counts on, and letters it hashes at once.
COUNTED, LETTERS = 200_000, 1 << 18
#: The remainder that says which runs lose a letter, in op11.
TYPOS = 31


def _count(min_chars: int, typos: int | None):
    """Counts of words of rows (doc_id, text)."""
    run_of = re.compile(rf"[a-zÀ-ÿ]{{{min_chars},}}")

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                if text.is_valid:
                    low = text.as_buffer().to_pybytes().lower().decode()  # of bytes, lower() changes A-Z only
                    if typos is None:
                        counts.update(run_of.findall(low))
                    else:
                        start = zlib.crc32(b"%s:" % (b"" if ids[i] is None else str(ids[i]).encode()))
                        for word, n in Counter(run_of.findall(low)).items():
                            h = zlib.crc32(word.encode(), start)
                            if h % typos == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < min_chars:
                                    continue
                            counts[word] += n
                if len(counts) >= COUNTED:
                    yield batch_of(counts)
                    counts.clear()
        if counts:
            yield batch_of(counts)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, typos: int | None = None) -> DataFrame:
    """(word, n) of all words of min_chars letters or more; with typos, runs whose crc32 it divides lose a letter first."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, _count(min_chars, typos), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def powers(base: int, p: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo p."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
    return out[:n]


def deletion_keys(letters: np.ndarray, sizes: np.ndarray, bases: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash without each letter, place of each letter) of words laid end to end as code points."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    longest = int(sizes.max(initial=0)) + 1
    whole, without = np.zeros(len(sizes), np.uint64), np.zeros(len(letters), np.uint64)
    for p, base in zip(PRIMES, bases, strict=True):
        prime, power = np.uint64(p), powers(base, p, longest)
        term = (letters.astype(np.uint64) + np.uint64(1)) * power[place] % prime
        moved = (letters.astype(np.uint64) + np.uint64(1)) * power[np.maximum(place - 1, 0)] % prime  # as if a letter before were gone
        prefix, suffix = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (term, moved))
        whole = (whole << np.uint64(31)) | (prefix[ends] - prefix[starts]) % prime
        left = prefix[:-1] - np.repeat(prefix[starts], sizes)
        right = np.repeat(suffix[ends], sizes) - suffix[1:]
        without = (without << np.uint64(31)) | (left + right) % prime
    return whole, without, place


def _keys(bases: tuple[int, int]):
    """Rows (key, kind, id, at): kind 0 the word, 1 the word without a letter, 2 the same with the letter's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in texts], np.int64)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), LETTERS, "right")) + lo)
                own = sizes[lo:hi]
                letters = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le"), "<u4")
                whole, without, place = deletion_keys(letters, own, bases)
                word = np.repeat(np.arange(hi - lo), own)
                length = np.repeat(own, own).astype(np.uint64)
                # a letter like the one before it leaves the same string: once is enough
                fresh = np.ones(len(letters), bool)
                fresh[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
                parts = [
                    (words.mix(whole ^ words.mix(own.astype(np.uint64))), np.arange(hi - lo), 0, np.full(hi - lo, -1)),
                    (words.mix(without[fresh] ^ words.mix(length[fresh] - np.uint64(1))), word[fresh], 1, place[fresh]),
                    (words.mix(words.mix(without ^ words.mix(length - np.uint64(1))) + place.astype(np.uint64) + np.uint64(1)), word, 2, place),
                ]
                for key, row, kind, at in parts:
                    columns = [pa.array(key.view(np.int64)), pa.array(np.full(len(key), kind, np.int32)), pa.array(ids[lo:hi][row]), pa.array(at.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "kind", "id", "at"])
                lo = hi

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, kind), those that can have a neighbour: a shorter word and what shortens to it, or two that differ at one place."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        now = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        key = now.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))  # the last group may go on in the next batch
        yield _grouped(now.slice(0, last))
        held = now.slice(last)
    if held is not None:
        yield _grouped(held)


def _grouped(rows: pa.RecordBatch) -> pa.RecordBatch:
    if not len(rows):
        return rows
    key, kind = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(new) - 1
    of = [np.bincount(group, kind == k) for k in range(3)]
    use = ((kind < 2) & ((of[0] > 0) & (of[1] > 0))[group]) | ((kind == 2) & (of[2] > 1)[group])
    return rows.filter(pa.array(use))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, near, best_n, best, best_id) of each member of groups of rows (key, kind, at, id, word, n) sorted by key.

    Members of a key are told apart by the string they share, so keys that collide do no harm.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    names = ["id", "near", "best_n", "best", "best_id"]

    def judged(rows: list) -> Iterator[tuple]:
        found: dict = {}
        for kind, at, id_, word, n in rows:
            own = word if kind == 0 else word[:at] + word[at + 1 :]
            found.setdefault((own, at if kind == 2 else -1), ([], []))[kind == 0].append((-n, word, id_))
        for (_, at), (members, whole) in found.items():
            members.sort()
            if at >= 0:
                if len(members) > 1:
                    for k, (_, _, id_) in enumerate(members):
                        n, word, best = members[k == 0]
                        yield id_, len(members) - 1, -n, word, best
            elif whole and members:
                (n, word, shorter), (m, first, best) = whole[0], members[0]
                yield shorter, len(members), -m, first, best
                for _, _, id_ in members:
                    yield id_, 1, -n, word, shorter

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names)

    last, rows = None, []
    for batch in batches:
        out: list = []
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                out.extend(judged(rows))
                last, rows = key, []
            rows.append(row)
        yield batch_of(out)
    yield batch_of(list(judged(rows)))


def variants(counts: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n), words being distinct."""
    bases = tuple(secrets.randbelow(p - 1_000_000) + 500_000 for p in PRIMES)
    known = saved(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    radix = F.call_function("shiftrightunsigned", F.col("key"), F.lit(64 - RADIX)).cast("int")
    keys = arrow_map(known.select("id", "word"), _keys(bases), "key long, kind int, id long, at int")
    keys = saved(arrow_map(keys.repartition(radix).sortWithinPartitions("key", "kind"), _shared, keys.schema), "keys")
    rows = keys.join(known, "id").select("key", "kind", "at", "id", "word", "n")
    met = arrow_map(rows.repartition(radix).sortWithinPartitions("key", "kind"), _neighbours, "id long, near long, best_n long, best string, best_id long")
    best = met.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best", "best_id")).alias("b"))
    near = saved(known.join(best, "id", "left").withColumn("good", -F.col("b.m") >= F.lit(factor) * F.col("n")), "near")
    formed = near.where("good").select("id", F.col("b.best_id").alias("to"), F.col("b.best").alias("root"))
    # steps along the forms: each round doubles them, until all ends are roots
    ends = saved(formed, "forms")
    while True:
        through = few(ends.join(ends.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("further")), "steps")
        if not through.limit(1).count():
            break
        ends = saved(ends.join(through, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.coalesce("further", "root").alias("root")), "ends")
    out = near.join(ends.select("id", "root"), "id", "left")
    of = lambda x: F.when(F.col("good"), x)
    return out.select("word", of(F.col("b.best")).alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), of(-F.col("b.m")).alias("form_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR, typos: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of min_chars letters and min_count occurrences or more."""
    return variants(word_counts(docs, id_col, text_col, min_chars, typos).where(F.col("n") >= min_count), factor)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), typos=TYPOS)
