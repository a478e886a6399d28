"""Packing of token sequences by minimum bin slack.

Documents become token ids. A document's whole windows of SIZE ids are sequences of
their own; what remains, at most SIZE - 1 ids, is packed. The driver sees a histogram of
the remaining lengths, SIZE - 1 numbers whatever the input. For the longest
length left, a subset-sum over bitsets finds the multiset of the others that fills the
window closest to capacity; the counts come from backtracking, and the pattern is used as
often as the histogram allows. Patterns that leave slack are not used: what is left then
runs through windows end to end and is cut where they end, and the last window's ids go
to sequences that are powers of two. So no sequence is padded.

Tasks count their rows of each length as they read them, and sums of the counts of the
tasks before turn that into ranks: no sort, and no group that holds more rows than a task
has read. Rows find their sequence by (length, rank) and arithmetic on the broadcast plan.
Documents are read in one pass; those that are cut are read once more for their ids, by a
broadcast of their keys where they are few, else by a join.

Null texts are empty and have the end id alone; repeated rows are packed one by one;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Ids
from .common import arrow_map, few, saved, slices, table, utf8

SIZE = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _lengths(path: str):
    end = np.array([END], "<u4").tobytes()
    window = 4 * SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Ids.of(path)
        part, seen, windows = TaskContext.get().partitionId(), [0] * SIZE, 0
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(np.diff(offsets)):
                total, full, rest, crc, rank, at = [], [], [], [], [], []
                for raw in words.ids(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    raw += end
                    n = len(raw) // 4
                    total.append(n)
                    full.append([zlib.crc32(raw[i * window : (i + 1) * window]) for i in range(n // SIZE)])
                    rest.append(n % SIZE)
                    rank.append(seen[n % SIZE])
                    at.append(windows)
                    seen[n % SIZE] += 1
                    windows += n // SIZE
                    crc.append(zlib.crc32(raw[n // SIZE * window :]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(total, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.int32()), pa.array(crc, pa.int64()), pa.array([part] * len(total), pa.int32()), pa.array(rank, pa.int64()), pa.array(at, pa.int64())],
                    ["doc_id", "key", "doc_tokens", "full", "rest", "crc", "part", "rank", "at"],
                )

    return run


def fill(lengths: list[int], counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each length come closest to target from below: subset-sum over bitsets.

    lengths are tried in the given order until target itself is reached.
    """
    mask, bits = (1 << (target + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        left = min(counts[length], target // length) if length <= target else 0
        size = 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left -= take
            size *= 2
        if bits >> target & 1:
            break
    at = bits.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Patterns (times, {length: count}) that fill windows exactly, and the histogram of what is left."""
    left = {k: v for k, v in histogram.items() if v and k}
    order = sorted(left, reverse=True)
    patterns, spare = [], {}
    while order:
        longest = order[0]
        left[longest] -= 1
        used = fill([x for x in order if left[x]], left, size - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        if sum(k * v for k, v in used.items()) == size:
            times = min(left[k] // v for k, v in used.items())
            patterns.append((times, used))
            for k, v in used.items():
                left[k] -= v * times
        else:
            spare[longest] = left[longest]
            left[longest] = 0
        order = [x for x in order if left[x]]
    return patterns, spare


class Layout:
    """Where (length, rank) lies: the plan as arrays."""

    def __init__(self, histogram: dict[int, int], size: int = SIZE):
        patterns, spare = plan(histogram, size)
        self.size = size
        entries: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for times, lengths in patterns:
            offset = 0
            for length, count in sorted(lengths.items(), reverse=True):
                entries.setdefault(length, []).append((used.get(length, 0), count, sequence, offset))
                used[length] = used.get(length, 0) + count * times
                offset += length * count
            sequence += times
        self.used = used
        self.entries = {k: np.array(v, np.int64) for k, v in entries.items()}
        # the spare lengths run through windows end to end
        self.stream, self.first = {}, sequence
        at = 0
        for length, count in spare.items():
            self.stream[length] = at
            at += length * count
        whole, tail = divmod(at, size)
        cuts = [i for i in range(size.bit_length() - 1, -1, -1) if tail >> i & 1]
        self.whole = whole
        self.tails = whole * size + np.cumsum([0] + [1 << i for i in cuts], dtype=np.int64)
        self.sequences = sequence + whole + len(cuts)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start in the remainder, length, sequence, offset)."""
        if rank < self.used.get(length, 0):
            rows = self.entries[length]
            first, count, sequence, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
            j = rank - first
            return [(0, length, int(sequence + j // count), int(offset + j % count * length))]
        at = self.stream[length] + (rank - self.used.get(length, 0)) * length
        end, start, found = at + length, at, []
        while at < end:
            if at < self.whole * self.size:
                k, low = at // self.size, at // self.size * self.size
                high = low + self.size
            else:
                i = int(np.searchsorted(self.tails, at, "right")) - 1
                k, low, high = self.whole + i, int(self.tails[i]), int(self.tails[i + 1])
            n = min(end, high) - at
            found.append((at - start, n, self.first + k, at - low))
            at += n
        return found


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = saved(arrow_map(docs, _lengths(path), "doc_id long, key long, doc_tokens long, full array<long>, rest int, crc long, part int, rank long, at long"), "lengths")
    counted = saved(rows.groupBy("rest", "part").agg(F.count("*").alias("n"), F.sum(F.size("full")).alias("windows")), "counts")
    layout = Layout({r[0]: r[1] for r in counted.where("rest > 0").groupBy("rest").agg(F.sum("n")).collect()})
    shared = docs.sparkSession.sparkContext.broadcast(layout)  # bounded by SIZE
    # a row for each task that has read documents
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.where("rest > 0").select("rest", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.where("rest > 0").join(bases, ["rest", "part"]).withColumn("rank", F.col("base") + F.col("rank"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, key, total, rest, crc, rank in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                pieces = where.place(rest, rank)
                for start, n, sequence, offset in pieces:
                    for x, v in zip(out, (doc, key, total - rest + start, n, crc if len(pieces) == 1 else None, total, sequence, offset), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = saved(arrow_map(ranked.select("doc_id", "key", "doc_tokens", "rest", "crc", "rank"), put, SCHEMA.replace("start long", "key long, start long")), "placed")
    uncut = placed.where("ids_crc32 is not null").drop("key")
    cut = placed.where("ids_crc32 is null")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = Ids.of(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            crcs = []
            data, offsets = utf8(batch.column(0))
            for i, (start, n) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = words.ids(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0] + end
                crcs.append(zlib.crc32(raw[4 * start : 4 * (start + n)]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(crcs, pa.int64()), *(batch.column(i) for i in (4, 5, 6))], SCHEMA.replace(" long", "").split(", "))

    id_ = F.coalesce("doc_id", F.lit(-1)).alias("id")  # a null id beside the text's hash
    needed = few(cut.select(id_, "key").distinct(), "cut")
    texts = docs.withColumn("id", id_).join(needed, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("id", "key", "text")
    redone = texts.join(cut.withColumn("id", id_), ["id", "key"]).select("text", "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")
    redone = arrow_map(redone, again, SCHEMA)
    # whole windows: a sequence each, numbered through the tasks
    parts = counted.groupBy("part").agg(F.sum("windows").alias("windows")).where("windows > 0")
    through = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", (F.coalesce(F.sum("windows").over(through), F.lit(0)) + layout.sequences).alias("first"))
    wide = rows.where("size(full) > 0").join(firsts, "part").select("doc_id", "doc_tokens", (F.col("first") + F.col("at")).alias("first"), F.posexplode("full").alias("i", "ids_crc32"))
    whole = wide.select("doc_id", (F.col("i") * F.lit(SIZE)).cast("long").alias("start"), F.lit(SIZE).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return uncut.unionByName(redone).unionByName(whole)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
