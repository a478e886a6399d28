"""Quality classifier: a byte-level convolutional network, trained and run in numpy.

Bytes are embedded in EMBED numbers; FILTERS learned filters of WIDTH bytes step over the
whole document by STRIDE. Maxima of their rectified outputs over overlapping chunks (two
neighbouring blocks of BLOCK steps) describe the chunks; the mean and the maximum over a
document's chunks go through a logistic unit to one probability.

Training uses at most TRAIN_ROWS labelled rows, those of smallest id hash, half of them of
each label where there are enough, with texts of at most TRAIN_BYTES bytes (190 MB on the
driver at worst); rows whose
crc32(doc_id as text) mod 4 is 2 are held out. The bias is then set to the labels' true
ratio. Every text is scored whole. Labels, lang, source and doc_id are no inputs.

Null texts count as empty; empty texts have the score of an all-padding document. A
doc_id that is labelled twice counts with its lower label; unlabelled and null labels are
not used. With labels of one kind or none the score is that share (0.5 for none). Repeated
rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, slices, table, utf8

TRAIN_ROWS = 3000
TRAIN_BYTES = 1 << 16
#: Steps of training, each over 32 documents.
STEPS = 640
EMBED, WIDTH, STRIDE, FILTERS, BLOCK = 8, 8, 2, 32, 128
CUT = 0.7
#: The column that holds a score, of a name that no input has.
SCORE = "_skarn_score"
_STEP = BLOCK * STRIDE


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with WIDTH zero bytes in front and zeros up to whole blocks behind, and their block counts."""
    sizes = np.diff(offsets)
    blocks = np.maximum(2, -(-(sizes + 2 * WIDTH) // _STEP))
    begin = (np.cumsum(blocks) - blocks) * _STEP
    out = np.zeros(int(blocks.sum()) * _STEP + WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(begin + WIDTH - offsets[:-1], sizes)] = data
    return out, blocks


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def windows(self, flat: np.ndarray) -> np.ndarray:
        x = self.embed[flat].ravel()
        n = (len(flat) - WIDTH) // STRIDE
        return np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))

    def blocks(self, flat: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of each block of steps, and where they are."""
        n = len(flat) // _STEP
        found, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if places else None
        for lo in range(0, n, 64):  # a piece that stays in the cache
            hi = min(n, lo + 64)
            out = (self.windows(flat[lo * _STEP : hi * _STEP + WIDTH]) @ self.filters).reshape(hi - lo, BLOCK, FILTERS)
            if places:
                at = out.argmax(1)
                where[lo:hi] = at + np.arange(lo, hi)[:, None] * BLOCK
                found[lo:hi] = np.take_along_axis(out, at[:, None, :], 1)[:, 0]
            else:
                found[lo:hi] = out.max(1)
        return found, where

    def pooled(self, maxima: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(mean and maximum over chunks, chunk values, chunk owner, first chunk of each row)."""
        value = np.maximum(maxima + self.shift, 0)
        ends = np.cumsum(counts)
        inner = np.ones(len(value), bool)
        inner[ends - 1] = False
        left = np.flatnonzero(inner)  # a chunk is a block and the next one
        chunks = np.maximum(value[left], value[left + 1])
        first = np.cumsum(counts - 1) - (counts - 1)
        mean = np.add.reduceat(chunks, first, axis=0) / (counts - 1)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunks, first, axis=0)], 1), value, left, first

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        flat, counts = layout(data, offsets)
        z = self.pooled(self.blocks(flat)[0], counts)[0] @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def gradients(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        flat, counts = layout(data, offsets)
        maxima, where = self.blocks(flat, places=True)
        doc, value, left, first = self.pooled(maxima, counts)
        delta = (1 / (1 + np.exp(-(doc @ self.weights + self.bias))) - labels) / len(labels)
        d_doc = delta[:, None] * self.weights[None, :]
        chunks = np.maximum(value[left], value[left + 1])
        owner = np.repeat(np.arange(len(counts)), counts - 1)
        d_chunk = (d_doc[:, :FILTERS] / (counts - 1)[:, None])[owner]
        top = np.maximum.reduceat(chunks, first, axis=0)[owner] == chunks
        share = np.add.reduceat(top.astype(np.float32), first, axis=0)[owner]
        d_chunk = d_chunk + d_doc[:, FILTERS:][owner] * top / share
        d_block = np.zeros_like(value)
        low = value[left] >= value[left + 1]
        np.add.at(d_block, left, d_chunk * low)
        np.add.at(d_block, left + 1, d_chunk * ~low)
        d_block *= value > 0
        block, f = np.nonzero(d_block)
        g = d_block[block, f]
        start = where[block, f] * STRIDE
        raw = flat[start[:, None] + np.arange(WIDTH)]
        x = self.embed[raw].reshape(len(g), WIDTH * EMBED)
        d_filters = np.zeros_like(self.filters)
        for k in range(FILTERS):
            d_filters[:, k] = g[f == k] @ x[f == k]
        d_x = (g[:, None] * self.filters.T[f]).reshape(-1, EMBED)
        d_embed = np.stack([np.bincount(raw.ravel(), d_x[:, e], 256) for e in range(EMBED)], 1).astype(np.float32)
        d_embed[0] = 0
        return [d_embed, d_filters, d_block.sum(0), doc.T @ delta, delta.sum(keepdims=True)]

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        params = [self.embed, self.filters, self.shift, self.weights, self.bias]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        step = 0
        while step < steps:
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), 32):
                pick = order[lo : lo + 32]
                at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])]).astype(np.int64)
                step += 1
                for p, m, v, g in zip(params, first, second, self.gradients(np.frombuffer(b"".join(texts[i] for i in pick), np.uint8), at, labels[pick]), strict=True):
                    g = g.astype(np.float32) + np.float32(1e-4) * p
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def held_out(doc_id):
    """Whether a row's label may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """A trained network, or the constant score where there is nothing to tell apart."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id")))
    totals = {int(r[0] > 0): r[1] for r in known.groupBy((F.col("quality") > 0).cast("int")).count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("quality > 0").orderBy(*order).limit(rows // 2).unionByName(known.where("quality <= 0").orderBy(*order).limit(rows // 2))
    # at most TRAIN_ROWS rows of (doc_id, quality) are broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    got = texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).collect()
    got.sort(key=lambda r: r["doc_id"])
    y = np.array([float(r["quality"] > 0) for r in got], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    network = Network()
    network.train([r["text"].encode() for r in got], y)
    network.bias += np.float32(np.log(totals[1] / totals[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return network


def scored(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows with all their columns and SCORE."""
    at, names = docs.columns.index(text_col), [*docs.columns, SCORE]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            found = np.full(len(batch), own if isinstance(own, float) else 0.0)
            if not isinstance(own, float):
                for lo, hi in slices(np.diff(offsets), 1 << 20):
                    found[lo:hi] = own.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names)

    from pyspark.sql import types as T

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= CUT).cast("int").alias("predicted"))
