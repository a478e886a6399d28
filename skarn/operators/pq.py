"""Product-quantised vectors: a byte for every few dimensions, searched by look-up tables.

Unit vectors are cut into parts of DIMS dimensions; a part is the number of the nearest of
CODES centres of its codebook. The codebooks are fitted on at most SAMPLE vectors, those of
smallest id hash; every row gets its code. A search scores codes, takes RERANK times as many
rows as it must return, and ranks those by exact distance: vectors are read for them only.
The error of a code, kept beside it, bounds what the score can miss, so that `exact`
returns the true nearest rows. Rows without a vector have no code and are never found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions import vector

from . import ivf
from .search import CANDIDATES, vector_candidates

DIMS, CODES, ROUNDS, RERANK = 4, 256, 12, 10
#: Codes and queries in a block of a batch search: about 0.4 MB and 0.1 MB at 64 dimensions.
BLOCK, ASKED = 16_384, 256
#: Scores and ids that a task of a batch search holds, 16 bytes each.
HELD = 4_000_000
#: Above the rounding of scores summed in another order.
SLACK = 1e-6


def _parts(x: np.ndarray, dims: int) -> np.ndarray:
    """Unit rows cut into parts (rows x parts x dims), filled up with zeros."""
    x = ivf._unit(x)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % dims))).reshape(len(x), -1, dims)


def _nearest_code(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)


def fit(chunks: DataFrame, dims: int = DIMS, codes: int = CODES, seed: int = 1) -> np.ndarray:
    """Codebooks (parts x codes x dims) by k-means of every part; fewer codes where the sample has fewer rows."""
    x = _parts(ivf.sample(chunks), dims)
    rng = np.random.default_rng(seed)
    books = x[rng.choice(len(x), min(codes, len(x)), replace=False)].transpose(1, 0, 2).copy()
    for part, centres in enumerate(books):
        own = x[:, part]
        for _ in range(ROUNDS):
            near = _nearest_code(own, centres)
            n = np.bincount(near, minlength=len(centres))
            sums = np.stack([np.bincount(near, own[:, d], len(centres)) for d in range(own.shape[1])], 1)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return books


def _decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return books[np.arange(len(books)), codes].reshape(len(codes), -1)


def encode(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """All rows with code (a byte a part) and err (the length of what the code misses), null without a vector."""
    kind = T.StructType([T.StructField("code", T.BinaryType()), T.StructField("err", T.DoubleType())])

    @F.pandas_udf(kind)
    def coded(v: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"code": pd.Series([None] * len(v), dtype=object), "err": np.full(len(v), np.nan)})
        has = np.flatnonzero(v.notna().to_numpy())
        for lo in range(0, len(has), 4096):
            at = has[lo : lo + 4096]
            x = _parts(np.stack(v.iloc[at].to_numpy()).astype(np.float64), books.shape[2])
            code = np.stack([_nearest_code(x[:, p], books[p]) for p in range(len(books))], 1).astype(np.uint8)
            out.loc[at, "code"] = pd.Series([c.tobytes() for c in code], index=at, dtype=object)
            out.loc[at, "err"] = np.linalg.norm(x.reshape(len(x), -1) - _decoded(code, books), axis=1)
        return out

    made = chunks.withColumn("_pq", F.when(F.col("embedding").isNotNull(), coded("embedding")))
    return made.withColumn("code", F.col("_pq.code")).withColumn("err", F.col("_pq.err")).drop("_pq")


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Codes of one width as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _table(books: np.ndarray, query: list[float]) -> np.ndarray:
    """What every code of every part adds to the score of a query."""
    q = _parts(np.array([query], np.float64), books.shape[2])[0]
    return np.einsum("pcd,pd->pc", books, q)


def _scored(batches, table: np.ndarray):
    for batch in batches:
        if len(batch):
            codes = _bytes(batch.column("code"), len(table))
            yield batch.column("chunk_id").to_numpy(), table[np.arange(len(table)), codes].sum(1), batch.column("err").to_numpy()


def nearest(coded: DataFrame, books: np.ndarray, query: list[float], n: int) -> DataFrame:
    """(chunk_id, score) of the n best codes; a task gives at most n rows."""
    table = _table(books, query)

    def run(batches):
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        for i, s, _ in _scored(batches, table):
            ids, scores = np.concatenate([ids, i]), np.concatenate([scores, s])
            best = np.lexsort((ids, -scores))[:n]
            ids, scores = ids[best], scores[best]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scores)], ["chunk_id", "score"])

    rows = coded.where("code is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "code", "err")
    return rows.mapInArrow(run, "chunk_id long, score double").orderBy(F.desc("score"), "chunk_id").limit(n)


def search(coded: DataFrame, vectors: DataFrame, books: np.ndarray, query: list[float], limit: int = CANDIDATES, rerank: int = RERANK) -> DataFrame:
    """(chunk_id, distance): the best codes, ranked by the distance of their vectors (chunk_id, embedding)."""
    ids = [r[0] for r in nearest(coded, books, query, limit * rerank).collect()]
    return vector_candidates(vectors.where(F.col("chunk_id").isin(ids)), query, limit=limit)


def exact(coded: DataFrame, vectors: DataFrame, books: np.ndarray, query: list[float], limit: int = CANDIDATES) -> DataFrame:
    """(chunk_id, distance) of the nearest rows of all.

    The last distance of `search` is a bound: a row whose score and error together stay
    below it can't be nearer. The vectors of all other rows are read and ranked.
    """
    found = search(coded, vectors, books, query, limit).collect()
    least = 1.0 - found[-1]["distance"] - SLACK if len(found) == limit else -np.inf
    table = _table(books, query)

    def run(batches):
        for i, s, e in _scored(batches, table):
            yield pa.RecordBatch.from_arrays([pa.array(i[s + e >= least])], ["chunk_id"])

    left = coded.where("code is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "code", "err").mapInArrow(run, "chunk_id long")
    return vector_candidates(vectors.join(left.distinct(), "chunk_id", "left_semi"), query, limit=limit)


def _dealt(slots: int):
    """Codes (chunk_id, code) in blocks by slot of the id: (slot, ids, codes), at most BLOCK rows each."""

    def run(batches):
        for batch in batches:
            ids, codes = batch.column(0).to_numpy().astype(np.int64), np.array(batch.column(1).to_pylist(), object)
            own = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(slots)
            for slot in range(slots):
                at = np.flatnonzero(own == slot)
                for lo in range(0, len(at), BLOCK):
                    part = at[lo : lo + BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([ids[part].tobytes()], pa.binary()), pa.array([b"".join(codes[part])], pa.binary())], ["slot", "ids", "codes"])

    return run


def _asked(batches):
    """Queries (query_id, vector) in blocks: (q, query_ids, vectors)."""
    for batch in batches:
        for lo in range(0, len(batch), ASKED):
            part = batch.slice(lo, ASKED)
            ids = part.column(0).to_numpy().astype(np.int64)
            vectors = np.array(part.column(1).to_pylist(), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], ["q", "query_ids", "vectors"])


def _best_of_pairs(books: np.ndarray, n: int):
    """The n best codes of every query over all pairs of blocks of a task; beyond HELD rows what is held is given out early."""

    def given(held):
        for q, (score, ids) in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, ids.shape[1])), pa.array(ids.ravel()), pa.array(score.ravel())], ["query_id", "chunk_id", "score"])

    def run(batches):
        held: dict = {}
        for batch in batches:
            for ids, code, asks, vecs in zip(*(batch.column(c).to_pylist() for c in ("ids", "codes", "query_ids", "vectors"))):
                i, q = np.frombuffer(ids, np.int64), np.frombuffer(asks, np.int64)
                x = _decoded(np.frombuffer(code, np.uint8).reshape(len(i), -1), books)
                v = _parts(np.frombuffer(vecs, np.float64).reshape(len(q), -1), books.shape[2]).reshape(len(q), -1)
                score, i = v @ x.T, np.broadcast_to(i, (len(q), len(i)))
                if asks in held:
                    score, i = np.concatenate([held[asks][1][0], score], 1), np.concatenate([held[asks][1][1], i], 1)
                if n < score.shape[1]:
                    best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                    score, i = np.take_along_axis(score, best, 1), np.take_along_axis(i, best, 1)
                held[asks] = (q, (score, i))
                if sum(h[1][0].size for h in held.values()) > HELD:
                    yield from given(held)
                    held = {}
        yield from given(held)

    return run


def batch_search(coded: DataFrame, vectors: DataFrame, books: np.ndarray, queries: DataFrame, limit: int = CANDIDATES, rerank: int = RERANK, slots: int | None = None) -> DataFrame:
    """(query_id, chunk_id, rnk, distance) of many query vectors (query_id, vector).

    Codes lie in blocks by slot, queries in blocks by group, and each slot meets each group;
    there are as many of both, so that their pairs are about the session's shuffle
    partitions. A pair of slot and group gives limit * rerank rows a query, of which partial
    limits before the shuffle leave as many a task; only the best of all meet their vectors.
    """
    n, slots = limit * rerank, slots or max(1, int(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))
    asked = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), "vector")
    codes = coded.where("code is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "code").mapInArrow(_dealt(slots), "slot long, ids binary, codes binary")
    codes = codes.select("slot", each.alias("grp"), "ids", "codes")
    blocks = asked.mapInArrow(_asked, "q long, query_ids binary, vectors binary")
    blocks = blocks.select(F.pmod(F.xxhash64("q"), F.lit(slots)).alias("grp"), each.alias("slot"), "query_ids", "vectors")
    pairs = codes.join(blocks, ["slot", "grp"]).select("ids", "codes", "query_ids", "vectors").mapInArrow(_best_of_pairs(books, n), "query_id long, chunk_id long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    pairs = pairs.withColumn("r", F.row_number().over(first)).where(F.col("r") <= n).select("query_id", "chunk_id")
    met = vectors.where("embedding is not null").select("chunk_id", "embedding").join(pairs, "chunk_id").join(asked, "query_id")
    met = met.select("query_id", "chunk_id", F.round(vector.cosine_distance(F.col("embedding"), F.col("vector")), 9).alias("distance"))
    last = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return met.withColumn("rnk", F.row_number().over(last)).where(F.col("rnk") <= limit).select("query_id", "chunk_id", F.col("rnk").cast("long").alias("rnk"), "distance")
