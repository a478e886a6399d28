"""Inverted-file index for vectors: cells of a spherical k-means, searched by the nearest few.

The centroids are fitted on at most SAMPLE vectors, those of smallest id hash; every row
is assigned. Written with partitionBy("cell"), a search reads its cells' files only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import CANDIDATES, vector_candidates

SAMPLE, ROUNDS = 20_000, 15
#: Part of the cells that a search reads: recall of the best ten is above 0.9 even where vectors hardly cluster.
PROBED = 0.65
#: Vectors and queries in a block of a batch search, about 1 MB and 0.1 MB at 64 dimensions; rows that a task of it holds, 24 bytes each.
BLOCK, ASKED, HELD = 2_048, 256, 2_000_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def sample(chunks: DataFrame) -> np.ndarray:
    """At most SAMPLE unit vectors, those of smallest id hash."""
    rows = chunks.where("embedding is not null").select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).collect()
    return _unit(np.array([r[1] for r in rows], np.float64))


def fit(chunks: DataFrame, cells: int = 64, seed: int = 1) -> np.ndarray:
    """Unit centroids (cells x dim)."""
    x = sample(chunks)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
        centres = _unit(centres)
    return centres


def assign(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """All rows with their cell, -1 without a vector."""

    @F.pandas_udf(T.IntegerType())
    def cell(v: pd.Series) -> pd.Series:
        out = np.full(len(v), -1, np.int32)
        has = v.notna().to_numpy()
        if has.any():
            out[has] = (np.stack(v[has].to_numpy()) @ centres.T).argmax(1)
        return pd.Series(out)

    return chunks.withColumn("cell", cell("embedding"))


def _probes(centres: np.ndarray, probes: int | None) -> int:
    return probes or max(1, math.ceil(PROBED * len(centres)))


def _nearest_cells(centres: np.ndarray, queries: np.ndarray, probes: int) -> np.ndarray:
    """The cells that each query reads."""
    return np.argsort(-(queries @ centres.T), axis=1)[:, :probes]


def search(indexed: DataFrame, centres: np.ndarray, query: list[float], probes: int | None = None, limit: int = CANDIDATES) -> DataFrame:
    """The nearest rows of the cells nearest to the query, by exact distance."""
    near = _nearest_cells(centres, np.array([query], np.float64), _probes(centres, probes))[0].tolist()
    return vector_candidates(indexed.where(F.col("cell").isin(near)), query, limit=limit)


def _dealt(slots: int):
    """Vectors (chunk_id, cell, embedding) in blocks by slot of the id: (slot, ids, cells, vectors), in order of cells."""

    def run(batches):
        for batch in batches:
            ids, cells = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int32)
            x = np.array(batch.column(2).to_pylist(), np.float64)
            own = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(slots)
            for slot in range(slots):
                at = np.flatnonzero(own == slot)
                at = at[np.argsort(cells[at], kind="stable")]
                for lo in range(0, len(at), BLOCK):
                    part = at[lo : lo + BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), *[pa.array([v[part].tobytes()], pa.binary()) for v in (ids, cells, x)]], ["slot", "ids", "cells", "vectors"])

    return run


def _asked(batches):
    """Queries (query_id, vector) in blocks: (q, query_ids, asked)."""
    for batch in batches:
        for lo in range(0, len(batch), ASKED):
            part = batch.slice(lo, ASKED)
            ids, x = part.column(0).to_numpy().astype(np.int64), np.array(part.column(1).to_pylist(), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["q", "query_ids", "asked"])


def _merged(held, new, limit: int):
    """The best of both lists (query number, distance, id), ties by id."""
    q, d, i = (np.concatenate(x) for x in zip(held, new))
    order = np.lexsort((i, d, q))
    q, d, i = q[order], d[order], i[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < limit
    return q[keep], d[keep], i[keep]


def _best_of_pairs(centres: np.ndarray, probes: int, limit: int):
    """The nearest rows of every query in its cells, over all pairs of blocks of a task; beyond HELD rows what is held is given out early."""

    def given(held):
        for asks, (q, d, i) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(asks, np.int64)[q]), pa.array(i), pa.array(d)], ["query_id", "chunk_id", "distance"])

    def run(batches):
        held: dict = {}
        for batch in batches:
            for ids, cells, vectors, asks, asked in zip(*(batch.column(c).to_pylist() for c in ("ids", "cells", "vectors", "query_ids", "asked"))):
                i, c, n = np.frombuffer(ids, np.int64), np.frombuffer(cells, np.int32), len(asks) // 8
                x, v = _unit(np.frombuffer(vectors, np.float64).reshape(len(i), -1)), np.frombuffer(asked, np.float64).reshape(n, -1)
                near, v = np.zeros((n, len(centres)), bool), _unit(v)
                np.put_along_axis(near, _nearest_cells(centres, np.frombuffer(asked, np.float64).reshape(n, -1), probes), True, 1)
                best = held.get(asks, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
                bounds = np.flatnonzero(np.diff(c, prepend=-2, append=len(centres)))
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    who = np.flatnonzero(near[:, c[lo]]) if c[lo] >= 0 else np.zeros(0, np.int64)
                    if not len(who):
                        continue
                    last = np.full(n, np.inf)  # what is beyond a query's last place can't enter
                    full = np.bincount(best[0], minlength=n) == limit
                    last[full] = best[1][np.searchsorted(best[0], np.flatnonzero(full), "right") - 1]
                    d = 1.0 - v[who] @ x[lo:hi].T
                    at, row = np.nonzero(d <= last[who, None] + 1e-9)
                    best = _merged(best, (who[at], np.round(d[at, row], 9) + 0.0, i[lo:hi][row]), limit)  # no minus zero
                held[asks] = best
                if sum(len(h[0]) for h in held.values()) > HELD:
                    yield from given(held)
                    held = {}
        yield from given(held)

    return run


def batch_search(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, probes: int | None = None, limit: int = CANDIDATES, slots: int | None = None) -> DataFrame:
    """(query_id, chunk_id, rnk, distance) of many query vectors (query_id, vector), each in its nearest cells.

    Vectors lie in blocks by slot, queries in blocks by group, and each slot meets each group;
    within a pair of blocks a query meets the vectors of its cells by one product of
    matrices. Slots times groups are about the session's shuffle partitions, with more
    slots than groups, as vectors are copied for every group. A task gives limit rows a query.
    """
    parts = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = slots or math.ceil(2 * parts**0.5)
    groups = math.ceil(parts / slots)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), "vector").mapInArrow(_asked, "q long, query_ids binary, asked binary")
    asked = asked.select(F.pmod(F.xxhash64("q"), F.lit(groups)).alias("grp"), every(slots).alias("slot"), "query_ids", "asked")
    rows = indexed.where("embedding is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "cell", "embedding").mapInArrow(_dealt(slots), "slot long, ids binary, cells binary, vectors binary")
    rows = rows.select("slot", every(groups).alias("grp"), "ids", "cells", "vectors")
    pairs = rows.join(asked, ["slot", "grp"]).select("ids", "cells", "vectors", "query_ids", "asked").mapInArrow(_best_of_pairs(centres, _probes(centres, probes), limit), "query_id long, chunk_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    best = pairs.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= limit)
    return best.select("query_id", "chunk_id", F.col("rnk").cast("long").alias("rnk"), "distance")
