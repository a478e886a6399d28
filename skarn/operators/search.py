"""Hybrid retrieval: two bounded candidate lists, ranks, reciprocal rank fusion, late content."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import fts, stems, vector

# Fixed values of the fusion.
RRF_K, CANDIDATES = 60, 30


def vector_candidates(chunks: DataFrame, query: list[float], source_id: int | None = None, limit: int = CANDIDATES) -> DataFrame:
    """(chunk_id, distance) of the nearest chunks: a filter below an ordered limit, no shuffle of content."""
    if source_id is not None:
        chunks = chunks.where(F.col("source_id") == source_id)
    size = sum(x * x for x in query) ** 0.5
    d = vector.cosine_distance(F.col("embedding"), vector.literal(query), norm_b=F.lit(size))
    return chunks.where("embedding is not null").select("chunk_id", F.round(d, 9).alias("distance")).orderBy("distance", "chunk_id").limit(limit)


def queries_of(text: str, configs: list[str]) -> dict[str, fts.Query]:
    """The parsed query of each language."""
    return {c: fts.parse_query(text, c) for c in configs}


def text_candidates(chunks: DataFrame, text: str, source_id: int | None = None, limit: int = CANDIDATES) -> DataFrame:
    """(chunk_id, rank) of the chunks that match a web-style query, each in its own language, best first.

    A scan: the query's words are looked up in the token array of each row, so nothing is
    exploded or grouped and no row leaves its partition but the candidates. Chunks without
    fts_config are simple ones. A query without words matches nothing.
    """
    if source_id is not None:
        chunks = chunks.where(F.col("source_id") == source_id)
    chunks = chunks.withColumn("fts_config", fts.known(F.col("fts_config")) if "fts_config" in chunks.columns else F.lit("simple"))
    queries = {c: q for c, q in queries_of(text, fts.CONFIGS).items() if fts.words_of(q)}
    has_stems = F.col("fts_config").isin(list(stems.STEMMERS))
    stemmed = {c: q for c, q in queries.items() if c in stems.STEMMERS}
    plain = {c: q for c, q in queries.items() if c not in stems.STEMMERS}
    parts = []
    if plain:
        parts.append(_scanned(chunks.where(~has_stems), plain))
    if stemmed:
        parts.append(_scanned(chunks.where(has_stems), stemmed))
    if not parts:
        return chunks.select("chunk_id", F.lit(0.0).alias("rank")).limit(0)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.orderBy(F.desc("rank"), "chunk_id").limit(limit)


def _scanned(rows: DataFrame, queries: dict[str, fts.Query]) -> DataFrame:
    """(chunk_id, rank) of the rows that match the query of their language."""
    words = sorted({w for q in queries.values() for w in fts.words_of(q)})
    if set(queries) <= set(stems.STEMMERS):
        # only tokens that a stem can come from leave the JVM
        spelt = F.transform(fts.tokens(F.col("content")), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"), stems.fold(x).alias("f")))
        near = F.filter(spelt, lambda p: stems.may_stem_to(p["f"], words))
        found = rows.select("chunk_id", "fts_config", near.alias("near")).select("chunk_id", "fts_config", F.col("near.i").alias("at"), stems.stemmed_once(F.col("near.x"), F.col("fts_config")).alias("t"))
        places = [_where(F.col("at"), F.col("t"), w).alias(f"w{k}") for k, w in enumerate(words)]
    else:
        found = rows.select("chunk_id", "fts_config", fts.tokens(F.col("content")).alias("t"))
        places = [_places(F.col("t"), w).alias(f"w{k}") for k, w in enumerate(words)]
    found = found.select("chunk_id", "fts_config", *places)
    at = lambda w: F.col(f"w{words.index(w)}")
    ok, score = F.lit(False), F.lit(0.0)
    for configs, query in fts.grouped(queries):
        own = F.col("fts_config").isin(configs)
        ok = F.when(own, fts.matches(query, at)).otherwise(ok)
        score = F.when(own, fts.rank(query, at)).otherwise(score)
    return found.where(ok).select("chunk_id", score.alias("rank"))


def _where(at: Column, stems: Column, word: str) -> Column:
    """The positions whose stem is the word."""
    return F.filter(F.zip_with(at, stems, lambda i, x: F.when(x == word, i)), lambda i: i.isNotNull())


def _places(tokens: Column, word: str) -> Column:
    """The positions of a word, from 1."""
    return F.filter(F.transform(tokens, lambda x, i: F.when(x == word, i + 1)), lambda i: i.isNotNull())


def indexed_candidates(index: DataFrame, text: str, source_id: int | None = None, limit: int = CANDIDATES) -> DataFrame:
    """The same from stored postings (fts.stored): a search reads the shards of the query's words only."""
    queries = queries_of(text, fts.CONFIGS)
    words = sorted({w for q in queries.values() for w in fts.words_of(q)})
    if not words:
        return index.select("chunk_id", F.lit(0.0).alias("rank")).limit(0)
    if "shard" in index.columns:
        index = index.where(F.col("shard").isin(fts.shards_of(index.sparkSession, words)))
    if source_id is not None:
        index = index.where(F.col("source_id") == source_id)
    return fts.matched(index, queries).orderBy(F.desc("rank"), "chunk_id").limit(limit)


def fused(near: DataFrame, matched: DataFrame, k: int = RRF_K) -> DataFrame:
    """(chunk_id, rrf) of both lists; windows and the aggregation see two bounded lists only."""
    a = near.select("chunk_id", F.row_number().over(Window.orderBy("distance", "chunk_id")).alias("rnk"))
    b = matched.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("rank"), "chunk_id")).alias("rnk"))
    return a.unionByName(b).groupBy("chunk_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rnk"))), 12).alias("rrf"))


def hybrid(chunks: DataFrame, sources: DataFrame, query: list[float], text: str, source_id: int | None = None, limit: int = 5, postings: DataFrame | None = None, cells: tuple | None = None) -> DataFrame:
    """Best chunks with their source and content, best first; the content joins at most 2 * CANDIDATES ids.

    postings (fts.stored) and cells (a table with a cell for each vector, and its
    centroids) are what a store keeps for searches; without them all chunks are scanned.
    """
    from . import ivf

    if cells is None:
        near = vector_candidates(chunks, query, source_id)
    else:
        own = cells[0] if source_id is None else cells[0].where(F.col("source_id") == source_id)
        near = ivf.search(own, cells[1], query)
    matched = text_candidates(chunks, text, source_id) if postings is None else indexed_candidates(postings, text, source_id)
    return with_content(best_of(near, matched, limit), chunks, sources)


def best_of(near: DataFrame, matched: DataFrame, limit: int) -> DataFrame:
    """(chunk_id, rrf) of the best chunks of both lists."""
    return fused(near, matched).orderBy(F.desc("rrf"), "chunk_id").limit(limit)


def with_content(best: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """A few best chunks (chunk_id, rrf) with their source and content, best first."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    hits = chunks.join(F.broadcast(best), "chunk_id")
    heading = [F.col("heading_path")] if "heading_path" in chunks.columns else []
    return hits.join(names, "source_id").select("chunk_id", "source", "url", *heading, "content", "rrf").orderBy(F.desc("rrf"), "chunk_id")


def batch_nearest(chunks: DataFrame, queries: DataFrame, limit: int = 5, block: int = 512) -> DataFrame:
    """(query_id, chunk_id, rnk, distance) of many query vectors (query_id, vector).

    The stated queries meet all chunks block by block: a task multiplies its vectors with a
    block of queries and keeps its best of every query, so a task, not a chunk, gives rows.
    """
    asked = queries.where("vector is not null").select("query_id", "vector")
    held: list = []
    out = None

    def part() -> DataFrame:
        ids = np.array([r[0] for r in held], np.int64)
        vectors = np.array([list(r[1]) for r in held], np.float64)
        return chunks.where("embedding is not null").select("chunk_id", "embedding").mapInArrow(_nearest(ids, vectors, limit), "query_id long, chunk_id long, distance double")

    for r in asked.toLocalIterator():  # a block is all the driver holds
        held.append(r)
        if len(held) == block:
            out = part() if out is None else out.unionByName(part())
            held = []
    if held or out is None:
        out = (part() if held else chunks.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", F.lit(0.0).alias("distance")).limit(0)) if out is None else out.unionByName(part())
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return out.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= limit).select("query_id", "chunk_id", F.col("rnk").cast("long").alias("rnk"), "distance")


def _nearest(ids: np.ndarray, vectors: np.ndarray, limit: int):
    """Each task's best rows of every query, by rounded distance and id."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)

    def run(batches):
        best_d, best_i = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                rows = batch.slice(lo, 1024)
                x = np.array(rows.column(1).to_pylist(), np.float64)
                d = 1.0 - unit @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                d = np.concatenate([best_d, np.round(d, 9) + 0.0], 1)  # no minus zero
                i = np.concatenate([best_i, np.broadcast_to(rows.column(0).to_numpy(), (len(ids), len(rows)))], 1)
                order = np.lexsort((i, d))[:, :limit]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        n = best_d.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], ["query_id", "chunk_id", "distance"])

    return run


def batch_text(chunks: DataFrame, queries: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, rnk) of many texts (query_id, text): text_candidates of each one's distinct words."""
    words = queries.select("query_id", F.array_distinct(fts.tokens(F.col("text"))).alias("ws"))
    words = words.select("query_id", F.size("ws").alias("of"), F.explode("ws").alias("lexeme"))
    weight = F.get(fts.weight_table(), F.least(F.col("tf"), F.lit(fts.MAX_TF)).cast("int"))
    index = fts.postings(chunks).select("chunk_id", "lexeme", weight.alias("weight"))
    ranked = index.join(words, "lexeme").groupBy("query_id", "chunk_id").agg(F.round(F.sum("weight") / F.first("of"), 9).alias("rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rank"), "chunk_id")
    return ranked.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= limit).select("query_id", "chunk_id", F.col("rnk").cast("long").alias("rnk"))


def recall(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Per expected source: cases and those whose snippet is in a hit of theirs."""
    found = hits.join(cases, "case_id").groupBy("case_id", "expected_source").agg(F.max(F.lower("content").contains(F.lower(F.col("snippet"))).cast("int")).alias("ok"))
    out = cases.select("case_id", "expected_source").join(found.select("case_id", "ok"), "case_id", "left")
    return out.groupBy("expected_source").agg(F.count("*").alias("cases"), F.sum(F.coalesce("ok", F.lit(0))).cast("long").alias("passed"))


# Results at most of a tool call and of a request, and the command line's default.
TOOL_LIMIT, REQUEST_LIMIT, SHELL_LIMIT = 20, 50, 3


def clamp(n: int, most: int = TOOL_LIMIT) -> int:
    return max(1, min(int(n), most))


def checked_query(text: str) -> str:
    if not (text or "").strip():
        raise ValueError("the query is empty")
    return text.strip()


def blocks(hits: DataFrame) -> Column:
    """All hits as one markdown text."""
    from skarn.functions.text import hit_block

    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rrf")).alias("o"), "chunk_id", hit_block(F.col("heading"), F.col("source"), F.col("url"), F.col("content")).alias("b")))), lambda x: x["b"]), "\n\n---\n\n")
