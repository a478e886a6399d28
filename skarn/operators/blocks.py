"""Postings in blocks with their best weight, and top-k searches that skip blocks.

A block holds the postings of one word in one cell; a cell is a hash class of chunks, the
same for all words, of about PER_CELL chunks. Beside its postings a block says how often
the word occurs at most in one chunk, the smallest chunk id, and its sources; those
columns are read alone. From them follows the best rank that any chunk of a cell can have
under a query. Cells are opened from the best bound down; what cannot reach the last place
of the result, or ties with it behind its chunk id, stays closed. The result equals a scan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import fts

from .search import CANDIDATES, queries_of

#: Chunks of a cell, on average; cells that are opened first; cells whose names the driver may hold.
#: Each of the first cells brings a chunk of its bound or so: with as many of them as results, few others stay open.
PER_CELL, FIRST, LISTED = 128, 256, 4096
#: Parts a shard is written in.
PARTS = 16
#: Rows of a batch that is read, and about how many of their words are packed at once.
READ, PIECE = 4096, 2_000_000
#: Cells of a part that are unpacked at once, some 250,000 postings; cells a task writes at least.
SPAN, TASK = 512, 16
#: Stand for no page and no source.
NO_PAGE, NO_SOURCE = -(1 << 63), -(1 << 31)
ROW = "array<struct<chunk_id:bigint,page_id:bigint,source_id:int,positions:array<int>>>"


def cells_for(n_chunks: int) -> int:
    return max(1, n_chunks // PER_CELL)


def build(chunks: DataFrame, cells: int) -> DataFrame:
    """Blocks of the postings of chunks (chunk_id, page_id, source_id, content, fts_config), each in its own language.

    A chunk's words are grouped where it is read. The postings of one shard and part travel
    packed, some bytes each, in the only shuffle, after which rows lie as a store deals
    them (dealt of Store.commit).
    """
    spark = chunks.sparkSession
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= READ:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", READ)
    config = fts.known(F.col("fts_config"))
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE)).alias("page_id"), F.coalesce(F.col("source_id").cast("int"), F.lit(NO_SOURCE)).alias("source_id"),
        config.alias("fts_config"), F.pmod(F.xxhash64("chunk_id"), F.lit(cells)).cast("int").alias("cell"), fts.words(F.col("content"), config).alias("words"))
    # the hash of a shard is Spark's, so that searches find it
    rows = rows.withColumn("shards", F.transform("words", fts.shard))
    tasks = min(fts.SHARDS * PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), cells // TASK))
    packed = rows.mapInArrow(_packed, "shard int, part int, slice int, packed binary").repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "slice")
    return packed.mapInArrow(_unpacked, f"lexeme string, fts_config string, cell int, max_tf int, n int, first_id long, sources array<int>, rows {ROW}, shard int, part int")


def _slim(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as the largest needs: their width, count and bytes."""
    most = int(x.max()) if len(x) else 0
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    return np.array([np.dtype(kind).itemsize, len(x)], np.int64).tobytes() + x.astype(kind).tobytes()


def _wide(raw: memoryview, at: int) -> tuple[np.ndarray, int]:
    width, n = np.frombuffer(raw, np.int64, 2, at)
    return np.frombuffer(raw, f"u{width}", n, at + 16).astype(np.int64), at + 16 + int(width * n)


def _packed(batches):
    """Rows with their words as (shard, part, slice, packed), a row for each shard and part of a piece of the rows."""
    for batch in batches:
        tokens = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(tokens) // PIECE
        cuts = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield from _pieces(batch.slice(lo, hi - lo), tokens[lo:hi])


def _pieces(rows: pa.RecordBatch, tokens: np.ndarray):
    get = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(rows)), tokens)
    place = np.arange(len(row)) - np.repeat(np.cumsum(tokens) - tokens, tokens) + 1
    words, shard = pc.list_flatten(rows.column("words")), pc.list_flatten(rows.column("shards")).to_numpy(zero_copy_only=False)
    spelt = words.dictionary_encode()
    code, names = spelt.indices.to_numpy(zero_copy_only=False).astype(np.int64), spelt.dictionary
    keep = np.flatnonzero(pc.not_equal(words, "").to_numpy(zero_copy_only=False))  # stop words have left their places empty
    if not len(keep):
        return
    row, place, shard, code = row[keep], place[keep], shard[keep].astype(np.int64), code[keep]
    config = np.array([fts.CONFIGS.index(c) for c in rows.column("fts_config").to_pylist()])
    cell = get("cell").astype(np.int64)
    slice_ = cell // PARTS // SPAN
    slices = int(slice_.max()) + 1
    group = (shard * PARTS + (cell % PARTS)[row]) * slices + slice_[row]
    word = config[row] * len(names) + code
    # fewer than 2 ** 63 by far: shards, parts and slices, languages and words, rows of a piece
    key = (group * (len(fts.CONFIGS) * len(names)) + word) * len(rows) + row
    order = np.argsort(key, kind="stable")
    key, group, word, row, place = key[order], group[order], word[order], row[order], place[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))  # of postings
    tf = np.diff(start, append=len(key))
    step = np.diff(place, prepend=0)
    step[start] = place[start]
    group, word, row = group[start], word[start], row[start]
    bounds = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    ids, pages, sources = get("chunk_id").astype(np.int64), get("page_id").astype(np.int64), get("source_id").astype(np.int64)
    ends = np.append(start, len(key))
    out: dict = {"shard": [], "part": [], "slice": [], "packed": []}
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        own, at = np.unique(row[lo:hi], return_inverse=True)
        first = np.flatnonzero(np.diff(word[lo:hi], prepend=-1))
        who = word[lo:hi][first]
        text = "\n".join(names.take(pa.array(who % len(names))).to_pylist()).encode()
        raw = b"".join([
            np.array([len(own), len(text)], np.int64).tobytes(), ids[own].tobytes(), pages[own].tobytes(), sources[own].tobytes(), cell[own].tobytes(), text,
            *map(_slim, (who // len(names), np.diff(first, append=hi - lo), at, tf[lo:hi], step[ends[lo] : ends[hi]])),
        ])
        g = int(group[lo])
        for k, v in zip(out, (g // slices // PARTS, g // slices % PARTS, g % slices, len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True))):
            out[k].append(v)
    yield pa.RecordBatch.from_arrays([*[pa.array(out[k], pa.int32()) for k in ("shard", "part", "slice")], pa.array(out["packed"], pa.binary())], list(out))


def _unpacked(batches):
    """Blocks of packed postings, which come in order of shard, part and slice: a slice is held at once."""
    key, held = None, []
    for batch in batches:
        for *now, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key and held:
                yield _blocks(key, held)
                held = []
            key = now
            held.append(packed)
    if held:
        yield _blocks(key, held)


def _blocks(key: list[int], held: list[bytes]) -> pa.RecordBatch:
    words, parts, values, steps = [], [], [], []
    for packed in held:
        raw = memoryview(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True))
        n, size = map(int, np.frombuffer(raw, np.int64, 2))
        table = np.frombuffer(raw, np.int64, 4 * n, 16).reshape(4, n)
        at = 16 + 32 * n
        names = bytes(raw[at : at + size]).decode().split("\n")
        config, at = _wide(raw, at + size)
        many, at = _wide(raw, at)
        row, at = _wide(raw, at)
        tf, at = _wide(raw, at)
        step, _ = _wide(raw, at)
        parts.append(np.concatenate([table[:, row], np.repeat(config, many)[None], np.repeat(np.arange(len(names)) + len(words), many)[None], tf[None]]))
        words += names
        steps.append(step)
    ids, pages, sources, cell, config, word, tf = np.concatenate(parts, 1)
    names, spelt = np.unique(np.array(words, object), return_inverse=True)
    word, steps = spelt[word], np.concatenate(steps)
    ends = np.cumsum(tf)
    total = np.cumsum(steps)
    places = total - np.repeat((total - steps)[ends - tf], tf)
    order = np.lexsort((ids, cell, config, word))
    places = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(places, pa.int32())).take(pa.array(order))
    ids, pages, sources, cell, config, word, tf = (x[order] for x in (ids, pages, sources, cell, config, word, tf))
    new = lambda *xs: np.flatnonzero(np.any([np.diff(x, prepend=x[0] - 1) != 0 for x in xs], 0))
    one = new(ids, cell, config, word)
    if len(one) < len(ids):  # rows of one id are one chunk
        values = [sorted(p for x in places[lo:hi].to_pylist() for p in x) for lo, hi in zip(one, np.append(one[1:], len(ids)))]
        places, tf = pa.array(values, pa.list_(pa.int32())), np.add.reduceat(tf, one)
        ids, pages, sources, cell, config, word = (x[one] for x in (ids, pages, sources, cell, config, word))
    first = new(cell, config, word)
    n = np.diff(first, append=len(ids))
    null = lambda x, none, kind: pa.array(x, kind, mask=x == none)
    rows = pa.StructArray.from_arrays([pa.array(ids), null(pages, NO_PAGE, pa.int64()), null(sources, NO_SOURCE, pa.int32()), places], ["chunk_id", "page_id", "source_id", "positions"])
    block = np.repeat(np.arange(len(first)), n)
    own = np.unique(np.stack([block, sources], 1)[sources != NO_SOURCE], axis=0)
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(own[:, 0], np.arange(len(first) + 1)), pa.int32()), pa.array(own[:, 1], pa.int32()))
    return pa.RecordBatch.from_arrays([
        pa.array(names[word[first]], pa.string()), pa.array(np.array(fts.CONFIGS, object)[config[first]], pa.string()), pa.array(cell[first], pa.int32()), pa.array(np.maximum.reduceat(tf, first), pa.int32()), pa.array(n, pa.int32()), pa.array(ids[first]), listed,
        pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), rows), *[pa.array(np.full(len(first), x), pa.int32()) for x in key[:2]],
    ], ["lexeme", "fts_config", "cell", "max_tf", "n", "first_id", "sources", "rows", "shard", "part"])


def blocked(postings: DataFrame) -> DataFrame:
    """Blocks of rows (lexeme, fts_config, cell, chunk_id, page_id, source_id, positions)."""
    row = F.struct(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("page_id").cast("long").alias("page_id"), F.col("source_id").cast("int").alias("source_id"), "positions")
    by = postings.groupBy("lexeme", "fts_config", "cell").agg(F.max(F.size("positions")).alias("max_tf"), F.count("*").cast("int").alias("n"), F.min("chunk_id").cast("long").alias("first_id"), F.array_sort(F.collect_set(F.col("source_id").cast("int"))).alias("sources"), F.sort_array(F.collect_list(row)).cast(ROW).alias("rows"))
    return by.withColumn("shard", fts.shard(F.col("lexeme"))).withColumn("part", F.pmod(F.col("cell"), F.lit(PARTS)))


def opened(blocks: DataFrame, dead: DataFrame | None) -> DataFrame:
    """The live postings of blocks, a row each."""
    seq = [F.col("_seq")] if "_seq" in blocks.columns else []
    rows = blocks.select("lexeme", "fts_config", "cell", *seq, F.explode("rows").alias("r")).select("lexeme", "fts_config", "cell", *seq, "r.*")
    if dead is None or not seq:
        return rows.drop("_seq")
    return rows.join(dead, "page_id", "left").where("_dead is null or _seq >= _dead").drop("_seq", "_dead")


def merged(blocks: DataFrame, dead: DataFrame | None) -> DataFrame:
    """Blocks of several segments as one for each word and cell, without dead postings."""
    return blocked(opened(blocks, dead))


def _bound(query: fts.Query, most) -> Column:
    """The best rank of a chunk in which no word w occurs more than most(w) times."""
    words = fts.words_of(query)
    if not words:
        return F.lit(0.0)
    if len(words) == 1 or len(query) > 1:  # the same sum as the rank's, so equal where the counts are
        table, total = fts.weight_table(), F.lit(0.0)
        for w in words:
            total = total + F.get(table, F.least(most(w), F.lit(fts.MAX_TF)))
        return F.round(total / len(words), 9)
    closest = math.log(1 - math.sqrt(0.01 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2))))
    pairs = F.lit(0.0)
    held = {w: F.least(most(w), F.lit(fts.MAX_TF)).cast("double") for w in words}
    for i, x in enumerate(words):
        for y in words[i + 1 :]:
            pairs = pairs + held[x] * held[y]
    return F.round(F.greatest(1.0 - F.exp(pairs * closest), F.lit(1e-20)), 9) + 2e-9


def top(blocks: DataFrame, dead: DataFrame | None, text: str, source_id: int | None = None, limit: int = CANDIDATES) -> tuple[list[tuple[int, float]], dict] | None:
    """((chunk_id, rank) of the best, best first; how many blocks there are and were opened).

    None where an alternative of the query is made of negations alone, which postings can't answer.
    """
    queries = {c: q for c, q in queries_of(text, fts.CONFIGS).items() if fts.words_of(q)}
    words = sorted({w for q in queries.values() for w in fts.words_of(q)})
    if any(all(neg for neg, _ in g) for q in queries.values() for g in q):
        return None
    if not words:
        return [], {"blocks": 0, "opened": 0}
    own = blocks.where(F.col("shard").isin(fts.shards_of(blocks.sparkSession, words)) & F.col("lexeme").isin(words))
    heads = own if source_id is None else own.where(F.array_contains("sources", F.lit(source_id).cast("int")))
    most = [F.max(F.when(F.col("lexeme") == w, F.col("max_tf"))).alias(f"m{k}") for k, w in enumerate(words)]
    by = heads.groupBy("fts_config", "cell").agg(*most, F.min("first_id").alias("first_id"), F.count("*").alias("blocks"))
    at = lambda w: F.coalesce(f"m{words.index(w)}", F.lit(0))
    best = F.lit(None).cast("double")
    for configs, query in fts.grouped(queries):
        can = F.lit(False)
        for g in query:
            ok = F.lit(True)
            for w in {w for neg, p in g if not neg for w in p if w is not None}:
                ok = ok & (at(w) > 0)
            can = can | ok
        best = F.when(F.col("fts_config").isin(configs) & can, _bound(query, at)).otherwise(best)
    cells = by.withColumn("bound", best).groupBy("cell").agg(F.max("bound").alias("bound"), F.min("first_id").alias("first_id"), F.sum("blocks").alias("blocks")).persist()
    try:
        total = cells.agg(F.sum("blocks")).first()[0] or 0
        able = cells.where("bound is not null")
        first = [r["cell"] for r in able.orderBy(F.desc("bound"), "first_id").limit(FIRST).collect()]

        def judged(part: DataFrame) -> list[tuple[int, float]]:
            rows = opened(part, dead)
            if source_id is not None:
                rows = rows.where(F.col("source_id") == source_id)
            return [tuple(r) for r in fts.matched(rows, queries).orderBy(F.desc("rank"), "chunk_id").limit(limit).collect()]

        found = judged(own.where(F.col("cell").isin(first))) if first else []
        opened_ = cells.where(F.col("cell").isin(first)).agg(F.sum("blocks")).first()[0] or 0
        rest = able.where(~F.col("cell").isin(first)) if first else able.limit(0)
        if len(found) == limit:
            last, worst = found[-1]
            rest = rest.where((F.col("bound") > worst) | ((F.col("bound") == worst) & (F.col("first_id") <= last)))
        n, more = rest.agg(F.count("*"), F.sum("blocks")).first()
        if n:
            names = rest.select("cell")
            part = own.where(F.col("cell").isin([r[0] for r in names.collect()])) if n <= LISTED else own.join(names, "cell", "left_semi")
            found = sorted({*found, *judged(part)}, key=lambda r: (-r[1], r[0]))[:limit]
        return found, {"blocks": total, "opened": opened_ + (more or 0)}
    finally:
        cells.unpersist()
