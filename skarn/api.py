"""Entry points over a store: search, reads, uploads, sync, sources and the run log.

Tables of a store: sources, pages (id, source_id, url, content_hash, ...), chunks
(chunk_id, page_id, source_id, url, heading_path, chunk_index, content, embedding,
fts_config), sync_runs, search_log and, once `index` has run, postings in blocks, cells
(codes of the vectors), centroids, codebooks and index_settings. Every change commits all tables that it touches at once, as
rows added and page ids deleted; postings and cells follow the chunks in the same commit.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions import formats, stems, text, urls
from skarn.operators import blocks, catalog, chunk, health, ivf, pq, search, sync
from skarn.sources import configs, uploads
from skarn.sources.store import Conflict, Store, difference

CHUNKS = "chunk_id long, page_id long, source_id int, url string, heading_path string, chunk_index int, content string, embedding array<float>, fts_config string"


def search_chunks(store: Store, query: str, source: str | None = None, limit: int = 5, embedder: chunk.Embedder | None = None, model: str | None = None, prompt: str | None = None, most: int = search.TOOL_LIMIT) -> DataFrame:
    """(chunk_id, source, url, heading_path, content, rrf) of the best chunks, best first; the limit is held to 1..most.

    The text arm reads the query as a web search does. The query prompt is the model's
    unless another is given. Stored postings and codes are used where the store has them;
    vectors and content are read only from the files that hold the best chunks.
    """
    query, limit, version = search.checked_query(query), search.clamp(limit, most), store.version()
    dim, _, _, own, _ = configs.resolve_model(model)
    vec = (embedder or chunk.hashing_embedder(dim))([(own if prompt is None else prompt) + query])[0]
    sources, sid = store.read("sources", version), None
    if source is not None:
        row = sources.where(F.col("name") == source).select("id").first()
        sid = row[0] if row else -1
    have = store.tables(version)
    if "codebooks" in have:  # cells of an older index hold no codes: all vectors are read
        cells = store.read("cells", version)
        coarse = pq.nearest(cells if sid is None else cells.where(F.col("source_id") == sid), _codebooks(store, version), vec, pq.RERANK * search.CANDIDATES)
        near = search.vector_candidates(store.lookup("chunks", [r[0] for r in coarse.collect()], version), vec)
    else:
        near = search.vector_candidates(store.read("chunks", version), vec, sid)
    found = blocks.top(*store.raw("postings", version), query, sid) if _stemmed(store, version) else None
    if found is None:
        matched = search.text_candidates(store.read("chunks", version), query, sid)
    else:
        matched = store.spark.createDataFrame(found[0], "chunk_id long, rank double")
    best = [tuple(r) for r in search.best_of(near, matched, limit).collect()]
    chunks = store.lookup("chunks", [r[0] for r in best], version)
    return search.with_content(store.spark.createDataFrame(best, "chunk_id long, rrf double"), chunks, sources)


def timed_search(store: Store, query: str, **more) -> tuple[list, dict]:
    """The hits of a search as rows, and its line of the search log (status, seconds); a search that fails is a line too."""
    began, status, rows = time.monotonic(), "ok", []
    try:
        rows = search_chunks(store, query, **more).collect()
    except Exception:  # noqa: BLE001  whatever fails is counted
        status = "error"
    return rows, {"status": status, "seconds": time.monotonic() - began}


def log_searches(store: Store, lines: list[dict]) -> None:
    """Append lines of timed_search to the search log."""
    new = store.spark.createDataFrame([(x["status"], float(x["seconds"])) for x in lines], "status string, seconds double").withColumn("at", F.current_timestamp())
    store.commit(added={"search_log": new})
    _tidy(store)


def index(store: Store, cells: int = 64) -> int:
    """Write postings in blocks and codes of the vectors by cell for searches; the version they are in. Later commits keep them up."""
    base = store.version()
    chunks = store.read("chunks", base)
    spread = blocks.cells_for(chunks.count())
    with_vectors = chunks.where("embedding is not null")
    tables = {"postings": blocks.build(chunks, spread), "index_settings": store.spark.createDataFrame([(spread, stems.VERSION)], "cells int, stems int")}
    if not with_vectors.isEmpty():
        centres = ivf.fit(chunks, cells)
        books = pq.fit(chunks)
        tables["cells"] = _celled(with_vectors, centres, books)
        tables["codebooks"] = store.spark.createDataFrame([(p, c, [float(x) for x in v]) for p, b in enumerate(books) for c, v in enumerate(b)], "part int, code int, v array<double>")
        tables["centroids"] = store.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, v array<double>")
    return store.commit(tables, based_on=base, dealt=("postings",))


def _stemmed(store: Store, version: int) -> bool:
    """Whether the store's postings hold the stems that queries are read as; if not, chunks are scanned until indexed again."""
    if not {"postings", "index_settings"} <= set(store.tables(version)):
        return False
    row = store.read("index_settings", version).first().asDict()
    return row.get("stems") == stems.VERSION


def _codebooks(store: Store, version: int) -> np.ndarray:
    rows = store.read("codebooks", version).orderBy("part", "code").collect()
    return np.array([r["v"] for r in rows]).reshape(rows[-1]["part"] + 1, rows[-1]["code"] + 1, -1)


def _celled(chunks: DataFrame, centres: np.ndarray, books: np.ndarray) -> DataFrame:
    rows = ivf.assign(chunks.where("embedding is not null").select("chunk_id", "page_id", "source_id", "embedding"), centres)
    return pq.encode(rows, books).drop("embedding")


def _commit_change(store: Store, base: int, gone: DataFrame, fresh: DataFrame | None, tables: dict | None = None, added: dict | None = None, deleted: dict | None = None) -> int:
    """One commit of chunks without the pages gone (page_id) and with the fresh ones, of what follows from them, and of other tables."""
    have, added, deleted = store.tables(base), dict(added or {}), dict(deleted or {})
    deleted |= {t: gone for t in ("chunks", "postings", "cells") if t in have}
    if fresh is not None:
        added["chunks"] = fresh
        if _stemmed(store, base):
            spread = store.read("index_settings", base).first()["cells"]
            added["postings"] = blocks.build(fresh, spread)
        if "codebooks" in have:  # cells of an older index hold no codes: all vectors are read
            centres = np.array([r["v"] for r in store.read("centroids", base).orderBy("cell").collect()])
            added["cells"] = _celled(fresh, centres, _codebooks(store, base))
    version = store.commit(tables, based_on=base, added=added, deleted=deleted, dealt=("postings",))
    _tidy(store)
    return version


def _tidy(store: Store) -> None:
    """Merge the segments that are due; another writer that comes in between does no harm."""
    try:
        store.compact({"postings": blocks.merged})
    except Conflict:
        pass


def format_hits(hits: DataFrame) -> str:
    heading = F.coalesce(F.when(F.col("heading_path") != "", F.col("heading_path")), F.col("source")) if "heading_path" in hits.columns else F.col("source")
    rows = hits.withColumn("heading", heading).agg(search.blocks(hits.withColumn("heading", heading)).alias("b")).first()
    return rows[0] or "No matching documentation found."


def get_chunk(store: Store, chunk_id: int) -> DataFrame:
    return store.lookup("chunks", [chunk_id])


def source_tree(store: Store) -> DataFrame:
    return catalog.source_counts(store.read("sources"), store.read("pages"), store.read("chunks"))


def list_sources(store: Store, status: str | None = None) -> DataFrame:
    return catalog.list_sources(store.read("sources"), status)


def _languages(store: Store, version: int) -> DataFrame:
    """(source_id, fts_config) of every source."""
    s = store.read("sources", version)
    config = F.coalesce(F.col("language"), F.lit("english")) if "language" in s.columns else F.lit("english")
    return s.select(F.col("id").cast("int").alias("source_id"), config.alias("fts_config"))


def _chunked(store: Store, version: int, pages: DataFrame, embedder: chunk.Embedder | None, model: str | None, how=chunk.chunk_text) -> DataFrame:
    """Chunk rows of pages (id, source_id, url, markdown): split, embedded, ids from page and place."""
    dim, _, _, _, prompt = configs.resolve_model(model)
    parts = chunk.chunks(pages, "id", "markdown", how).withColumnRenamed("id", "page_id").withColumn("chunk_id", F.xxhash64("page_id", "chunk_index"))
    vectors = chunk.embed_passages(parts, "chunk_id", "content", embedder, prompt, dim=dim).withColumnRenamed("id", "chunk_id")
    rows = parts.join(vectors, "chunk_id").join(pages.select(F.col("id").alias("page_id"), F.col("source_id").cast("int").alias("source_id"), "url"), "page_id")
    rows = rows.join(_languages(store, version), "source_id", "left").withColumn("fts_config", F.coalesce("fts_config", F.lit("english")))
    return rows.select(*[x.split()[0] for x in CHUNKS.split(", ")])


def run_sync(store: Store, fetched: DataFrame, signals: DataFrame | None = None, rendered: DataFrame | None = None, embedder: chunk.Embedder | None = None, model: str | None = None, allow_purge: bool = True) -> DataFrame:
    """Sync all fetched pages; pages, their chunks, the sources' status and the run log in one commit.

    fetched and signals are those of sync.sync; rendered (url, html) gives pages of script
    shells a second look. Upload sources are left alone. Returns the run rows.
    """
    base = store.version()
    return _synced(store, base, store.read("pages", base), fetched, signals, rendered, embedder, model, allow_purge)


def _synced(store: Store, base: int, pages: DataFrame, fetched: DataFrame, signals=None, rendered=None, embedder=None, model=None, allow_purge: bool = True) -> DataFrame:
    """A sync that starts from these pages."""
    sources = store.read("sources", base)
    if "source_type" in sources.columns:
        crawled = sources.where("source_type <> 'upload'").select(F.col("id").alias("source_id"))
        fetched = fetched.join(F.broadcast(crawled) if crawled.count() <= 100_000 else crawled, "source_id", "left_semi")
    out = sync.page_outcomes(fetched, pages)
    if rendered is not None:
        out = sync.retry_shells(out, rendered)
    return _commit_run(store, base, pages, store.staged(out, "outcomes"), fetched, signals, embedder, model, allow_purge)


def _commit_run(store: Store, base: int, pages: DataFrame, out: DataFrame, fetched: DataFrame, signals: DataFrame | None, embedder, model, allow_purge: bool) -> DataFrame:
    now = F.current_timestamp()
    after, _, rows = sync.sync(fetched, pages, signals=signals, allow_purge=allow_purge, at=now, outcomes=out)
    after, before = store.staged(after, "pages"), store.read("pages", base)
    changed, old = difference(before, after, "id")
    done = out.where("outcome = 'fetched'").select(sync.page_id(F.col("url"), F.col("content_hash")).alias("id"), "source_id", "url", "markdown")
    fresh = store.staged(_chunked(store, base, done, embedder, model), "chunks")
    left = before.select("id").join(after.select("id"), "id", "left_anti")
    gone = store.staged(left.unionByName(fresh.select(F.col("page_id").alias("id"))).distinct(), "gone")
    made = fresh.join(done.select(F.col("id").alias("page_id"), "source_id").distinct(), ["page_id", "source_id"], "left_semi").groupBy("source_id").agg(F.count("*").alias("chunks_indexed"))
    names = out.select("source_id", "source").distinct()
    rows = rows.join(names.join(made, "source_id").select("source", "chunks_indexed"), "source", "left").na.fill(0, ["chunks_indexed"]).withColumn("finished_at", now)
    rows = store.staged(rows, "runs")
    sources = store.read("sources", base)
    for c, t in (("last_synced", "timestamp"), ("last_status", "string")):
        if c not in sources.columns:
            sources = sources.withColumn(c, F.lit(None).cast(t))
    sources = catalog.stamp(sources, rows.select(F.col("source").alias("name"), "status"), now)
    _commit_change(store, base, gone, fresh, {"sources": sources}, {"pages": store.staged(changed, "changed"), "sync_runs": rows}, {"pages": old})
    return rows


def sync_stream(store: Store, fetched: DataFrame, checkpoint: str, **more):
    """A stream of fetched pages into the store, each micro-batch a sync that purges nothing.

    A micro-batch that runs twice finds its pages unchanged.
    """
    from skarn.streaming import rules

    return rules.sync_batches(fetched, lambda frame, _: run_sync(store, frame, allow_purge=False, **more), checkpoint)


def ingest_uploads(store: Store, source: str, docs: DataFrame, embedder: chunk.Embedder | None = None, model: str | None = None) -> DataFrame:
    """Documents (member, text, outcome) of an upload batch into an upload source; never purges.

    Unchanged texts are skipped by hash, others chunked, embedded and replaced; failures
    count as failed pages. Returns the run row.
    """
    base = store.version()
    row = _upload_source(store, base, source)
    fetched = docs.select(
        F.lit(row["id"]).cast("int").alias("source_id"), F.lit(source).alias("source"), F.concat(F.lit(f"upload://{source}/"), "member").alias("url"), F.lit(True).alias("fetch_ok"), F.lit(False).alias("not_modified"), F.col("text").alias("markdown"), (F.col("outcome") != "doc").alias("failed"),
    )
    pages = store.read("pages", base)
    out = sync.page_outcomes(fetched, pages)
    # uploads have no least length: what was read is indexed
    short = F.when(F.col("outcome") != "soft_failed", F.col("outcome")).when(F.col("failed"), "failed").when(F.col("class") == "same", "skipped").otherwise("fetched")
    return _commit_run(store, base, pages, store.staged(out.withColumn("outcome", short), "outcomes"), fetched, None, embedder, model, False)


def _upload_source(store: Store, version: int, name: str):
    row = store.read("sources", version).where(F.col("name") == name).first()
    if row is None:
        raise LookupError(f"unknown source {name}")
    if row["source_type"] != "upload":
        raise PermissionError(f"source {name} does not accept uploads")
    return row


def upload_text(store: Store, source: str, title: str, content: str, embedder: chunk.Embedder | None = None, model: str | None = None) -> DataFrame:
    """Store one text in an upload source under its title's address, replacing an earlier one; its chunks."""
    slug, content = uploads.checked_text(title, content)
    base = store.version()
    row = _upload_source(store, base, source)
    url, pages = f"upload://{source}/{slug}.md", store.read("pages", base)
    one = store.spark.createDataFrame([(url, content, row["id"])], "url string, markdown string, source_id int").withColumn("content_hash", F.sha2("markdown", 256)).withColumn("outcome", F.lit("fetched"))
    fresh = sync.fresh_pages(one, pages.columns, F.current_timestamp()).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in pages.schema.fields])
    parts = store.staged(_chunked(store, base, one.select(sync.page_id(F.col("url"), F.col("content_hash")).alias("id"), "source_id", "url", "markdown"), embedder, model, chunk.chunk_short), "chunks")
    if parts.isEmpty():
        raise ValueError("the content has no text to index")
    old = pages.where(F.col("url") == url).select("id").unionByName(fresh.select("id")).distinct()
    _commit_change(store, base, store.staged(old, "gone"), parts, added={"pages": fresh}, deleted={"pages": old})
    return parts


def purge(store: Store, source_id: int) -> int:
    base = store.version()
    pages = store.read("pages", base)
    sources, _, n = catalog.purge_source(store.read("sources", base), pages, source_id)
    gone = store.staged(pages.where(F.col("source_id") == source_id).select("id"), "gone")
    _commit_change(store, base, gone, None, {"sources": sources}, deleted={"pages": gone})
    return n


def reindex(store: Store, fetched: DataFrame, **more) -> DataFrame:
    """Sync as if crawled sources had no pages yet: what they had goes, what was fetched comes, in one commit."""
    base = store.version()
    crawled = store.read("sources", base).where("source_type <> 'upload'").select(F.col("id").alias("source_id"))
    pages = store.read("pages", base)
    left = store.staged(pages.join(crawled, "source_id", "left_anti").select(*pages.columns), "pages")
    return _synced(store, base, left, fetched, **more)


def propose_source(store: Store, token: str, base_url: str, name: str | None = None, **fields) -> str:
    """Add a pending source; what is not given is derived from its address. Returns its name.

    Invalid settings and names that any source has, whatever its status, are refused. The
    proposer is a digest of the token.
    """
    base = store.version()
    sources = store.read("sources", base)
    one = store.spark.createDataFrame([(base_url,)], "u string").select(urls.derived_name(F.col("u")).alias("n"), urls.derived_include(F.col("u")).alias("p")).first()
    if name is None:
        like = sources.where(F.col("name").startswith(one["n"])).select("name")
        name = urls.free_name(one["n"], [r[0] for r in like.collect()])
    elif not sources.where(F.col("name") == name).isEmpty():
        raise ValueError(f"a source named {name} exists")
    row = {"name": name, "base_url": base_url, "include_prefixes": one["p"], "max_pages": urls.DEFAULT_PAGE_CAP} | {k: v for k, v in fields.items() if v is not None}
    return _create(store, base, row, "pending", token)


def create_source(store: Store, row: dict, status: str = "active") -> str:
    """Add a checked source with a status."""
    return _create(store, store.version(), row, status, None)


def _create(store: Store, base: int, row: dict, status: str, token: str | None) -> str:
    sources = store.read("sources", base)
    checked = configs.frame(store.spark, [row]).first().asDict()
    if token is not None:
        checked["proposed_by"] = store.spark.range(1).select(catalog.proposer(F.lit(token))).first()[0]
    checked["id"] = (sources.agg(F.max("id")).first()[0] or 0) + 1
    made = catalog.create_source(sources, {k: v for k, v in checked.items() if k in sources.columns}, status)
    store.commit({"sources": made}, based_on=base)
    return row["name"]


def update_source(store: Store, source_id: int, **fields) -> None:
    """Change settings of a source; name, status, schedule and the like are not settings."""
    base = store.version()
    store.commit({"sources": catalog.update_source(store.read("sources", base), source_id, fields)}, based_on=base)


def import_sources(store: Store, rows: list[dict]) -> DataFrame:
    """Create or update sources from a checked file; (name, class) of what it held."""
    base = store.version()
    file, sources = configs.frame(store.spark, rows), store.read("sources", base)
    after, classes = catalog.import_sources(sources, file)
    classes = store.staged(classes, "classes")
    store.commit({"sources": after}, based_on=base)
    return classes


def set_index_validators(store: Store, source_id: int, etag: str | None, last_modified: str | None) -> None:
    """What the index file of a source answered with, for the next conditional request."""
    base = store.version()
    store.commit({"sources": catalog.index_validators(store.read("sources", base), source_id, etag, last_modified)}, based_on=base)


def _whole(store: Store, version: int | None = None) -> dict[str, DataFrame]:
    """All tables as they read, postings in blocks."""
    return {t: blocks.merged(*store.raw(t, version)) if t == "postings" else store.read(t, version) for t in store.tables(version)}


def backup(store: Store, target: str) -> int:
    """Copy the newest version to another folder, in the same layout; the version there."""
    return Store(store.spark, target).commit(_whole(store, store.version()))


def restore(store: Store, source: str, version: int | None = None) -> int:
    """Make a backup's tables the newest version; tables it lacks stay."""
    return store.commit(_whole(Store(store.spark, source), version))


def metrics(store: Store) -> DataFrame:
    return health.one_hot(store.read("sync_runs"))


__all__ = [
    "search_chunks", "timed_search", "log_searches", "index", "format_hits", "get_chunk", "source_tree", "list_sources", "run_sync", "sync_stream", "ingest_uploads", "upload_text", "purge", "reindex",
    "propose_source", "create_source", "update_source", "import_sources", "set_index_validators", "backup", "restore", "metrics", "formats", "text", "urls",
]
