"""The command line over a store: search, get, tree, index."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn import api
from skarn.functions import formats, text
from skarn.operators import catalog, search
from skarn.sources.store import Store


def _json(rows: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in rows.collect()], indent=2, default=str, ensure_ascii=False)


def find(store: Store, query: str, source: str | None, limit: int, as_json: bool, compact: bool) -> str:
    hits = api.search_chunks(store, query, source, limit, most=search.REQUEST_LIMIT)
    heading = F.col("heading_path") if "heading_path" in hits.columns else F.lit("")
    hits = hits.withColumn("heading_path", heading).withColumn("snippet", text.snippet(F.col("content")))
    if as_json:
        return _json(hits.select(F.col("chunk_id").alias("id"), "source", "heading_path", "url", "snippet", F.col("rrf").alias("score")))
    own = [F.col(c) for c in ("chunk_id", "source", "rrf", "heading_path", "url", "snippet")]
    lines = [r[0] for r in hits.select((formats.compact_hit if compact else formats.long_hit)(*own)).collect()]
    return ("" if compact else "\n---\n\n").join(lines) or "No matching documentation chunks found."


def get(store: Store, chunk_id: int, as_json: bool, compact: bool) -> str:
    row = catalog.chunk_detail(store.read("chunks"), store.read("sources"), chunk_id)
    heading = F.col("heading_path") if "heading_path" in row.columns else F.lit("")
    pages = store.read("pages")
    at = pages.select(F.col("id").alias("page_id"), (F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")).alias("fetched_at"))
    row = row.withColumn("heading_path", heading).join(at, "page_id", "left")
    if as_json:
        return _json(row.select(F.col("chunk_id").alias("id"), "source", "heading_path", "url", "fetched_at", "content"))
    own = [F.col(c) for c in ("chunk_id", "source", "heading_path", "url")]
    line = formats.compact_chunk(*own, F.col("content")) if compact else formats.long_chunk(*own, F.col("fetched_at"), F.col("content"))
    found = row.select(line).first()
    if found is None:
        raise LookupError(f"no chunk {chunk_id}")
    return found[0]


def tree(store: Store, as_json: bool, compact: bool) -> str:
    sources = store.read("sources")
    synced = F.col("last_synced") if "last_synced" in sources.columns else F.lit(None).cast("timestamp")
    nodes = api.source_tree(store).drop("name").join(sources.select("id", "name", "base_url", synced.alias("last_synced")), "id").orderBy("name")
    if as_json:
        return _json(nodes.select("id", "name", "base_url", "page_count", "chunk_count", "last_synced"))
    own = [F.col(c) for c in ("name", "base_url", "page_count", "chunk_count")]
    lines = [r[0] for r in nodes.select(formats.compact_node(*own) if compact else formats.long_node(*own, F.col("last_synced"))).collect()]
    return "Indexed Documentation Sources:\n" + "".join(lines) if lines else "No doc sources indexed."


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="skarn", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the store")
    p.add_argument("--json", action="store_true")
    p.add_argument("--compact", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("search")
    one.add_argument("query")
    one.add_argument("--source")
    one.add_argument("--limit", type=int, default=search.SHELL_LIMIT)
    sub.add_parser("get").add_argument("id", type=int)
    for name in ("tree", "index"):
        sub.add_parser(name)
    a = p.parse_args(args)
    store = Store(spark or SparkSession.builder.getOrCreate(), a.store)
    try:
        if a.command == "search":
            print(find(store, a.query, a.source, a.limit, a.json, a.compact))
        elif a.command == "get":
            print(get(store, a.id, a.json, a.compact))
        elif a.command == "tree":
            print(tree(store, a.json, a.compact))
        else:
            print(api.index(store))
    except (LookupError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
