"""Queries of formats, defaults, targets and single-row changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import formats, urls
from skarn.operators import catalog, counters, discovery
from skarn.sources import configs

from . import fixtures as fx
from .catalog import _SRC2, _with, sources2
from .registry import query


def _due_sources(spark, sf):
    s = sources2(spark, sf)
    cron_ = F.when(F.col("id") % 4 == 1, "0 6 * * *").when(F.col("id") % 4 == 2, "*/30 * * * 1").when(F.col("id") % 4 == 3, "1-5 * * * *")
    return s.withColumn("enabled", F.col("id") % 5 != 0).withColumn("schedule_cron", cron_)


@query("due_sources", _with("src", _SRC2, "SELECT name FROM s2 WHERE id % 5 <> 0 AND status = 'active' AND id % 4 IN (1, 2)"))
def due_sources(spark, sf):
    return configs.due(_due_sources(spark, sf), F.lit("2024-01-01 06:00:00").cast("timestamp")).select("name")  # a Monday


@query("sync_targets", _with("src", _SRC2, "SELECT name FROM s2 WHERE status = 'active' AND source_type <> 'upload'"))
def sync_targets(spark, sf):
    return configs.resolve_targets(sources2(spark, sf)).select("name")


@query("stamp_sources", _with("src", _SRC2, "SELECT name, CASE WHEN id % 2 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS last_synced, CASE WHEN id % 2 = 0 THEN CASE id % 3 WHEN 0 THEN 'partial' ELSE 'ok' END END AS last_status FROM s2"))
def stamp_sources(spark, sf):
    s = sources2(spark, sf).withColumn("last_synced", F.expr("timestamp_ntz'2024-01-01 00:00:00'")).withColumn("last_status", F.lit(None).cast("string"))
    done = s.where("id % 2 = 0").select("name", F.when(F.col("id") % 3 == 0, "partial").otherwise("ok").alias("status"))
    return catalog.stamp(s, done, F.expr("timestamp_ntz'2024-02-01 00:00:00'")).select("name", "last_synced", "last_status")


@query("set_status", _with("src", _SRC2, "SELECT name, CASE WHEN id = 3 THEN 'rejected' ELSE status END AS status FROM s2"))
def set_status(spark, sf):
    return catalog.set_column(sources2(spark, sf), 3, "status", "rejected", configs.STATUSES).select("name", "status")


@query("purge_source_rows", _with("pg", _SRC2, "SELECT s.name, CASE WHEN s.id <> 4 THEN 'ok' END AS last_status, count(p.id) AS pages FROM s2 s LEFT JOIN pg p ON p.source_id = s.id AND s.id <> 4 GROUP BY 1, 2"))
def purge_source_rows(spark, sf):
    s, p, _ = catalog.purge_source(sources2(spark, sf).withColumn("last_status", F.lit("ok")), fx.pages(spark, sf), 4)
    n = p.groupBy("source_id").agg(F.count("*").alias("pages"))
    return s.join(n, s["id"] == n["source_id"], "left").select("name", "last_status", F.coalesce("pages", F.lit(0)).alias("pages"))


@query("sources_table", fx.sql("ck", "SELECT s.id, ' | ' || s.name || ' | ' || s.base_url || ' | ' || count(c.chunk_id) || ' | ' || CASE WHEN s.id % 2 = 0 THEN '2024-01-01T00:00:00' ELSE 'never' END || ' | ' || 'unknown' || ' | ' AS line FROM src s LEFT JOIN ck c ON c.source_id = s.id GROUP BY s.id, s.name, s.base_url"))
def sources_table(spark, sf):
    n = catalog.source_counts(fx.sources(spark, sf), fx.pages(spark, sf), fx.chunks(spark, sf)).select("id", "chunk_count")
    at = F.when(F.col("id") % 2 == 0, F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    return fx.sources(spark, sf).join(n, "id").select("id", formats.source_line(F.col("name"), F.col("base_url"), F.col("chunk_count"), at, F.lit(None).cast("string")).alias("line"))


@query("cli_lines", fx.sql("pg", r"""SELECT p.id, printf('[%d] %s > %s (score: %.3f)' || chr(10) || '  %s' || chr(10) || '  URL: %s' || chr(10), p.id, s.name, p.fts_config, p.id / 8.0, p.content_hash, p.url) AS compact,
  printf('ID: %d | Source: %s | Score: %.3f' || chr(10) || 'Heading: %s' || chr(10) || 'URL: %s' || chr(10) || 'Snippet: %s', p.id, s.name, p.id / 8.0, CASE WHEN p.id % 2 = 0 THEN s.name ELSE p.fts_config END, p.url, p.content_hash) AS long FROM pg p JOIN src s ON s.id = p.source_id"""))
def cli_lines(spark, sf):
    p = fx.pages(spark, sf).join(fx.sources(spark, sf).select(F.col("id").alias("source_id"), "name"), "source_id")
    score, heading = F.col("id") / 8.0, F.when(F.col("id") % 2 == 0, "").otherwise(F.col("fts_config"))
    return p.select("id", formats.compact_hit(F.col("id"), F.col("name"), score, F.col("fts_config"), F.col("url"), F.col("content_hash")).alias("compact"), formats.long_hit(F.col("id"), F.col("name"), score, heading, F.col("url"), F.col("content_hash")).alias("long"))


@query("cli_chunks", fx.sql("ck", r"""SELECT chunk_id, printf('# Chunk %d [%s > %s]' || chr(10) || 'URL: %s' || chr(10) || chr(10) || '%s', chunk_id, s.name, c.fts_config, c.url, regexp_replace(c.content, '^\s+|\s+$', '', 'g')) AS compact,
  printf('ID: %d' || chr(10) || 'Source: %s' || chr(10) || 'Heading: %s' || chr(10) || 'URL: %s' || chr(10), chunk_id, s.name, '', c.url) || CASE WHEN chunk_id % 2 = 0 THEN 'Fetched At: 2024-01-01T00:00:00' || chr(10) ELSE '' END || chr(10) || '---' || chr(10) || chr(10) || c.content AS long
  FROM ck c JOIN src s ON s.id = c.source_id"""))
def cli_chunks(spark, sf):
    c = fx.chunks(spark, sf).join(fx.sources(spark, sf).select(F.col("id").alias("source_id"), "name"), "source_id")
    at = F.when(F.col("chunk_id") % 2 == 0, F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    own = [F.col(x) for x in ("chunk_id", "name", "url", "content")]
    return c.select("chunk_id", formats.compact_chunk(own[0], own[1], F.col("fts_config"), own[2], own[3]).alias("compact"), formats.long_chunk(own[0], own[1], F.lit(None).cast("string"), own[2], at, own[3]).alias("long"))


@query("cli_tree", fx.sql("ck", r"""SELECT s.id, printf('  - %s (pages: %d, chunks: %d) [%s]' || chr(10), s.name, count(c.page_id), count(c.chunk_id), s.base_url) AS compact,
  printf('  - Source: %s' || chr(10) || '    Base URL: %s' || chr(10) || '    Pages: %d | Chunks: %d' || chr(10) || '    Last Synced: %s' || chr(10), s.name, s.base_url, count(c.page_id), count(c.chunk_id), CASE WHEN s.id % 2 = 0 THEN '2024-01-01T00:00:00' ELSE 'never' END) AS long
  FROM src s LEFT JOIN ck c ON c.source_id = s.id GROUP BY s.id, s.name, s.base_url"""))
def cli_tree(spark, sf):
    n = catalog.source_counts(fx.sources(spark, sf), fx.pages(spark, sf), fx.chunks(spark, sf)).drop("name").join(fx.sources(spark, sf), "id")
    at = F.when(F.col("id") % 2 == 0, F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    own = [F.col(x) for x in ("name", "base_url", "page_count", "chunk_count")]
    return n.select("id", formats.compact_node(*own).alias("compact"), formats.long_node(*own, at).alias("long"))


@query("section_addresses", r"""SELECT doc_id, regexp_replace(title, '\[([^\]]+)\]\([^)]*\)', '\1', 'g') AS bare, CASE doc_id % 3 WHEN 0 THEN 'https://x.dev/' || doc_id WHEN 1 THEN 'https://y.dev/' || doc_id ELSE 'https://b.dev/llms.txt#s-' || doc_id END AS url
  FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A [t](https://x.dev/' || doc_id || ') z' ELSE 'plain' END AS title FROM documents)""")
def section_addresses(spark, sf):
    i = F.col("doc_id").cast("string")
    d = fx.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("A [t](https://x.dev/"), i, F.lit(") z"))).otherwise("plain").alias("title"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("text\nSource: https://y.dev/"), i, F.lit("\nmore"))).otherwise("text").alias("body"))
    return d.select("doc_id", formats.bare_title(F.col("title")).alias("bare"), formats.section_url(F.lit("https://b.dev/llms.txt"), F.col("title"), F.col("body"), F.concat(F.lit("s-"), i)).alias("url"))


@query("sitemap_host_differs", "SELECT page_id, page_id % 2 = 1 AS differs FROM pages")
def sitemap_host_differs(spark, sf):
    p = fx.table(spark, sf, "pages")
    smap = F.when(F.col("page_id") % 2 == 1, F.lit("https://elsewhere.dev/s.xml")).otherwise(F.concat(urls.origin(F.col("url")), F.lit("/s.xml")))
    return p.select("page_id", (urls.authority(smap) != urls.authority(F.col("url"))).alias("differs"))


@query("creation_defaults", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 7 END AS max_pages FROM pages")
def creation_defaults(spark, sf):
    """An absent cap gets the default; one given as null stays null."""
    p = fx.table(spark, sf, "pages").select("page_id", (F.col("page_id") % 3 != 0).alias("given"), F.when(F.col("page_id") % 3 == 1, 7).alias("cap"))
    return p.select("page_id", F.when(F.col("given"), F.col("cap")).otherwise(urls.DEFAULT_PAGE_CAP).alias("max_pages"))


@query("first_available_index", "SELECT 's' || page_id AS source, CASE WHEN page_id % 3 = 0 THEN '/llms.txt' ELSE '/llms-full.txt' END AS url FROM pages WHERE page_id % 3 <> 2")
def first_available_index(spark, sf):
    p = fx.table(spark, sf, "pages").select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("source"), (F.col("page_id") % 3).alias("m"))
    full = p.select("source", F.lit(1).alias("preference"), F.lit("/llms-full.txt").alias("url"), F.when(F.col("m") == 1, 200).otherwise(404).alias("status"), F.lit("# T").alias("body"))
    short = p.select("source", F.lit(2).alias("preference"), F.lit("/llms.txt").alias("url"), F.lit(200).alias("status"), F.when(F.col("m") == 2, " ").otherwise("# T").alias("body"))
    return discovery.first_available(full.unionByName(short)).select("source", "url")


#: The registry's fixed values, the default first.
_REGISTRY = "(VALUES ('BAAI/bge-small-en-v1.5', 384, 'bge-small-en-v1.5', true, 3), ('mixedbread-ai/mxbai-embed-large-v1', 1024, 'mxbai-embed-large-v1', false, 0), ('intfloat/multilingual-e5-large', 1024, 'multilingual-e5-large', false, 1), ('BAAI/bge-base-en-v1.5', 768, 'bge-base-en-v1.5', false, 2)) t(name, dim, slug, is_default, ord)"


@query("model_registry", f"SELECT * FROM {_REGISTRY}")
def model_registry(spark, sf):
    return configs.models(spark)


_SAMPLES = """sm AS (SELECT source, name, "at", (sum(n) OVER (PARTITION BY source, name ORDER BY "at") % 50)::DOUBLE AS value FROM (
  SELECT 'b' || user_id % 4 AS source, event_type AS name, date_trunc('hour', ts) AS "at", count(*) AS n FROM events GROUP BY 1, 2, 3))"""
_INCREASE = f"""WITH {_SAMPLES},
ask AS (SELECT DISTINCT source, name, time_bucket(INTERVAL 2 HOURS, "at") + INTERVAL (2 * k) HOURS AS t FROM sm, range(0, 16) r(k)),
met AS (SELECT a.source, a.name, a.t, s."at", s.value, lag(s.value) OVER (PARTITION BY a.source, a.name, a.t ORDER BY s."at") AS was
  FROM ask a JOIN sm s ON s.source = a.source AND s.name = a.name AND s."at" > a.t - INTERVAL 30 HOURS AND s."at" <= a.t),
one AS (SELECT source, name, t, count(*) AS n, arg_min(value, "at") AS v0, arg_max(value, "at") - arg_min(value, "at") + sum(CASE WHEN value < was THEN was ELSE 0 END) AS grown,
  date_diff('second', min("at"), max("at"))::DOUBLE AS seen, date_diff('second', t - INTERVAL 30 HOURS, min("at"))::DOUBLE AS d0, date_diff('second', max("at"), t)::DOUBLE AS d1 FROM met GROUP BY 1, 2, 3 HAVING count(*) > 1),
two AS (SELECT *, CASE WHEN d0 >= 1.1 * seen / (n - 1) THEN seen / (n - 1) / 2 ELSE d0 END AS e0, CASE WHEN d1 >= 1.1 * seen / (n - 1) THEN seen / (n - 1) / 2 ELSE d1 END AS e1 FROM one),
inc AS (SELECT source, name, t AS "at", grown * (seen + e1 + CASE WHEN grown > 0 THEN least(e0, seen * v0 / grown) ELSE e0 END) / seen AS increase FROM two)"""


def _increases(spark, sf):
    return counters.increases(fx.samples(spark, sf), ["source", "name"], step=7200)


@query("counter_increase", f"""{_INCREASE} SELECT source, name, "at"::TIMESTAMP AS "at", round(increase, 6) AS increase FROM inc""")
def counter_increase(spark, sf):
    return _increases(spark, sf).select("source", "name", F.col("at").cast("timestamp_ntz").alias("at"), F.round("increase", 6).alias("increase"))


@query("counter_ratio_firing", f"""{_INCREASE},
wide AS (SELECT source, "at", max(increase) FILTER (name = 'purchase') AS a, max(increase) FILTER (name = 'view') AS b, max(increase) FILTER (name = 'click') AS c, max(increase) FILTER (name = 'error') AS d FROM inc GROUP BY 1, 2),
bad AS (SELECT source, "at", row_number() OVER (PARTITION BY source ORDER BY "at") AS i FROM wide WHERE d / greatest(a + b + c + d, 1) > 0.2 AND a + b + c + d > 20),
isle AS (SELECT source, "at", min("at") OVER (PARTITION BY source, "at" - INTERVAL (2 * i) HOURS) AS since FROM bad)
SELECT source, "at"::TIMESTAMP AS "at", since::TIMESTAMP AS since FROM isle WHERE "at" - since >= INTERVAL 4 HOURS""")
def counter_ratio_firing(spark, sf):
    named = F.create_map(*[F.lit(x) for x in ("purchase", "fetched", "view", "skipped", "click", "not_modified", "error", "soft_failed")])
    inc = _increases(spark, sf).withColumn("name", F.element_at(named, F.col("name")))
    out = counters.firing(counters.ratio_high(inc, "soft_failed"), 4 * 3600, step=7200)
    return out.select("source", F.col("at").cast("timestamp_ntz").alias("at"), F.col("since").cast("timestamp_ntz").alias("since"))
