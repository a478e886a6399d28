"""Queries of uploads, configurations, sitemaps and streams."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.operators import discovery
from skarn.sources import configs, uploads
from skarn.streaming import rules

from . import fixtures as fx
from .registry import query


@query("upload_paths", r"""SELECT doc_id, CASE WHEN error IS NULL THEN array_to_string(ps, '/') END AS path, error FROM (SELECT *, CASE WHEN p = '' THEN 'the path is empty' WHEN contains(p, '\') THEN 'the path has a backslash' WHEN starts_with(p, '/') THEN 'the path is absolute'
  WHEN list_contains(ps, '..') THEN 'the path climbs' WHEN len(ps) = 0 THEN 'the path is empty' END AS error FROM (SELECT *, list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')) AS ps FROM (
  SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'a/./' || doc_id || '.md' WHEN 1 THEN '/' || doc_id WHEN 2 THEN 'a/../' || doc_id WHEN 3 THEN 'a\b' WHEN 4 THEN '' WHEN 5 THEN './' ELSE 'docs//' || doc_id || '.txt' END AS p FROM documents)))""")
def upload_paths(spark, sf):
    i = F.col("doc_id").cast("string")
    p = F.when(F.col("m") == 0, F.concat(F.lit("a/./"), i, F.lit(".md"))).when(F.col("m") == 1, F.concat(F.lit("/"), i)).when(F.col("m") == 2, F.concat(F.lit("a/../"), i)).when(F.col("m") == 3, "a\\b").when(F.col("m") == 4, "").when(F.col("m") == 5, "./").otherwise(F.concat(F.lit("docs//"), i, F.lit(".txt")))
    return fx.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).alias("m")).select("doc_id", uploads.rel_path(p).alias("r")).select("doc_id", "r.path", "r.error")


@query("prefix_lists", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '[,\n]'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS prefixes FROM documents")
def prefix_lists(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(configs.split_prefixes(F.col("text")), "|").alias("prefixes"))


_CONF = """cf AS (SELECT CASE id % 5 WHEN 1 THEN name || ' x' ELSE name END AS name, id % 5 AS bad FROM src)"""


@query("config_errors", fx.sql("src", "SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + f""",
{_CONF} SELECT name, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(name, '[a-z0-9-]+') THEN 'the name may hold a-z, 0-9 and -' END, CASE WHEN bad = 3 THEN 'the host is a placeholder' END, CASE WHEN bad = 2 THEN 'the host is private' END, CASE WHEN bad = 4 THEN 'max_pages must be positive' END], lambda x: x IS NOT NULL), '; ') AS errors FROM cf""")
def config_errors(spark, sf):
    s = fx.sources(spark, sf)
    bad = F.col("id") % 5
    rows = s.select(
        F.when(bad == 1, F.concat("name", F.lit(" x"))).otherwise(F.col("name")).alias("name"),
        F.when(bad == 2, "http://127.0.0.1/").when(bad == 3, "https://example.com/").otherwise(F.col("base_url")).alias("base_url"),
        F.lit(None).cast("string").alias("sitemap"), F.array().cast("array<string>").alias("include_prefixes"), F.array().cast("array<string>").alias("exclude_prefixes"),
        F.when(bad == 4, 0).otherwise(10).alias("max_pages"), F.lit("english").alias("language"), F.lit(1.0).cast("float").alias("rate_limit_rps"), F.lit("auto").alias("llms_txt"), F.lit("crawl").alias("source_type"), F.lit("0 4 * * *").alias("schedule_cron"),
    )
    return configs.with_errors(rows).select("name", F.array_join("errors", "; ").alias("errors"))


@query("sitemap_discovery", """SELECT 'm' AS source, ord, url, n > 50 AS truncated, greatest(n - 50, 0) AS overflow FROM (SELECT url, row_number() OVER (ORDER BY url) AS ord, count(*) OVER () AS n FROM (
  SELECT 'https://m.example.net/en/' || page_id || '?a=1' AS url FROM pages WHERE NOT starts_with(page_id::VARCHAR, '7'))) WHERE ord <= 50""")
def sitemap_discovery(spark, sf):
    p = fx.table(spark, sf, "pages")
    part = (F.col("page_id") % 4).cast("string")
    loc = lambda c: F.concat(F.lit("<url><loc> "), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    maps = p.groupBy(F.concat(F.lit("https://m.example.net/map"), part).alias("url")).agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(loc(F.concat(F.lit("https://m.example.net/en/"), F.col("page_id").cast("string"), F.lit("?hl=de&a=1")))), ""), F.lit("</urlset>")).alias("body"))
    index = spark.createDataFrame([("https://m.example.net/map", "<sitemapindex>" + "".join(f"<sitemap><loc>https://m.example.net/map{i}</loc></sitemap>" for i in range(6)) + "</sitemapindex>")], "url string, body string")
    roots = spark.createDataFrame([("m", "https://m.example.net/map")], "source string, url string")
    return discovery.discover(maps.unionByName(index), roots, ["/en"], ["/en/7"], 50)


@F.pandas_udf(T.BinaryType())
def _zipped(ids: pd.Series, texts: pd.Series) -> pd.Series:
    def one(i, t) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"docs/./{i}.md", t)
            z.writestr(f"{i}.bin", b"\0")
            z.writestr(zipfile.ZipInfo(f"zeros{i}.txt"), "0" * 100_000, zipfile.ZIP_DEFLATED)
        return out.getvalue()

    return pd.Series([one(i, t) for i, t in zip(ids, texts, strict=True)])


@query("zip_members", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 3 WHEN 1 THEN doc_id || '.md' ELSE 'up/' || doc_id || '.ZIP' END AS upload FROM documents) SELECT upload, member, outcome, reason, CASE WHEN outcome = 'doc' THEN text END AS text FROM (
  SELECT upload, text, unnest(CASE doc_id % 3 WHEN 0 THEN [{member: 'docs/' || doc_id || '.md', outcome: 'doc', reason: NULL}, {member: doc_id || '.bin', outcome: 'skipped', reason: 'unknown type'}, {member: 'zeros' || doc_id || '.txt', outcome: 'failed', reason: 'expands too much'}]
    WHEN 1 THEN [{member: upload, outcome: 'doc', reason: NULL}] ELSE [{member: upload, outcome: 'failed', reason: 'not an archive'}] END, recursive := true) FROM d)""")
def zip_members(spark, sf):
    """Archives, plain files and broken archives made of the documents."""
    d = fx.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 3).alias("m"))
    name = F.when(F.col("m") == 1, F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("up/"), F.col("doc_id").cast("string"), F.lit(".ZIP")))
    plain = d.where("m > 0").select(name.alias("name"), F.when(F.col("m") == 1, F.col("text")).otherwise("no").cast("binary").alias("content"))
    return uploads.documents(d.where("m = 0").select(name.alias("name"), _zipped("doc_id", "text").alias("content")).unionByName(plain))


@query("event_counters_stream", "SELECT date_trunc('day', ts) AS day, user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counters_stream(spark, sf):
    """The streaming counters run over a batch frame: the same plan without state."""
    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rules.counters(e).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "user_id", "event_type", "n")


@query("ticks_once_a_minute", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, date_trunc('minute', ts) FROM events)")
def ticks_once_a_minute(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    return rules.once_a_minute(e).agg(F.count("*").alias("n"))
