"""Queries of URL, text, cron, chunking and discovery operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import cron, text, urls
from skarn.operators import catalog, chunk, discovery
from skarn.sources import configs

from . import fixtures as fx
from .registry import query

_NOISE = ", ".join(f"'{p}'" for p in urls.NOISE_PARAMS)
_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) END"
_URLS = f"u AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages)"
_CANON = f"""CASE WHEN NOT regexp_matches(url, '[?#]') THEN url ELSE regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN q = '' THEN '' ELSE '?' || q END END"""
_CANONED = rf"""cn AS (SELECT page_id, url, {_CANON} AS canonical FROM (SELECT page_id, url, array_to_string(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
  lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ({_NOISE})), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') AS q FROM pages))"""


def pages(spark, sf):
    return fx.table(spark, sf, "pages")


@query("canonical_urls", f"WITH {_CANONED} SELECT page_id, canonical FROM cn")
def canonical_urls(spark, sf):
    return pages(spark, sf).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query("url_host_path", f"WITH {_URLS} SELECT page_id, host, path FROM u")
def url_host_path(spark, sf):
    return pages(spark, sf).select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))


_IN, _EX = ["/en", "/fr/8/", "de"], ["/en/1", "/en/2/", "fr/80"]
_arr = lambda xs: F.array(*[F.lit(x) for x in xs])


@query("scope_allowed", f"WITH {_URLS} SELECT page_id, NOT (starts_with(path, '/en/1') OR starts_with(path, '/en/2') OR starts_with(path, '/fr/80')) AND (path = '/en' OR starts_with(path, '/en/') OR path = '/fr/8' OR starts_with(path, '/fr/8/') OR path = '/de' OR starts_with(path, '/de/')) AS allowed FROM u")
def scope_allowed(spark, sf):
    return pages(spark, sf).select("page_id", urls.in_scope(urls.path(F.col("url")), _arr(_IN), _arr(_EX)).alias("allowed"))


@query("scope_allowed_plain", f"WITH {_URLS} SELECT page_id, NOT (starts_with(path, '/en/1') OR starts_with(path, '/en/2/') OR starts_with(path, 'fr/80')) AND (starts_with(path, '/en') OR starts_with(path, '/fr/8/') OR starts_with(path, 'de')) AS allowed FROM u")
def scope_allowed_plain(spark, sf):
    return pages(spark, sf).select("page_id", urls.in_scope_plain(urls.path(F.col("url")), _arr(_IN), _arr(_EX)).alias("allowed"))


@query("same_host", f"WITH {_URLS} SELECT page_id, host = (SELECT host FROM u WHERE page_id = 1) AS same FROM u")
def same_host(spark, sf):
    first = urls.authority(F.lit(pages(spark, sf).where("page_id = 1").select("url").first()[0]))
    return pages(spark, sf).select("page_id", (urls.authority(F.col("url")) == first).alias("same"))


@query("placeholder_hosts", f"WITH {_URLS} SELECT host, host IN ('example.com', 'example.org', 'example.net', 'docs.company.com', 'localhost') OR host LIKE '%.test' OR host LIKE '%.invalid' OR host LIKE '%.example' OR host LIKE '%.localhost' AS placeholder FROM (SELECT DISTINCT replace(host, '.example.com', CASE page_id % 3 WHEN 0 THEN '.test' WHEN 1 THEN '.example.com' ELSE '' END) AS host FROM u)")
def placeholder_hosts(spark, sf):
    h = urls.host(F.col("url"))
    end = F.when(F.col("page_id") % 3 == 0, ".test").when(F.col("page_id") % 3 == 1, ".example.com").otherwise("")
    return pages(spark, sf).select(F.replace(h, F.lit(".example.com"), end).alias("host")).distinct().withColumn("placeholder", urls.is_placeholder(F.col("host")))


_SLUG = "trim(regexp_replace(lower(%s), '[^a-z0-9]+', '-', 'g'), '-')"
_NAMES = f"""nm AS (SELECT page_id, CASE WHEN seg IS NULL OR seg = '' OR seg = lab THEN lab WHEN lab = '' THEN seg ELSE lab || '-' || seg END AS name FROM (SELECT page_id,
  {_SLUG % "CASE WHEN len(list_filter(ls, lambda x: x NOT IN ('www', 'docs', 'doc', 'developers', 'developer', 'platform', 'api'))) > 0 THEN list_filter(ls, lambda x: x NOT IN ('www', 'docs', 'doc', 'developers', 'developer', 'platform', 'api'))[1] ELSE ls[1] END"} AS lab,
  {_SLUG % f"list_filter(string_split(path, '/'), lambda x: {_SLUG % 'x'} <> '' AND lower(x) NOT IN ('docs', 'doc', 'en', 'api', 'reference', 'guide'))[1]"} AS seg
  FROM (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS ls FROM u)))"""


@query("derive_names", f"WITH {_URLS}, {_NAMES} SELECT page_id, CASE WHEN n = 1 THEN name ELSE name || '-' || n END AS name FROM (SELECT page_id, CASE WHEN coalesce(name, '') = '' THEN 'source' ELSE name END AS name, row_number() OVER (PARTITION BY name ORDER BY page_id) AS n FROM nm)")
def derive_names(spark, sf):
    named = pages(spark, sf).select("page_id", urls.derived_name(F.col("url")).alias("name"))
    return urls.unique_names(named, named.limit(0), "page_id").select("page_id", "name")


@query("derived_scope", f"WITH {_URLS} SELECT page_id, CASE WHEN path IN ('', '/') THEN 0 ELSE 1 END::BIGINT AS n, path AS first FROM u WHERE path NOT IN ('', '/')")
def derived_scope(spark, sf):
    inc = urls.derived_include(F.col("url"))
    return pages(spark, sf).select("page_id", F.size(inc).cast("long").alias("n"), F.get(inc, F.lit(0)).alias("first")).where("n > 0")


@query("slugify", f"SELECT doc_id, {_SLUG % 'text'} AS slug FROM documents")
def slugify(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", urls.slugify(F.col("text")).alias("slug"))


@query("upload_urls", fx.sql("pg", "SELECT p.id, 'upload://' || s.name || '/' || p.id || '.md' AS url FROM pg p JOIN src s ON s.id = p.source_id"))
def upload_urls(spark, sf):
    p = fx.pages(spark, sf).join(fx.sources(spark, sf).select(F.col("id").alias("source_id"), "name"), "source_id")
    return p.select("id", F.concat(F.lit("upload://"), "name", F.lit("/"), F.col("id").cast("string"), F.lit(".md")).alias("url"))


@query("placeholder_cleanup", f"WITH {_URLS} SELECT regexp_matches(url, '^https?://([^/]*\\.)?example\\.com(/|$)') AS hit, count(*) AS pages FROM u GROUP BY 1".replace("\\\\", "\\"))
def placeholder_cleanup(spark, sf):
    return catalog.placeholder_counts(pages(spark, sf)).withColumnRenamed("n", "pages")


@query("dedupe_first_seen", f"WITH {_CANONED} SELECT page_id, canonical FROM (SELECT page_id, canonical, row_number() OVER (PARTITION BY canonical ORDER BY page_id) AS n FROM cn) WHERE n = 1")
def dedupe_first_seen(spark, sf):
    return catalog.dedupe_first(canonical_urls(spark, sf), "canonical", "page_id")


@query("sitemap_cap_slice", f"WITH {_CANONED}, f AS (SELECT DISTINCT 's' || page_id % 3 AS source, canonical AS url FROM cn) SELECT source, ord, url, n > 20 AS truncated, greatest(n - 20, 0) AS overflow FROM (SELECT source, url, row_number() OVER (PARTITION BY source ORDER BY url) AS ord, count(*) OVER (PARTITION BY source) AS n FROM f) WHERE ord <= 20")
def sitemap_cap_slice(spark, sf):
    found = canonical_urls(spark, sf).select(F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("source"), F.col("canonical").alias("url")).distinct()
    return discovery.capped(found, 20)


@query("bfs_levels", """WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 10 + 1 AS dst FROM lineitem), r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT l.dst, r.depth + 1 FROM r JOIN l ON l.src = r.node WHERE r.depth < 3)
  SELECT node, min(depth)::INT AS depth FROM r GROUP BY 1""")
def bfs_levels(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 10 + 1).alias("dst")).distinct()
    return discovery.reach(li, spark.range(1, 2).select(F.col("id").alias("node")), 3)


_CRON = "(VALUES ('0 0 * * *'), ('*/15 * * * *'), ('30 6 1,15 * *'), ('0 12 * * 1'), ('5 4 * 1 0'), ('1-5 * * * *'), ('60 0 * * *'), ('* * * *')) t(expr)"


@query("cron_due", f"SELECT expr, count(*) AS due FROM events, {_CRON} WHERE CASE expr WHEN '0 0 * * *' THEN minute(ts) = 0 AND hour(ts) = 0 WHEN '*/15 * * * *' THEN minute(ts) % 15 = 0 WHEN '30 6 1,15 * *' THEN minute(ts) = 30 AND hour(ts) = 6 AND day(ts) IN (1, 15) WHEN '0 12 * * 1' THEN minute(ts) = 0 AND hour(ts) = 12 AND dayofweek(ts) = 1 WHEN '5 4 * 1 0' THEN minute(ts) = 5 AND hour(ts) = 4 AND month(ts) = 1 AND dayofweek(ts) = 0 ELSE false END GROUP BY 1")
def cron_due(spark, sf):
    exprs = ["0 0 * * *", "*/15 * * * *", "30 6 1,15 * *", "0 12 * * 1", "5 4 * 1 0", "1-5 * * * *", "60 0 * * *", "* * * *"]
    parsed = spark.createDataFrame([(e,) for e in exprs], "expr string").select("expr", cron.fields(F.col("expr")).alias("f")).where("f is not null")
    return fx.table(spark, sf, "events").join(F.broadcast(parsed), cron.matches(F.col("f"), F.col("ts"))).groupBy("expr").agg(F.count("*").alias("due"))


@query("cron_fields", f"SELECT expr, expr NOT IN ('1-5 * * * *', '60 0 * * *', '* * * *') AS valid FROM {_CRON}")
def cron_fields(spark, sf):
    exprs = ["0 0 * * *", "*/15 * * * *", "30 6 1,15 * *", "0 12 * * 1", "5 4 * 1 0", "1-5 * * * *", "60 0 * * *", "* * * *"]
    return spark.createDataFrame([(e,) for e in exprs], "expr string").select("expr", cron.fields(F.col("expr")).isNotNull().alias("valid"))


@query("iso_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def iso_stamps(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("fence_lines", f"WITH {fx.SQL['lines']} SELECT conv_id, count(*) FILTER (fence) AS fences, count(*) FILTER (inside AND NOT fence) AS code, count(*) AS total FROM lf GROUP BY 1")
def fence_lines(spark, sf):
    ls = text.lines(fx.markdown(spark, sf), "conv_id", "body")
    return ls.groupBy("conv_id").agg(F.count_if("fence").alias("fences"), F.count_if(F.col("inside") & ~F.col("fence")).alias("code"), F.count("*").alias("total"))


@query("section_split", f"WITH {fx.SQL['lines']} SELECT conv_id, sec AS ord, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM (SELECT *, sum(CASE WHEN NOT inside AND NOT fence AND regexp_matches(line, '^#{{{{2}}}}\\s+') THEN cut ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY line_no) AS sec FROM (SELECT *, CASE WHEN count(*) FILTER (NOT inside AND NOT fence AND regexp_matches(line, '^#{{{{2}}}}\\s+')) OVER (PARTITION BY conv_id) >= 2 THEN 1 ELSE 0 END AS cut FROM lf)) GROUP BY 1, 2".replace("{{", "{").replace("}}", "}").replace("\\\\", "\\"))
def section_split(spark, sf):
    return text.sections(fx.markdown(spark, sf), "conv_id", "body").select("conv_id", "ord", F.md5("markdown").alias("digest"))


@query("breadcrumbs", f"WITH {fx.SQL['lines']} SELECT conv_id, line_no::INT AS line_no, CASE WHEN line LIKE '## %' THEN 'conv > ' || line[4:] ELSE line[3:] END AS path FROM lf WHERE NOT inside AND NOT fence AND (line LIKE '## %' OR line LIKE '# %')")
def breadcrumbs(spark, sf):
    return text.breadcrumbs(fx.markdown(spark, sf), "conv_id", "body")


def _index_docs(spark, sf):
    p = pages(spark, sf)
    return p.groupBy((F.col("page_id") % 12).alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("text "), "url")).otherwise(F.concat(F.lit("- [p"), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit(")"))))), "\n").alias("body"))


_INDEX = "ix AS (SELECT page_id % 12 AS id, CASE WHEN page_id % 5 = 0 THEN 'text ' || url ELSE '- [p' || page_id || '](' || url || ')' END AS line, page_id % 5 <> 0 AS link, url FROM pages)"


@query("index_classifier", f"WITH {_INDEX} SELECT id, count(*) FILTER (link) AS links, count(*) AS lines, count(*) FILTER (link) >= 3 AND count(*) FILTER (link) * 2 >= count(*) AS is_index FROM ix GROUP BY 1")
def index_classifier(spark, sf):
    return text.is_index(_index_docs(spark, sf), "id", "body")


@query("index_links", f"WITH {_INDEX} SELECT DISTINCT id, url FROM ix WHERE link AND url LIKE 'http%'")
def index_links(spark, sf):
    return text.index_links(_index_docs(spark, sf), "id", "body").select("id", "url")


@query("llms_heading_gate", "SELECT doc_id, starts_with(coalesce(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')[1], ''), '# ') AS ok FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# ' || text WHEN doc_id % 3 = 1 THEN chr(10) || '# ' || text ELSE text END AS t FROM documents)")
def llms_heading_gate(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\n# "), "text")).otherwise(F.col("text"))
    first = F.coalesce(F.get(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))
    return fx.table(spark, sf, "documents").select("doc_id", (first.startswith("# ") | (first == "#")).alias("ok"))


@query("extraction_accepted", "SELECT doc_id, length(trim(text, ' ')) >= 200 AS ok FROM documents")
def extraction_accepted(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", (F.length(F.trim("text")) >= text.MIN_EXTRACTED).alias("ok"))


@query("paragraph_counts", r"SELECT doc_id, len(list_filter(string_split_regex(replace(text, '. ', chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: trim(x, ' ') <> ''))::INT AS n FROM documents")
def paragraph_counts(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.size(text.paragraphs(F.replace(F.col("text"), F.lit(". "), F.lit("\n \n")))).alias("n"))


@query("manifest_rows", "SELECT concat_ws('|', s_suppkey, s_name, s_nationkey) AS line, NOT contains(s_name, '|') AND NOT contains(s_name, chr(10)) AS ok FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_name || '|x' ELSE s_name END AS s_name, s_nationkey FROM supplier)")
def manifest_rows(spark, sf):
    s = fx.table(spark, sf, "supplier").withColumn("s_name", F.when(F.col("s_suppkey") % 5 == 0, F.concat("s_name", F.lit("|x"))).otherwise(F.col("s_name")))
    return configs.manifest(s, ["s_suppkey", "s_name", "s_nationkey"])


_SLUGS = f"sl AS (SELECT name, {_SLUG % 'name'} AS slug FROM (SELECT n_name AS name FROM nation UNION ALL SELECT n_name || ' X' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name || '!' FROM nation WHERE n_regionkey = 2))"


@query("slug_collisions", f"WITH {_SLUGS} SELECT a.name AS a, b.name AS b FROM sl a JOIN sl b ON a.name <> b.name AND (a.slug = b.slug OR starts_with(b.slug, a.slug || '-'))")
def slug_collisions(spark, sf):
    n = fx.table(spark, sf, "nation")
    names = n.select(F.col("n_name").alias("name")).unionByName(n.where("n_regionkey = 1").select(F.concat("n_name", F.lit(" X")).alias("name"))).unionByName(n.where("n_regionkey = 2").select(F.concat("n_name", F.lit("!")).alias("name")))
    return configs.slug_clashes(names.select("name", urls.slugify(F.col("name")).alias("slug")))


@query("chunk_windows")
def chunk_windows(spark, sf):
    return chunk.chunks(fx.markdown(spark, sf), "conv_id", "body")


@query("upload_chunks")
def upload_chunks(spark, sf):
    return chunk.chunks(fx.markdown(spark, sf), "conv_id", "body", chunk.chunk_short)


@query("html_extract")
def html_extract(spark, sf):
    return chunk.extract(pages(spark, sf))


@query("page_links", r"""SELECT page_id, ord, origin || hs[ord + 1] AS url FROM (SELECT page_id, origin, hs, unnest(range(len(hs)))::INT AS ord FROM (
  SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS origin, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS hs FROM pages))""")
def page_links(spark, sf):
    return discovery.extract_links(pages(spark, sf))


@query("embed_passages")
def embed_passages(spark, sf):
    return chunk.embed_passages(fx.table(spark, sf, "documents"), "doc_id", "text")
