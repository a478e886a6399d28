"""The catalogue's tables as views over the driver's tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LANG = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
#: Sources that are broadcast.
FEW = 300_000
_LANG_SQL = "CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' ELSE 'simple' END"

SQL = {
    "src": """src AS (SELECT row_number() OVER (ORDER BY source) AS id, source AS name, 'https://' || source || '.example-docs.dev/' AS base_url
      FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))""",
    "pg": f"""pg AS (SELECT d.doc_id AS id, s.id AS source_id, s.base_url || 'docs/' || d.doc_id AS url, sha256(d.text) AS content_hash, d.text, {_LANG_SQL} AS fts_config, d.n_chars
      FROM documents d JOIN src s ON s.name = d.source)""",
    "ck": """ck AS (SELECT p.id AS chunk_id, p.id AS page_id, p.source_id, p.url, p.text AS content, p.fts_config, e.embedding FROM pg p LEFT JOIN embeddings e ON e.vec_id = p.id)""",
    "tok": r"""tok AS (SELECT chunk_id, lexeme, count(*) AS tf FROM (SELECT chunk_id, unnest(list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS lexeme FROM ck) GROUP BY ALL)""",
    "prev": """prev AS (SELECT id, source_id, url, sha256(CASE WHEN id % 5 = 0 THEN '~' || text ELSE text END) AS content_hash FROM pg WHERE id % 7 <> 0)""",
    "runs": """runs AS (SELECT 'u' || user_id AS source, date_trunc('day', ts) AS finished_at,
        count(*) FILTER (event_type = 'purchase') AS fetched, count(*) FILTER (event_type = 'view') AS skipped,
        count(*) FILTER (event_type = 'click') AS not_modified, count(*) FILTER (event_type = 'error') AS soft_failed,
        count(*) FILTER (event_type = 'signup') AS failed FROM events GROUP BY 1, 2)""",
    "busy": """busy AS (SELECT 'b' || g AS source, finished_at, fetched, skipped, not_modified, e * (1 + g) AS soft_failed, s * g AS shell_suspected FROM (SELECT user_id % 4 AS g, date_trunc('day', ts) AS finished_at,
        count(*) FILTER (event_type = 'purchase') AS fetched, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'click') AS not_modified,
        count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY 1, 2))""",
    "lines": """md AS (SELECT conv_id, string_agg('## ' || role || ' ' || turn || chr(10) || CASE WHEN turn % 5 = 4 THEN '```' || chr(10) || '# ' || text || chr(10) || '```' ELSE text END, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
      ls AS (SELECT conv_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT conv_id, string_split('# conv' || chr(10) || body, chr(10)) AS a FROM md)),
      lf AS (SELECT *, ltrim(line) LIKE '```%' AS fence, sum(CASE WHEN ltrim(line) LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY line_no) % 2 = 1 AS inside FROM ls)""",
}
_NEEDS = {"pg": ["src"], "ck": ["src", "pg"], "tok": ["src", "pg", "ck"], "prev": ["src", "pg"]}


def sql(views: str, body: str) -> str:
    """body with the named views, and those they need, in front."""
    names: list[str] = []
    for v in views.split():
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name, base_url): a small catalogue, numbered in one task on purpose."""
    names = table(spark, sf, "documents").where("source is not null").select(F.col("source").alias("name")).distinct()
    return names.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name", F.concat(F.lit("https://"), "name", F.lit(".example-docs.dev/")).alias("base_url"))


def pages(spark: SparkSession, sf: str, few: bool = False) -> DataFrame:
    """The pages of all sources, which are broadcast if they are few."""
    lang = F.lit("simple")
    for k, v in LANG.items():
        lang = F.when(F.col("lang") == k, v).otherwise(lang)
    d = table(spark, sf, "documents")
    s = sources(spark, sf).withColumnRenamed("id", "source_id")
    url = F.concat("base_url", F.lit("docs/"), F.col("doc_id").cast("string"))
    return d.join(F.broadcast(s) if few else s, d["source"] == s["name"]).select(F.col("doc_id").alias("id"), "source_id", url.alias("url"), F.sha2("text", 256).alias("content_hash"), "text", lang.alias("fts_config"), "n_chars")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf)
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return p.join(e, p["id"] == e["vec_id"], "left").select(F.col("id").alias("chunk_id"), F.col("id").alias("page_id"), "source_id", "url", F.col("text").alias("content"), "fts_config", "embedding")


def previous(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf).where("id % 7 <> 0")
    return p.select("id", "source_id", "url", F.sha2(F.when(F.col("id") % 5 == 0, F.concat(F.lit("~"), "text")).otherwise(F.col("text")), 256).alias("content_hash"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"fetched": "purchase", "skipped": "view", "not_modified": "click", "soft_failed": "error", "failed": "signup"}
    e = table(spark, sf, "events")
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.date_trunc("day", "ts").alias("finished_at")).agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()])


def busy_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of four sources with many pages, some with many soft failures and likely shells."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    own = F.col("user_id") % 4
    by = table(spark, sf, "events").withColumn("g", own).groupBy("g", F.date_trunc("day", "ts").alias("finished_at"))
    out = by.agg(n("purchase").alias("fetched"), n("view").alias("skipped"), n("click").alias("not_modified"), n("error").alias("e"), n("signup").alias("s"))
    return out.select(F.concat(F.lit("b"), F.col("g").cast("string")).alias("source"), "finished_at", "fetched", "skipped", "not_modified", (F.col("e") * (F.col("g") + 1)).alias("soft_failed"), (F.col("s") * F.col("g")).alias("shell_suspected"))


def plain_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks in the simple configuration."""
    return chunks(spark, sf).withColumn("fts_config", F.lit("simple"))


def language_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks in their languages without stems, which SQL lacks, English ones in the simple configuration."""
    return chunks(spark, sf).withColumn("fts_config", _without_stems(F.col("fts_config")))


def _without_stems(config: Column) -> Column:
    return F.when(config == "english", "simple").otherwise(F.concat(config, F.lit("_exact")))


def language_texts(spark: SparkSession, sf: str) -> DataFrame:
    """language_chunks without vectors. Where no vec_id comes twice, their join changes no row, and no content is shuffled for it or for few sources."""
    twice = table(spark, sf, "embeddings").where("vec_id is not null").groupBy("vec_id").count().where("count > 1")
    if not twice.isEmpty():
        return language_chunks(spark, sf).drop("embedding")
    p = pages(spark, sf, few=sources(spark, sf).count() <= FEW)
    return p.select(F.col("id").alias("chunk_id"), F.col("id").alias("page_id"), "source_id", "url", F.col("text").alias("content"), _without_stems(F.col("fts_config")).alias("fts_config"))


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, body): a heading, then a section for each turn, every fifth one fenced."""
    c = table(spark, sf, "conversations")
    body = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("```\n# "), "text", F.lit("\n```"))).otherwise(F.col("text"))
    part = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), body)
    by = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    return by.select("conv_id", F.concat(F.lit("# conv\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n")).alias("body"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(source, name, at, value): counters of four sources by the hour, which restart at every 50th event."""
    e = table(spark, sf, "events")
    by = e.groupBy(F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("source"), F.col("event_type").alias("name"), F.date_trunc("hour", "ts").alias("at")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("source", "name").orderBy("at"))
    return by.select("source", "name", "at", (so_far % 50).cast("double").alias("value"))
