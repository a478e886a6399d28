"""Source configurations: schemas, files, validation as a column of errors, model registry."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions import cron, urls

# The text-search configurations a source may name.
LANGUAGES = (
    "simple", "arabic", "armenian", "basque", "catalan", "danish", "dutch", "english", "finnish", "french", "german", "greek", "hindi", "hungarian",
    "indonesian", "irish", "italian", "lithuanian", "nepali", "norwegian", "portuguese", "romanian", "russian", "serbian", "spanish", "swedish", "tamil", "turkish", "yiddish",
)
LLMS_MODES = ("auto", "off", "only")
STATUSES = ("active", "pending", "rejected")

SOURCE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("base_url", T.StringType()),
        T.StructField("sitemap", T.StringType()),
        T.StructField("include_prefixes", T.ArrayType(T.StringType())),
        T.StructField("exclude_prefixes", T.ArrayType(T.StringType())),
        T.StructField("max_pages", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("rate_limit_rps", T.FloatType()),
        T.StructField("llms_txt", T.StringType()),
        T.StructField("js_render", T.BooleanType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("schedule_cron", T.StringType()),
    ]
)
DEFAULTS = {"include_prefixes": [], "exclude_prefixes": [], "language": "english", "rate_limit_rps": 1.0, "llms_txt": "auto", "js_render": False, "source_type": "crawl"}


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a YAML file, all valid or none."""
    import yaml

    rows = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("sources") or []
    return frame(spark, rows)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a JSON list with a column of errors."""
    return with_errors(spark.read.schema(SOURCE).option("multiLine", True).json(path))


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows as a frame of SOURCE; unknown keys, repeated names and invalid rows raise."""
    known = set(SOURCE.fieldNames())
    for r in rows:
        if extra := set(r) - known:
            raise ValueError(f"unknown keys: {', '.join(sorted(extra))}")
    names = [r.get("name") for r in rows]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"names used twice: {', '.join(twice)}")
    full = [{**{k: None for k in known}, **DEFAULTS, **r} for r in rows]
    for r in full:
        r["rate_limit_rps"] = float(r["rate_limit_rps"])
    df = with_errors(spark.createDataFrame([tuple(r[k] for k in SOURCE.fieldNames()) for r in full], SOURCE))
    bad = df.where(F.size("errors") > 0).select("name", "errors").collect()
    if bad:
        raise ValueError("; ".join(f"{b['name']}: {', '.join(b['errors'])}" for b in bad))
    return df.drop("errors")


def errors() -> Column:
    """What is wrong with a row of SOURCE, as an array of messages."""
    c = F.col
    host, crawl = urls.host(c("base_url")), c("source_type") == "crawl"
    none = F.array().cast("array<string>")
    checks = [
        (~c("name").rlike("^[a-z0-9-]+$") | c("name").isNull(), "the name may hold a-z, 0-9 and -"),
        (~c("source_type").isin("crawl", "upload"), "the type is crawl or upload"),
        (crawl & (~c("base_url").rlike("^https?://[^/]+") | c("base_url").isNull()), "the base url is no web address"),
        (~crawl & (c("base_url") != F.concat(F.lit("upload://"), "name")), "an upload source has upload://name"),
        (crawl & urls.is_placeholder(host), "the host is a placeholder"),
        (crawl & urls.is_private(host), "the host is private"),
        (c("sitemap").isNotNull() & (urls.authority(c("sitemap")) != urls.authority(c("base_url"))), "the sitemap is on another host"),
        (crawl & c("sitemap").isNull() & ~urls.in_scope_plain(urls.path(c("base_url")), F.coalesce("include_prefixes", none), F.coalesce("exclude_prefixes", none)), "the start page is out of scope"),
        (c("max_pages") <= 0, "max_pages must be positive"),
        (c("rate_limit_rps") <= 0, "rate_limit_rps must be positive"),
        (~c("language").isin(*LANGUAGES), "unknown language"),
        (~c("llms_txt").isin(*LLMS_MODES), "llms_txt is auto, off or only"),
        (c("schedule_cron").isNotNull() & cron.fields(c("schedule_cron")).isNull(), "the schedule can't be read"),
    ]
    return F.array_compact(F.array(*[F.when(cond, msg) for cond, msg in checks]))


def with_errors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("errors", errors())


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Enabled, active sources whose schedule matches the minute; unreadable schedules never do."""
    rows = sources.where("enabled and status = 'active' and schedule_cron is not null")
    return rows.where(cron.matches(cron.fields(F.col("schedule_cron")), now))


def split_prefixes(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


# Embedding models: width, memory of ingestion and retrieval, query and passage prompts.
_BGE_PROMPT = "Represent this sentence for searching relevant passages: "
DEFAULT_MODEL = "BAAI/bge-small-en-v1.5"
MODELS = {
    "mixedbread-ai/mxbai-embed-large-v1": (1024, "3g", "2g", _BGE_PROMPT, ""),
    "intfloat/multilingual-e5-large": (1024, "3g", "2g", "query: ", "passage: "),
    "BAAI/bge-base-en-v1.5": (768, "1500m", "1g", _BGE_PROMPT, ""),
    "BAAI/bge-small-en-v1.5": (384, "1500m", "1g", _BGE_PROMPT, ""),
}


def resolve_model(name: str | None = None) -> tuple[int, str, str, str, str]:
    name = name or DEFAULT_MODEL
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; known: {', '.join(MODELS)}")
    return MODELS[name]


def model_slug(name: str) -> str:
    """The last part of a model's name as an image tag."""
    import re

    return re.sub("[^a-z0-9._-]", "-", name.rsplit("/", 1)[-1].lower())


def models(spark: SparkSession) -> DataFrame:
    """(name, dim, slug, is_default, ord): the default first, then as declared."""
    rows = [(n, m[0], model_slug(n), n == DEFAULT_MODEL, i) for i, (n, m) in enumerate(MODELS.items())]
    return spark.createDataFrame(rows, "name string, dim int, slug string, is_default boolean, ord int").orderBy(F.desc("is_default"), "ord")


def slug_clashes(rows: DataFrame) -> DataFrame:
    """Pairs of slugs of which one equals the other or begins it up to a dash: an equi-join over what stands before dashes."""
    parts = F.split("slug", "-")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "-"))
    b = rows.select(F.col("name").alias("b"), F.explode(F.array_distinct(heads)).alias("slug"))
    return rows.select(F.col("name").alias("a"), "slug").join(b, "slug").where("a <> b").select("a", "b")


def manifest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pipe-delimited lines, with a flag for values that hold a pipe or a line end."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & ~F.col(c).cast("string").rlike("[|\n]")
    return rows.select(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("line"), ok.alias("ok"))


def resolve_targets(sources: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The sources a sync works on: all active crawled ones, or the named ones, which must exist and be active."""
    crawl = sources.where("source_type <> 'upload'")
    if not wanted:
        return crawl.where("status = 'active'")
    have = {r["name"]: r["status"] for r in sources.where(F.col("name").isin(*wanted)).select("name", "status").collect()}
    if missing := [w for w in wanted if w not in have]:
        raise LookupError(f"unknown sources: {', '.join(missing)}")
    if idle := [w for w in wanted if have[w] != "active"]:
        raise PermissionError(f"not active: {', '.join(idle)}")
    return sources.where(F.col("name").isin(*wanted))
