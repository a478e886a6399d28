"""Catalogue reads and changes as functions of frames: (old, change) -> new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_sources(sources: DataFrame, status: str | None = None) -> DataFrame:
    return (sources if status is None else sources.where(F.col("status") == status)).orderBy("name")


def by_id(table: DataFrame, value, column: str = "id") -> DataFrame:
    """The row of an id; ids are unique, so one at most."""
    return table.where(F.col(column) == value).limit(1)


def by_names(sources: DataFrame, names: list[str]) -> DataFrame:
    return sources.where(F.col("name").isin(*names))


def page_validators(pages: DataFrame, source_id: int) -> DataFrame:
    """(url, etag, last_modified) of a source's pages, for conditional requests."""
    return pages.where(F.col("source_id") == source_id).select("url", "etag", "last_modified")


def page_chunks(chunks: DataFrame, page_id: int) -> DataFrame:
    """The chunks of a page in their order."""
    own = chunks.where(F.col("page_id") == page_id)
    return own.orderBy("chunk_index" if "chunk_index" in chunks.columns else "chunk_id")


def chunk_detail(chunks: DataFrame, sources: DataFrame, chunk_id: int) -> DataFrame:
    """A chunk with the name of its source."""
    return by_id(chunks, chunk_id, "chunk_id").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")


# Fixed value: addresses of sources that were never real.
PLACEHOLDER_URL = r"(?i)^https?://([^/]*\.)?example\.com(/|$)"


def placeholder_counts(rows: DataFrame, url_col: str = "url") -> DataFrame:
    """(hit, n): how many addresses a cleanup would remove and leave."""
    return rows.groupBy(F.coalesce(F.col(url_col).rlike(PLACEHOLDER_URL), F.lit(False)).alias("hit")).agg(F.count("*").alias("n"))


def without_placeholders(sources: DataFrame, pages: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without sources at placeholder addresses and all that hangs on them; a second run changes nothing."""
    gone = sources.where(F.col("base_url").rlike(PLACEHOLDER_URL)).select(F.col("id").alias("source_id"))
    lost = pages.join(gone, "source_id", "left_semi").select(F.col("id").alias("page_id"))
    kept = sources.join(gone, sources["id"] == gone["source_id"], "left_anti")
    return kept, pages.join(gone, "source_id", "left_anti").select(*pages.columns), chunks.join(lost, "page_id", "left_anti").select(*chunks.columns)


def source_counts(sources: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, name, page_count, chunk_count) of every source, zero for empty ones.

    Chunks are counted by page first, so the joins see a row per page, not per chunk.
    """
    per_page = chunks.groupBy("page_id").agg(F.count("*").alias("n"))
    per_source = pages.select("id", "source_id").join(per_page, F.col("id") == F.col("page_id"), "left").groupBy("source_id").agg(F.count("*").alias("page_count"), F.sum(F.coalesce("n", F.lit(0))).alias("chunk_count"))
    out = sources.select("id", "name").join(per_source, F.col("id") == F.col("source_id"), "left")
    return out.select("id", "name", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def page_list(pages: DataFrame, chunks: DataFrame, sources: DataFrame, source_id: int | None = None, search: str | None = None, limit: int = 100) -> DataFrame:
    """Pages with their chunk counts, newest first; a search matches urls or any chunk, case-insensitively."""
    if source_id is not None:
        pages = pages.where(F.col("source_id") == source_id)
    if search is not None:
        like = f"%{search}%"
        hits = chunks.where(F.col("content").ilike(like)).select(F.col("page_id").alias("id")).distinct().withColumn("in_chunk", F.lit(True))
        pages = pages.join(hits, "id", "left").where(F.col("url").ilike(like) | F.col("in_chunk")).drop("in_chunk")
    newest = pages.orderBy(F.desc("fetched_at"), "id").limit(limit)
    counts = chunks.select("page_id").join(F.broadcast(newest.select(F.col("id").alias("page_id"))), "page_id").groupBy("page_id").agg(F.count("*").alias("chunk_count"))
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    out = newest.join(names, "source_id").join(counts, newest["id"] == counts["page_id"], "left")
    return out.select("id", "source", "url", "fetched_at", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")).orderBy(F.desc("fetched_at"), "id")


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, base_url, source_type): new values win, but an upload source keeps its address."""
    o = old.select("name", F.col("base_url").alias("ob"), F.col("source_type").alias("ot"))
    n = new.select("name", F.col("base_url").alias("nb"), F.col("source_type").alias("nt"))
    base = F.when(F.col("nb").isNull() | (F.col("ot") == "upload"), F.coalesce("ob", "nb")).otherwise(F.col("nb"))
    return o.join(n, "name", "full_outer").select("name", base.alias("base_url"), F.coalesce("ot", "nt").alias("source_type"))


def import_classes(table: DataFrame, file: DataFrame, columns: list[str]) -> DataFrame:
    """(name, class): created, updated or skipped, null-safe over the columns; names of the file only."""
    t, f = table.alias("t"), file.alias("f")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}"))
    cls = F.when(F.col("t.name").isNull(), "created").when(same, "skipped").otherwise("updated")
    return f.join(t, F.col("t.name") == F.col("f.name"), "left").select(F.col("f.name").alias("name"), cls.alias("class"))


#: Settings of a source that a change or an import may write.
SETTINGS = ("base_url", "sitemap", "include_prefixes", "exclude_prefixes", "max_pages", "language", "rate_limit_rps", "llms_txt", "js_render", "source_type")


def update_source(sources: DataFrame, source_id: int, fields: dict) -> DataFrame:
    """Settings of one source; the result must pass the checks of a new one."""
    from skarn.sources import configs

    if unknown := set(fields) - set(SETTINGS):
        raise ValueError(f"no settings: {', '.join(sorted(unknown))}")
    row = sources.where(F.col("id") == source_id).first()
    if row is None:
        raise LookupError(f"no source {source_id}")
    now = row.asDict() | fields
    checked = configs.frame(sources.sparkSession, [{k: now[k] for k in ("name", *SETTINGS) if now.get(k) is not None}]).first()
    is_ = F.col("id") == source_id
    for k in fields:
        value = checked[k]
        lit = F.lit(value) if not isinstance(value, list) else F.array(*[F.lit(x) for x in value])
        sources = sources.withColumn(k, F.when(is_, lit.cast(sources.schema[k].dataType)).otherwise(F.col(k)))
    return sources


def import_sources(sources: DataFrame, file: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources after an import, and (name, class): new names are active, changed settings are written, all else stays."""
    columns = [c for c in SETTINGS if c in sources.columns and c in file.columns]
    classes = import_classes(sources, file, columns)
    new = file.select("name", *[F.col(c).alias(f"_{c}") for c in columns]).join(classes, "name")
    changed = new.where("class = 'updated'").withColumn("_hit", F.lit(True)).drop("class")
    out = sources.join(changed, "name", "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)))
    out = out.select(*sources.columns)
    top = sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    made = new.where("class = 'created'").withColumn("id", F.row_number().over(Window.orderBy("name"))).join(F.broadcast(top)).withColumn("id", F.col("id") + F.col("top"))
    known = {"id": F.col("id"), "name": F.col("name"), "status": F.lit("active")} | {c: F.col(f"_{c}") for c in columns}
    made = made.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in sources.schema.fields])
    return out.unionByName(made), classes


def index_validators(sources: DataFrame, source_id: int, etag: str | None, last_modified: str | None) -> DataFrame:
    """The validators of a source's index file."""
    is_ = F.col("id") == source_id
    for c, v in (("llms_etag", etag), ("llms_last_modified", last_modified)):
        held = F.col(c) if c in sources.columns else F.lit(None).cast("string")
        sources = sources.withColumn(c, F.when(is_, F.lit(v).cast("string")).otherwise(held))
    return sources


def replace_pages(pages: DataFrame, fresh: DataFrame) -> DataFrame:
    return pages.join(fresh.select("url"), "url", "left_anti").unionByName(fresh)


def refresh_validators(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """New etag and last_modified where the run brought them."""
    s = seen.select("url", F.col("etag").alias("_e"), F.col("last_modified").alias("_m"))
    return pages.join(s, "url", "left").withColumn("etag", F.coalesce("_e", "etag")).withColumn("last_modified", F.coalesce("_m", "last_modified")).drop("_e", "_m")


def delete_source(sources: DataFrame, pages: DataFrame, chunks: DataFrame, source_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a source, its pages and their chunks."""
    gone = pages.where(F.col("source_id") == source_id).select(F.col("id").alias("page_id"))
    return sources.where(F.col("id") != source_id), pages.where(F.col("source_id") != source_id), chunks.join(gone, "page_id", "left_anti")


def purge_source(sources: DataFrame, pages: DataFrame, source_id: int) -> tuple[DataFrame, DataFrame, int]:
    """A source without pages and with its metadata cleared, and how many pages went."""
    is_ = F.col("id") == source_id
    for c in ("last_synced", "last_status", "llms_etag", "llms_last_modified"):
        if c in sources.columns:
            sources = sources.withColumn(c, F.when(is_, None).otherwise(F.col(c)))
    return sources, pages.where(F.col("source_id") != source_id), pages.where(F.col("source_id") == source_id).count()


def stamp(sources: DataFrame, outcome: DataFrame, at: Column) -> DataFrame:
    """last_synced and last_status of the sources a run touched (name, status)."""
    o = outcome.select("name", F.col("status").alias("_s"))
    hit = F.col("_s").isNotNull()
    return sources.join(o, "name", "left").withColumn("last_synced", F.when(hit, at).otherwise(F.col("last_synced"))).withColumn("last_status", F.coalesce("_s", "last_status")).drop("_s")


def set_schedule(table: DataFrame, source_id: int, schedule: str | None) -> DataFrame:
    """The schedule of one source; one that can't be read is refused, null clears it."""
    from skarn.functions import cron

    if schedule is not None and table.sparkSession.range(1).select(cron.fields(F.lit(schedule)).isNull()).first()[0]:
        raise ValueError(f"the schedule {schedule} can't be read")
    return set_column(table, source_id, "schedule_cron", schedule)


def set_column(table: DataFrame, source_id: int, column: str, value, allowed: tuple | None = None) -> DataFrame:
    """One column of one source; values outside allowed are refused."""
    if allowed is not None and value not in allowed:
        raise ValueError(f"{column} must be one of {', '.join(map(str, allowed))}")
    return table.withColumn(column, F.when(F.col("id") == source_id, F.lit(value)).otherwise(F.col(column)))


def create_source(sources: DataFrame, row: dict, status: str = "pending") -> DataFrame:
    if status not in ("active", "pending", "rejected"):
        raise ValueError("status must be active, pending or rejected")
    if not sources.where(F.col("name") == row["name"]).isEmpty():
        raise ValueError(f"a source named {row['name']} exists")
    new = sources.sparkSession.createDataFrame([{**{c: None for c in sources.columns}, **row, "status": status}], sources.schema)
    return sources.unionByName(new)


def proposer(token: Column) -> Column:
    """A token's public name."""
    return F.concat(F.lit("token-"), F.substring(F.sha2(token, 256), 1, 16))


def keep_newest(snapshots: DataFrame, n: int) -> DataFrame:
    """(table, taken_at, ...): the n newest of each table; the rest may go."""
    w = Window.partitionBy("table").orderBy(F.desc("taken_at"))
    return snapshots.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def duplicate_names(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def dedupe_first(urls: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order."""
    first = F.min_by(F.struct(*urls.columns), F.col(order)).alias("r")
    return urls.groupBy(F.col(key).alias("_k")).agg(first).select("r.*")
