"""Incremental sync: hash differences, page outcomes, guarded purge, run classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the rules.
PURGE_RATIO, COVERAGE_FLOOR, PURGE_MIN_PAGES = 0.5, 0.3, 20
SOFT_FAIL_RATIO, SHELL_SIBLINGS, BREAKER = 0.2, 3, 3
MIN_LENGTH = 200


def hash_diff(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming (url, content_hash, ...) with old_hash and class new, same or changed; urls are global."""
    old = existing.select("url", F.col("content_hash").alias("old_hash"))
    cls = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("content_hash"), "same").otherwise("changed")
    return incoming.join(old, "url", "left").withColumn("class", cls)


def _stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def page_outcomes(fetched: DataFrame, existing: DataFrame) -> DataFrame:
    """One outcome per fetched page (source, url, fetch_ok, not_modified, markdown).

    A failed fetch is soft and protects the stored page; then not modified, too short to
    extract, unchanged, and last a page to index. A true `failed` column, where there is
    one, marks pages whose indexing went wrong.
    """
    length = F.length(_stripped(F.coalesce("markdown", F.lit(""))))
    df = hash_diff(fetched.withColumn("content_hash", F.sha2(F.coalesce("markdown", F.lit("")), 256)), existing)
    broken = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in fetched.columns else F.lit(False)
    outcome = F.when(~F.col("fetch_ok"), "fetch_failed").when(F.col("not_modified"), "not_modified").when(length < MIN_LENGTH, "soft_failed").when(F.col("class") == "same", "skipped").when(broken, "failed").otherwise("fetched")
    return df.withColumn("length", length).withColumn("outcome", outcome)


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """Counters of each source; failed fetches count as soft failures."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.groupBy("source").agg(is_("fetched").alias("pages_fetched"), is_("skipped").alias("pages_skipped"), is_("not_modified").alias("pages_not_modified"), is_("soft_failed", "fetch_failed").alias("pages_soft_failed"), is_("failed").alias("pages_failed"))


def shells(outcomes: DataFrame) -> DataFrame:
    """Soft failures that share their exact length with others of the source: likely script shells."""
    soft = outcomes.where("outcome = 'soft_failed'")
    return soft.groupBy("source", "length").agg(F.count("*").alias("pages")).where(F.col("pages") >= SHELL_SIBLINGS)


def purge_plan(existing: DataFrame, seen: DataFrame, failed: DataFrame) -> DataFrame:
    """Per source: what a purge would delete, coverage, and whether it is allowed.

    existing (source_id, url) before the run; seen (url) or (source_id, url); failed (url)
    of failed fetches. Coverage counts pages that were fetched, new ones too where seen
    says whose they are. Nothing seen refuses as well, but only the guard sets guarded.
    """
    marked = existing.join(seen.select("url", F.lit(1).alias("s")).distinct(), "url", "left").join(failed.select("url", F.lit(1).alias("f")).distinct(), "url", "left")
    own = [F.count("s").alias("seen"), F.count_if(F.col("s").isNotNull() & F.col("f").isNull()).alias("covered")]
    by = marked.groupBy("source_id").agg(F.count("*").alias("existing"), F.count_if(F.col("s").isNull()).alias("would_delete"), *own)
    if "source_id" in seen.columns:
        urls = seen.select("source_id", "url").distinct().join(failed.select("url", F.lit(1).alias("f")).distinct(), "url", "left")
        counts = urls.groupBy("source_id").agg(F.count("*").alias("seen"), F.count_if(F.col("f").isNull()).alias("covered"))
        by = by.drop("seen", "covered").join(counts, "source_id", "left").na.fill(0, ["seen", "covered"])
    ratio, coverage = F.col("would_delete") / F.col("existing"), F.col("covered") / F.col("existing")
    guarded = (F.col("seen") > 0) & (F.col("existing") >= PURGE_MIN_PAGES) & (ratio > PURGE_RATIO) & (coverage < COVERAGE_FLOOR)
    return by.withColumn("delete_ratio", F.round(ratio, 9)).withColumn("coverage", F.round(coverage, 9)).withColumn("guarded", guarded).withColumn("refused", (F.col("seen") == 0) | guarded)


def purge(existing: DataFrame, seen: DataFrame, failed: DataFrame) -> DataFrame:
    """The pages that stay: those seen, and all of a source whose purge is refused."""
    refused = purge_plan(existing, seen, failed).where("refused").select("source_id")
    gone = existing.join(seen.select("url"), "url", "left_anti").join(refused, "source_id", "left_anti").select("url")
    return existing.join(gone, "url", "left_anti")


def classify() -> Column:
    """Status of a run over its counters and signals, by rules in this order."""
    c = F.col
    good = c("fetched") + c("skipped") + c("not_modified")
    seen = good + c("soft_failed") + c("failed")
    return (
        F.when(c("cancelled"), "failed").when(good == 0, "failed").when(c("purge_refused"), "partial").when(c("aborted"), "partial").when(c("truncated"), "partial")
        .when(c("failed") > 0, "partial").when(c("soft_failed") / F.greatest(seen, F.lit(1)) > SOFT_FAIL_RATIO, "partial").otherwise("ok")
    )


FLAGS = ("cancelled", "purge_refused", "aborted", "truncated")
COUNTS = ("fetched", "skipped", "not_modified", "soft_failed", "failed")


def with_status(runs: DataFrame) -> DataFrame:
    for flag in FLAGS:
        if flag not in runs.columns:
            runs = runs.withColumn(flag, F.lit(False))
    return runs.withColumn("status", classify())


def breaker_trips(attempts: DataFrame) -> DataFrame:
    """(source, tripped_at): the first attempt that ends BREAKER failures in a row (source, ord, ok)."""
    w = Window.partitionBy("source").orderBy("ord")
    runs = attempts.withColumn("g", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("source", "g").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("n", n).where(F.col("n") == BREAKER).groupBy("source").agg(F.min("ord").alias("tripped_at"))


def totals(runs: DataFrame) -> DataFrame:
    """All sources of a run as one row; partial counts as ok."""
    sums = [F.sum(k).alias(k) for k in ("fetched", "skipped", "not_modified", "soft_failed", "failed")]
    errors = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("source")))), "; ")
    return runs.agg(*sums, errors.alias("errors"), F.when(F.max((F.col("status") == "failed").cast("int")) == 1, "failed").otherwise("ok").alias("status"))


def _signals(signals: DataFrame | None, sources: DataFrame) -> DataFrame:
    """(source_id, source, cancelled, aborted, truncated, unchanged) of every source of a run."""
    names = ["cancelled", "aborted", "truncated", "unchanged"]
    if signals is None:
        return sources.select("source_id", "source", *[F.lit(False).alias(n) for n in names])
    given = signals.select("source_id", "source", *[F.coalesce(F.col(n), F.lit(False)).alias(n) if n in signals.columns else F.lit(False).alias(n) for n in names])
    rest = sources.join(given.select("source_id"), "source_id", "left_anti").select("source_id", "source", *[F.lit(False).alias(n) for n in names])
    return given.unionByName(rest)


def page_id(url: Column, content_hash: Column) -> Column:
    """The id of a stored page: a new one with every content, the same on a repeated run."""
    return F.xxhash64(url, content_hash)


def fresh_pages(outcomes: DataFrame, columns: list[str], at: Column) -> DataFrame:
    """Rows of the pages table for what a run has fetched; columns it knows nothing of are null."""
    known = {"id": page_id(F.col("url"), F.col("content_hash")), "source_id": F.col("source_id"), "url": F.col("url"), "content_hash": F.col("content_hash"), "fetched_at": at}
    known |= {c: F.col(c) for c in ("etag", "last_modified") if c in outcomes.columns}
    return outcomes.where("outcome = 'fetched'").select(*[known.get(c, F.lit(None)).alias(c) for c in columns])


def sync(fetched: DataFrame, pages: DataFrame, seen: DataFrame | None = None, allow_purge: bool = True, signals: DataFrame | None = None, at: Column | None = None, outcomes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One sync over all sources: (pages after it, outcomes, run rows with status).

    pages has (source_id, url, content_hash) and what else the table holds; fetched
    (source_id, source, url, fetch_ok, not_modified, markdown). Changed pages are replaced,
    the rest stays, and what no longer exists goes if the guard allows it. signals
    (source_id, source, cancelled, aborted, truncated, unchanged) says how the crawl of a
    source ended: an incomplete one purges nothing, and an unchanged index keeps all pages
    and counts them as not modified. outcomes replaces those of page_outcomes, after a
    second look at some pages.
    """
    at = F.current_timestamp() if at is None else at
    out = page_outcomes(fetched, pages) if outcomes is None else outcomes
    fresh = fresh_pages(out, pages.columns, at)
    fresh = fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in pages.schema.fields])
    kept = pages.join(fresh.select("url"), "url", "left_anti")
    if {"etag", "last_modified"} <= set(pages.columns) and {"etag", "last_modified"} <= set(out.columns):
        from .catalog import refresh_validators

        kept = refresh_validators(kept, out.where("outcome = 'skipped' and (etag is not null or last_modified is not null)"))
    states = _signals(signals, out.select("source_id", "source").distinct())
    seen = seen if seen is not None else fetched.select("source_id", "url")
    plan = purge_plan(pages, seen, out.where("outcome = 'fetch_failed'").select("url"))
    whole = states.where("not (cancelled or aborted or truncated or unchanged)").select("source_id")
    plan = plan.join(whole.withColumn("whole", F.lit(True)), "source_id", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    purged = plan.where("whole and not refused").select("source_id")
    removed = states.select("source_id", F.lit(0).cast("long").alias("pages_removed"))
    if allow_purge:
        gone = pages.join(seen.select("url"), "url", "left_anti").join(purged, "source_id", "left_semi").select("source_id", "url")
        kept = kept.join(gone.select("url"), "url", "left_anti")
        removed = gone.groupBy("source_id").agg(F.count("*").alias("pages_removed"))
    guard = plan.select("source_id", "existing", (F.col("guarded") & F.col("whole") & F.lit(allow_purge)).alias("purge_refused"))
    rows = states.join(outcome_counters(out), "source", "left").join(guard, "source_id", "left").join(removed, "source_id", "left")
    rows = rows.join(shells(out).groupBy("source").agg(F.sum("pages").alias("shell_suspected")), "source", "left")
    rows = rows.na.fill(0).na.fill(False, ["purge_refused"]).select("source", *[F.col(f"pages_{k}").alias(k) for k in COUNTS], "pages_removed", "shell_suspected", "cancelled", "purge_refused", "aborted", "truncated", "unchanged", "existing")
    rows = rows.withColumn("not_modified", F.when(F.col("unchanged"), F.col("existing")).otherwise(F.col("not_modified")))
    status = F.when(F.col("unchanged") & ~F.col("cancelled"), "ok").otherwise(F.col("status"))
    return kept.unionByName(fresh), out, with_status(rows).withColumn("status", status).drop("existing", "unchanged")


def replace_chunks(chunks: DataFrame, pages: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunks of the pages that are still there, by page id, and the fresh ones (a cascade, then an insert)."""
    return chunks.join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi").select(*chunks.columns).unionByName(fresh.select(*chunks.columns))


def retry_shells(outcomes: DataFrame, rendered: DataFrame) -> DataFrame:
    """Outcomes after a second look at likely script shells, by pages rendered elsewhere (url, html).

    Only pages of a shell group are looked at, in url order and until the renderer fails
    BREAKER times in a row for a source; a page whose rendered text is long enough counts
    as fetched or, with an unchanged hash, as skipped. js_rendered marks what changed.
    """
    from .chunk import extract

    flagged = outcomes.where("outcome = 'soft_failed'").join(shells(outcomes).select("source", "length"), ["source", "length"], "left_semi")
    w = Window.partitionBy("source").orderBy("url")
    tried = flagged.select("source", "url").join(rendered.select("url", "html"), "url", "left").withColumn("ord", F.row_number().over(w)).withColumn("ok", F.col("html").isNotNull())
    tripped = breaker_trips(tried.select("source", "ord", "ok"))
    tried = tried.join(tripped, "source", "left").where("ok and (tripped_at is null or ord <= tripped_at)")
    found = extract(tried, "url").where("status = 'ok'").select(F.col("id").alias("url"), F.col("markdown").alias("_md"), F.sha2("markdown", 256).alias("_h"))
    old = outcomes.join(found, "url", "left").withColumn("js_rendered", F.col("_md").isNotNull())
    moved = F.when(F.col("_md").isNull(), F.col("outcome")).when(F.col("_h") == F.col("old_hash"), "skipped").otherwise("fetched")
    return old.withColumn("outcome", moved).withColumn("markdown", F.coalesce("_md", "markdown")).withColumn("content_hash", F.coalesce("_h", "content_hash")).drop("_md", "_h")
