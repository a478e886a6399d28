"""Crawls over recorded fetches: index files, sitemaps or links, redirects, caps, run signals.

sources (source_id, source, base_url, sitemap, include_prefixes, exclude_prefixes,
max_pages, llms_txt); fetches (url, status, body, location, etag, last_modified), one
recorded answer of each url; robots (host, status, body); validators (url, etag,
last_modified) of an earlier sync, sent with the first request of a url. An url that was
never recorded is a failed fetch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import formats, text, urls

from . import discovery

# Redirects that are followed, and the index files in the order they are tried.
MAX_REDIRECTS = 5
INDEX_FILES = ("/llms-full.txt", "/llms.txt")
#: Levels of links that are followed at most.
MAX_DEPTH = 100
ITEM = ["source_id", "source", "ord", "url", "fetch_ok", "not_modified", "html", "markdown", "heading_path", "etag", "last_modified"]
_NO_CAP = (1 << 62) - 1


def _kept(df: DataFrame) -> DataFrame:
    """A frame that a loop reads again: checkpointed where the session has a folder for it, else cached."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    held = df.cache()
    if not spark.sparkContext.getCheckpointDir():
        return held
    out = held.checkpoint()
    held.unpersist()
    return out


def _bare(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^#]*)", 1)


def _heads(body: Column) -> Column:
    """Whether the first line that isn't blank is a heading of level 1."""
    first = F.trim(F.coalesce(F.get(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), F.lit(0)), F.lit("")))
    return first.startswith("# ") | (first == "#")


def index_state(sources: DataFrame, fetches: DataFrame, validators: DataFrame) -> DataFrame:
    """(source_id, state, url, body) of the conditional index check.

    The first index file with a validator decides: unchanged by a 304, fetched by an answer
    with content, else none; sources without a validator have no row.
    """
    tried = F.posexplode(F.array(*[F.concat(urls.origin(F.col("base_url")), F.lit(x)) for x in INDEX_FILES])).alias("preference", "url")
    known = validators.where("etag is not null or last_modified is not null").select("url").distinct()
    first = sources.select("source_id", tried).join(known, "url").groupBy("source_id").agg(F.min_by("url", "preference").alias("url"))
    got = first.join(fetches.select("url", "status", "body"), "url", "left")
    state = F.when(F.col("status") == 304, "unchanged").when((F.col("status") == 200) & (F.trim(F.coalesce("body", F.lit(""))) != ""), "fetched").otherwise("none")
    return got.select("source_id", state.alias("state"), "url", F.when(state == "fetched", F.col("body")).alias("body"))


def index_files(sources: DataFrame, fetches: DataFrame, states: DataFrame) -> DataFrame:
    """(source_id, url, body) of the index file that each source goes by, if there is one.

    The full file comes first; one that does not open with a heading is passed over. What
    the conditional check has fetched is not looked for again.
    """
    tried = F.posexplode(F.array(*[F.concat(urls.origin(F.col("base_url")), F.lit(x)) for x in INDEX_FILES])).alias("preference", "url")
    have = states.where("state = 'fetched'").select("source_id", F.col("url").alias("fetched"))
    tries = sources.select("source_id", tried).join(have, "source_id", "left").where(F.col("fetched").isNull() | F.col("fetched").endswith(INDEX_FILES[0]) | (F.col("url") == F.col("fetched")))
    got = tries.join(fetches.where("status = 200").select("url", "body"), "url").where((F.trim("body") != "") & _heads(F.col("body")))
    return got.groupBy("source_id").agg(F.min_by(F.struct("url", "body"), "preference").alias("r")).select("source_id", "r.url", "r.body")


def answers(fetches: DataFrame) -> DataFrame:
    """What following redirects from each recorded url leads to.

    (url, first, status, body, etag, last_modified, chain, private): the first and the last
    status, the urls on the way, whether one of them is on a private address. Redirects
    that go nowhere or on too long keep their status.
    """
    moved = F.col("status").isin(301, 302, 303, 307, 308)
    none = F.array().cast("array<string>")
    still = fetches.where(~moved).select("url", F.col("status").alias("first"), "status", "body", "etag", "last_modified", none.alias("chain"), F.lit(False).alias("private"))
    rows = fetches.where(moved).select("url", F.col("status").alias("first"), F.col("url").alias("at"), "status", "location", none.alias("chain"), F.lit(False).alias("private"))
    record = fetches.select(F.col("url").alias("at"), "status", "body", "location", "etag", "last_modified")
    out = still
    for _ in range(MAX_REDIRECTS):
        goes = F.trim(F.coalesce("location", F.lit(""))) != ""
        ended = rows.where(~goes).select("url", "first", "status", F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), "chain", "private")
        step = rows.where(goes).withColumn("at", _bare(urls.joined(F.col("at"), F.trim(F.col("location"))))).drop("status", "location")
        step = step.withColumn("chain", F.array_append("chain", F.col("at"))).withColumn("private", F.col("private") | urls.is_private(urls.host(F.col("at"))))
        step = _kept(step.join(record, "at", "left"))
        there = step.where(F.col("status").isNull() | ~moved).select(*out.columns)
        out = out.unionByName(ended).unionByName(there)
        rows = step.where(moved).select("url", "first", "at", "status", "location", "chain", "private")
        if rows.isEmpty():
            return out
    lost = [F.lit(None).cast("string").alias(c) for c in ("body", "etag", "last_modified")]
    return out.unionByName(rows.select("url", "first", "status", *lost, "chain", "private"))


def visit(wanted: DataFrame, sources: DataFrame, answered: DataFrame, robots: DataFrame, validators: DataFrame) -> DataFrame:
    """Items of wanted (source_id, ord, url): robots, redirects checked at every hop, 304, status.

    answered is that of `answers`. Urls of other hosts or out of scope give no item;
    everything else that goes wrong is an item with fetch_ok false, so that a stored page
    is kept.
    """
    rows = _in_scope(wanted, sources.drop("source")).join(sources.select("source_id", "source"), "source_id")
    allowed = discovery.allowed(rows.select(urls.authority(F.col("url")).alias("host"), "url").distinct(), robots).select("url", "allowed")
    sent = validators.where("etag is not null or last_modified is not null").select("url", F.lit(True).alias("_sent")).distinct()
    rows = rows.join(allowed, "url").join(sent, "url", "left").join(answered, "url", "left")
    gate = F.forall("chain", lambda h: urls.final_url_allowed(h, F.col("base_url"), F.col("_in"), F.col("_ex"), F.col("private")))
    state = F.when(~F.col("allowed"), "failed").when((F.col("first") == 304) & F.coalesce("_sent", F.lit(False)), "not_modified").when((F.col("status") == 200) & gate, "ok").otherwise("failed")
    ok = F.col("state") == "ok"
    return rows.withColumn("state", state).select(
        "source_id", "source", "ord", "url", (F.col("state") != "failed").alias("fetch_ok"), (F.col("state") == "not_modified").alias("not_modified"), F.when(ok, F.col("body")).alias("html"),
        F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("string").alias("heading_path"), F.when(ok, F.col("etag")).alias("etag"), F.when(ok, F.col("last_modified")).alias("last_modified"),
    )


def _links(items: DataFrame) -> DataFrame:
    """(source_id, ord, place, url) of the links of items, without fragments."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [discovery.links_of(h, u) for h, u in zip(f["html"], f["url"], strict=True)]
            yield pd.DataFrame({"source_id": f["source_id"], "ord": f["ord"], "links": found})

    raw = items.where("html is not null").select("source_id", "ord", "url", "html").mapInPandas(run, "source_id long, ord long, links array<string>")
    return raw.select("source_id", "ord", F.posexplode("links").alias("place", "url"))


def by_links(sources: DataFrame, answered: DataFrame, robots: DataFrame, validators: DataFrame) -> DataFrame:
    """Items of a breadth-first crawl from each base url, in visiting order, until max_pages are fetched.

    A level is one pass: its urls in the order of their first link, dropped from where the
    cap is reached.
    """
    caps = sources.select("source_id", F.coalesce(F.col("max_pages").cast("long"), F.lit(_NO_CAP)).alias("cap"))
    level = _kept(sources.select("source_id", F.lit(0).cast("long").alias("ord"), _bare(F.col("base_url")).alias("url")))
    seen, out = level.select("source_id", "url"), None
    for _ in range(MAX_DEPTH):
        items = visit(level, sources, answered, robots, validators)
        had = caps if out is None else caps.join(out.groupBy("source_id").agg(F.count_if("fetch_ok").alias("had")), "source_id", "left").withColumn("cap", F.col("cap") - F.coalesce("had", F.lit(0))).drop("had")
        before = F.coalesce(F.sum(F.col("fetch_ok").cast("long")).over(Window.partitionBy("source_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        items = items.withColumn("_before", before).join(had, "source_id").where("_before < cap").drop("_before", "cap")
        items = _kept(items)
        out = items if out is None else out.unionByName(items)
        last = items.groupBy("source_id").agg(F.max("ord").alias("top"))
        links = _links(items).groupBy("source_id", "url").agg(F.min(F.struct("ord", "place")).alias("first"))
        host = sources.select("source_id", urls.authority(F.col("base_url")).alias("_host"))
        links = links.join(host, "source_id").where(urls.authority(F.col("url")) == F.col("_host")).join(seen, ["source_id", "url"], "left_anti")
        place = F.row_number().over(Window.partitionBy("source_id").orderBy("first")).cast("long")
        level = _kept(links.join(last, "source_id").select("source_id", (F.col("top") + place).alias("ord"), "url"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("source_id", "url"))
    return out


def crawl(sources: DataFrame, fetches: DataFrame, robots: DataFrame, validators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, signals) of all sources: index file, else sitemap, else links.

    signals (source_id, source, unchanged, truncated, overflow) are what sync.sync asks
    for. A source on a private host gives nothing.
    """
    sources = sources.withColumn("source_id", F.col("source_id").cast("long")).where(~urls.is_private(urls.host(F.col("base_url"))))
    reads = sources.where("llms_txt in ('auto', 'only')")
    states = _kept(index_state(reads, fetches, validators))
    unchanged = states.where("state = 'unchanged'").select("source_id")
    left = sources.join(unchanged, "source_id", "left_anti")
    files = _kept(index_files(left.where("llms_txt in ('auto', 'only')"), fetches, states))
    kinds = files.join(text.is_index(files, "source_id", "body").select("source_id", "is_index"), "source_id", "left").withColumn("is_index", F.coalesce("is_index", F.lit(False)))
    caps = sources.select("source_id", "source", F.coalesce(F.col("max_pages").cast("long"), F.lit(_NO_CAP)).alias("cap"))

    # whole documentations in one file
    whole = kinds.where("not is_index")
    parts = text.sections(whole.select("source_id", "body"), "source_id", "body").join(whole.select("source_id", F.col("url").alias("_file")), "source_id")
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("ord")).cast("long")
    parts = parts.withColumn("ord", nth).join(caps, "source_id").where("ord <= cap")
    sections = parts.select(
        "source_id", "source", "ord", formats.section_url(F.col("_file"), F.col("title"), F.col("markdown"), F.col("slug")).alias("url"), F.lit(True).alias("fetch_ok"), F.lit(False).alias("not_modified"), F.lit(None).cast("string").alias("html"),
        "markdown", formats.bare_title(F.col("title")).alias("heading_path"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
    )

    # lists of links
    lists = kinds.where("is_index")
    linked = text.index_links(lists.join(sources.select("source_id", "base_url"), "source_id"), "source_id", "body", "base_url")
    linked = linked.select("source_id", "ord", urls.canonical(F.col("url")).alias("url")).groupBy("source_id", "url").agg(F.min("ord").alias("ord"))
    listed = _in_scope(linked, sources).select("source_id", "ord", "url")
    has_list = linked.select("source_id").distinct()
    listed = _first(listed, caps)

    # sitemaps and links, for what no file settles
    rest = left.join(whole.select("source_id"), "source_id", "left_anti").join(has_list, "source_id", "left_anti").where("llms_txt <> 'only'")
    mapped = rest.where(F.col("sitemap").isNotNull() & (urls.authority(F.col("sitemap")) == urls.authority(F.col("base_url"))))
    roots = mapped.select("source_id", "sitemap", "include_prefixes", "exclude_prefixes", "max_pages")
    good = discovery.sitemaps(fetches.where("status = 200").select("url", "body").join(roots.select(F.col("sitemap").alias("url")).distinct(), "url", "left_semi")).where("error is null").select(F.col("url").alias("sitemap"))
    roots = roots.join(good, "sitemap", "left_semi")
    found = _kept(discovery.discover_each(fetches.where("status = 200").select("url", "body"), roots))
    pages = listed.unionByName(found.select("source_id", "ord", "url"))
    answered = _kept(answers(fetches))
    items = visit(_kept(pages), sources, answered, robots, validators)
    walked = by_links(rest.join(roots.select("source_id"), "source_id", "left_anti"), answered, robots, validators)
    out = sections.unionByName(items.select(*ITEM)).unionByName(walked.select(*ITEM))
    cut = found.where("truncated").groupBy("source_id").agg(F.max("overflow").alias("overflow"))
    signals = sources.select("source_id", "source").join(cut, "source_id", "left").join(unchanged.withColumn("unchanged", F.lit(True)), "source_id", "left")
    return out, signals.select("source_id", "source", F.coalesce("unchanged", F.lit(False)).alias("unchanged"), F.col("overflow").isNotNull().alias("truncated"), F.coalesce("overflow", F.lit(0)).cast("long").alias("overflow"))


def _in_scope(found: DataFrame, sources: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    own = sources.select("source_id", "base_url", F.coalesce("include_prefixes", none).alias("_in"), F.coalesce("exclude_prefixes", none).alias("_ex"))
    return found.join(own, "source_id").where((urls.authority(F.col("url")) == urls.authority(F.col("base_url"))) & urls.in_scope(urls.path(F.col("url")), F.col("_in"), F.col("_ex")))


def _first(found: DataFrame, caps: DataFrame) -> DataFrame:
    """The first cap urls of each source, numbered."""
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("ord", "url")).cast("long")
    return found.withColumn("ord", nth).join(caps.select("source_id", "cap"), "source_id").where("ord <= cap").select("source_id", "ord", "url")


def fetched_pages(items: DataFrame) -> DataFrame:
    """Items as sync.page_outcomes takes them: html becomes markdown, too short to extract where it is none."""
    from .chunk import extract

    keyed = items.withColumn("_k", F.concat_ws(" ", F.col("source_id").cast("string"), "url"))
    read = extract(keyed.where("html is not null"), "_k").select(F.col("id").alias("_k"), F.col("markdown").alias("_md"))
    out = keyed.join(read, "_k", "left").withColumn("markdown", F.coalesce("markdown", "_md"))
    return out.select("source_id", "source", "url", "fetch_ok", "not_modified", "markdown", "etag", "last_modified")
