"""Discovery over recorded fetches: sitemaps, link graphs, robots, caps."""

from __future__ import annotations

import urllib.robotparser
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions import urls

SITEMAP_DEPTH = 1


def parse_sitemap(xml: bytes | str | None) -> tuple[list[str], list[str], str | None]:
    """(urls, child sitemaps, error); document types are refused."""
    raw = xml.encode() if isinstance(xml, str) else (xml or b"")
    if not raw.strip():
        return [], [], "the sitemap is empty"
    if b"<!DOCTYPE" in raw.upper() or b"<!ENTITY" in raw.upper():
        return [], [], "the sitemap has a document type"
    try:
        root = ET.fromstring(raw)  # noqa: S314  document types were refused above
    except ET.ParseError:
        return [], [], "the sitemap is malformed"
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    locs = lambda kind: [loc.text.strip() for e in root if local(e) == kind for loc in e if local(loc) == "loc" and (loc.text or "").strip()]
    if local(root) == "urlset":
        return locs("url"), [], None
    if local(root) == "sitemapindex":
        return [], locs("sitemap"), None
    return [], [], f"unexpected root {local(root)}"


def sitemaps(docs: DataFrame) -> DataFrame:
    """(url, urls, children, error) of sitemap bodies (url, body)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [parse_sitemap(b) for b in f["body"]]
            yield pd.DataFrame({"url": f["url"], "urls": [g[0] for g in got], "children": [g[1] for g in got], "error": [g[2] for g in got]})

    return docs.select("url", "body").mapInPandas(run, "url string, urls array<string>, children array<string>, error string")


def discover(docs: DataFrame, roots: DataFrame, include: list[str], exclude: list[str], cap: int | None) -> DataFrame:
    """(source, ord, url, truncated, overflow): canonical in-scope urls of each source's sitemaps, sorted, capped.

    docs (url, body) are recorded sitemaps, roots (source, url) where each source starts.
    Children are followed one level down; a child that can't be read is skipped.
    """
    arrays = [F.array(*[F.lit(x) for x in p]) if p else F.array().cast("array<string>") for p in (include, exclude)]
    each = roots.select(F.col("source").alias("source_id"), F.col("url").alias("sitemap"), arrays[0].alias("include_prefixes"), arrays[1].alias("exclude_prefixes"), F.lit(cap).cast("long").alias("max_pages"))
    return discover_each(docs, each).withColumnRenamed("source_id", "source")


def discover_each(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """discover for roots (source_id, sitemap, include_prefixes, exclude_prefixes, max_pages), each by its own rules."""
    none = F.array().cast("array<string>")
    parsed = sitemaps(docs)
    level = roots.select("source_id", F.col("sitemap").alias("url")).join(parsed, "url")
    found = level.select("source_id", F.explode("urls").alias("u"))
    for _ in range(SITEMAP_DEPTH):
        level = level.select("source_id", F.explode("children").alias("url")).distinct().join(parsed.where("error is null"), "url")
        found = found.unionByName(level.select("source_id", F.explode("urls").alias("u")))
    own = roots.select("source_id", urls.authority(F.col("sitemap")).alias("h"), F.coalesce("include_prefixes", none).alias("_in"), F.coalesce("exclude_prefixes", none).alias("_ex"), F.col("max_pages").cast("long").alias("cap"))
    found = found.withColumn("u", urls.canonical(F.col("u"))).join(own, "source_id").where((urls.authority(F.col("u")) == F.col("h")) & urls.in_scope(urls.path(F.col("u")), F.col("_in"), F.col("_ex")))
    return _capped(found.select("source_id", F.col("u").alias("url"), "cap").distinct(), "source_id", F.coalesce("cap", F.lit((1 << 62) - 1)))


def capped(found: DataFrame, cap: int | None) -> DataFrame:
    """Urls (source, url) in byte order with their place, cut at cap, and what the cut left out."""
    return _capped(found, "source", F.lit(cap if cap is not None else (1 << 62) - 1))


def _capped(found: DataFrame, key: str, cap: Column) -> DataFrame:
    counts = found.groupBy(key).agg(F.count("*").alias("n"))
    out = found.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("url")).cast("long")).where(F.col("ord") <= cap)
    return out.join(counts, key).select(key, "ord", "url", (F.col("n") > cap).alias("truncated"), F.greatest(F.col("n") - cap, F.lit(0)).alias("overflow"))


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [v.strip() for k, v in attrs if k == "href" and v and v.strip()]


def links_of(html: str | None, base: str) -> list[str]:
    """Absolute links of a page without their fragments; mail, script and phone links go."""
    p = _Links()
    p.feed(html or "")
    out = []
    for href in p.found:
        if href.lower().startswith(("mailto:", "javascript:", "tel:")):
            continue
        try:
            out.append(urldefrag(urljoin(base, href))[0])
        except ValueError:
            continue
    return out


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, url) of pages (page_id, url, html), canonical."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"page_id": f["page_id"], "links": [links_of(h, u or "") for h, u in zip(f["html"], f["url"], strict=True)]})

    raw = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, links array<string>")
    return raw.select("page_id", F.posexplode("links").alias("ord", "u")).select("page_id", "ord", urls.canonical(F.col("u")).alias("url"))


def reach(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): breadth-first levels from start over links (src, dst), each node at its first level."""
    seen = start.select("node", F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        step = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def allowed(fetches: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """fetches (host, url) with a flag by robots (host, status, body); no file or an error allows all."""

    @F.pandas_udf(T.BooleanType())
    def ok(status: pd.Series, body: pd.Series, url: pd.Series) -> pd.Series:
        out, parsed = [], {}
        for s, b, u in zip(status, body, url, strict=True):
            if s != 200 or not b:
                out.append(True)
                continue
            if b not in parsed:
                parsed[b] = urllib.robotparser.RobotFileParser()
                parsed[b].parse(b.splitlines())
            out.append(parsed[b].can_fetch(agent, u))
        return pd.Series(out, dtype=bool)

    return fetches.join(robots, "host", "left").withColumn("allowed", ok(F.coalesce("status", F.lit(404)), "body", "url")).select("host", "url", "allowed")


def first_available(candidates: DataFrame) -> DataFrame:
    """(source, url, body): the preferred non-empty 200 answer of candidates (source, preference, url, status, body)."""
    good = candidates.where("status = 200 and length(trim(body)) > 0")
    w = Window.partitionBy("source").orderBy("preference")
    return good.withColumn("n", F.row_number().over(w)).where("n = 1").select("source", "url", "body")
