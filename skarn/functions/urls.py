"""URL expressions: parts, canonical form, scope, placeholder hosts, derived names."""

from __future__ import annotations

import ipaddress
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that never change a page's content.
NOISE_PARAMS = [
    "hl", "lang", "language", "locale", "setlang",
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "igshid",
    "referrer", "referer", "_ga", "_gl",
]
# Hosts and suffixes that stand for no real site.
PLACEHOLDER_HOSTS = ["example.com", "example.org", "example.net", "docs.company.com", "localhost"]
PLACEHOLDER_SUFFIXES = [".test", ".invalid", ".example", ".localhost"]
# Labels and segments that name no source.
GENERIC_LABELS = ["www", "docs", "doc", "developers", "developer", "platform", "api"]
GENERIC_SEGMENTS = ["docs", "doc", "en", "api", "reference", "guide"]
DEFAULT_PAGE_CAP = 500


def authority(url: Column) -> Column:
    """Host with its port, as written."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Host name in lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":[0-9]*$", ""))


def path(url: Column) -> Column:
    """Path, '/' when there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def _noise(param: Column) -> Column:
    return F.lower(F.substring_index(param, "=", 1)).isin(NOISE_PARAMS)


@F.pandas_udf(T.StringType())
def _requoted(urls: pd.Series) -> pd.Series:
    """Canonical form of URLs whose kept parameters need quoting."""

    def one(url: str | None) -> str | None:
        if url is None:
            return None
        try:
            parts = urlsplit(url)
            kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in NOISE_PARAMS]
            return urlunsplit((parts.scheme, parts.netloc, parts.path, urlencode(kept, quote_via=lambda s, safe, e, r: quote(s, safe="", encoding=e, errors=r)), ""))
        except ValueError:
            return url

    return urls.map(one, na_action="ignore")


def canonical_simple(url: Column) -> Column:
    """Canonical form of URLs whose parameters are made of unreserved characters."""
    bare = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~_noise(p))
    params = F.transform(params, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    joined = F.array_join(params, "&")
    return F.when(joined == "", bare).otherwise(F.concat(bare, F.lit("?"), joined))


def canonical(url: Column) -> Column:
    """Without fragment and noise parameters; untouched when it has neither query nor fragment.

    Parameters of unreserved characters stay in the JVM; others go through the standard
    library's quoting.
    """
    plain = url.rlike(r"^[^?#]*(\?[A-Za-z0-9_.~&=\-]*)?(#.*)?$") & ~url.rlike(r"[?&][^&#]*=[^&#]*=")
    return F.when(~url.rlike("[?#]"), url).when(plain, canonical_simple(url)).otherwise(_requoted(F.when(~plain & url.rlike("[?#]"), url)))


def _bounded(p: Column, prefix: Column) -> Column:
    bare = F.rtrim(prefix, F.lit("/"))
    return (bare == "") | (p == bare) | p.startswith(F.concat(bare, F.lit("/")))


def _rooted(prefix: Column) -> Column:
    """A prefix with its leading and without its trailing slash."""
    whole = F.when(prefix.startswith("/"), prefix).otherwise(F.concat(F.lit("/"), prefix))
    bare = F.rtrim(whole, F.lit("/"))
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def in_scope(p: Column, include: Column, exclude: Column) -> Column:
    """Exclude prefixes win, at any character; include prefixes end at a path segment; no include allows all."""
    out = F.exists(exclude, lambda x: p.startswith(_rooted(x)))
    return ~out & ((F.size(include) == 0) | F.exists(include, lambda x: _bounded(p, _rooted(x))))


def in_scope_plain(p: Column, include: Column, exclude: Column) -> Column:
    """The variant of validation: plain prefixes on both sides."""
    out = F.exists(exclude, lambda x: p.startswith(x))
    return ~out & ((F.size(include) == 0) | F.exists(include, lambda x: p.startswith(x)))


def is_placeholder(h: Column) -> Column:
    found = h.isin(PLACEHOLDER_HOSTS)
    for s in PLACEHOLDER_SUFFIXES:
        found = found | h.endswith(s)
    return found


def slugify(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def derived_name(url: Column) -> Column:
    """First telling host label and first path segment that is telling and leaves a slug."""
    labels = F.filter(F.split(host(url), "[.]"), lambda x: x != "")
    telling = F.filter(labels, lambda x: ~x.isin(GENERIC_LABELS))
    label = slugify(F.get(F.when(F.size(telling) > 0, telling).otherwise(labels), F.lit(0)))
    segment = slugify(F.get(F.filter(F.split(path(url), "/"), lambda x: (slugify(x) != "") & ~F.lower(x).isin(GENERIC_SEGMENTS)), F.lit(0)))
    both = F.when(segment.isNull() | (segment == label), label).otherwise(F.concat_ws("-", F.when(label != "", label), segment))
    return F.when(F.coalesce(both, F.lit("")) == "", "source").otherwise(both)


def free_name(name: str, taken) -> str:
    """The name, or with the first of -2, -3, ... that is not taken."""
    taken, n, found = set(taken), 2, name
    while found in taken:
        found, n = f"{name}-{n}", n + 1
    return found


def unique_names(wanted, taken, order: str, name: str = "name"):
    """The rows of wanted with names of their own, which taken does not have either.

    Of rows that want one name the first in order gets it, unless it is taken, and the
    others the next numbers -2, -3, ...; a number that a taken or wanted name ends in is
    passed over.
    """
    from pyspark.sql import Window

    held = taken.select(F.col(name)).distinct()
    number = F.when(F.regexp_extract(name, r"-([1-9][0-9]{0,8})$", 1) != "", F.regexp_extract(name, r"-([1-9][0-9]{0,8})$", 1).cast("int"))
    used = held.unionByName(wanted.select(name).distinct()).select(F.regexp_replace(name, r"-[1-9][0-9]{0,8}$", "").alias("_base"), number.alias("_no")).where("_no > 1")
    used = used.unionByName(held.select(F.col(name).alias("_base"), F.lit(1).alias("_no"))).groupBy("_base").agg(F.collect_set("_no").alias("_used"))
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order))
    rows = wanted.withColumn("_nth", nth).join(used, F.col(name) == F.col("_base"), "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(1), F.col("_nth") + F.size("_used")), lambda k: ~F.array_contains("_used", k))
    at = F.get(free, F.col("_nth") - 1)
    return rows.withColumn(name, F.when(at == 1, F.col(name)).otherwise(F.concat(name, F.lit("-"), at.cast("string")))).drop("_nth", "_base", "_used")


def final_url_allowed(final: Column, base: Column, include: Column, exclude: Column, private: Column) -> Column:
    """Whether a page that redirects may be taken: the same host, in scope, on a public address."""
    return (authority(final) == authority(base)) & in_scope(path(final), include, exclude) & ~private


def derived_include(url: Column) -> Column:
    """The start path as the only include prefix, none for a bare host."""
    p = path(url)
    return F.when(p.isin("", "/"), F.array().cast("array<string>")).otherwise(F.array(p))


def private_literal(h: str | None, multicast: bool = False) -> bool:
    """Whether a host is a literal address that is not public."""
    try:
        a = ipaddress.ip_address((h or "").strip("[]"))
    except ValueError:
        return False
    return a.is_private or a.is_link_local or a.is_loopback or a.is_reserved or (multicast and a.is_multicast)


@F.pandas_udf(T.BooleanType())
def is_private(hosts: pd.Series) -> pd.Series:
    return hosts.map(private_literal).astype(bool)


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, ref: pd.Series) -> pd.Series:
    """RFC 3986 reference resolution."""
    return pd.Series([None if a is None or b is None else urljoin(a, b) for a, b in zip(base, ref, strict=True)])


def resolved_private(hosts, addresses, fail_open: bool = False):
    """Hosts with a flag: any known address is private, or none is known and we fail closed."""
    flagged = addresses.groupBy("host").agg(F.max(is_private(F.col("address"))).alias("private"))
    return hosts.join(flagged, "host", "left").withColumn("private", F.coalesce("private", F.lit(not fail_open)))
