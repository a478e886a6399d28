"""Text forms of results: catalogue tables, command-line lines, section addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_line(name: Column, base_url: Column, chunks: Column, synced: Column, status: Column) -> Column:
    """One row of the catalogue as a markdown table line."""
    when = F.coalesce(F.date_format(synced, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("never"))
    return F.concat_ws(" | ", F.lit(""), name, base_url, chunks.cast("string"), when, F.coalesce(status, F.lit("unknown")), F.lit(""))


def _or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


# The layouts of the command line.
def compact_hit(id_: Column, source: Column, score: Column, heading: Column, url: Column, snippet: Column) -> Column:
    return F.format_string("[%d] %s > %s (score: %.3f)\n  %s\n  URL: %s\n", id_, source, _or_empty(heading), score, snippet, url)


def long_hit(id_: Column, source: Column, score: Column, heading: Column, url: Column, snippet: Column) -> Column:
    return F.format_string("ID: %d | Source: %s | Score: %.3f\nHeading: %s\nURL: %s\nSnippet: %s", id_, source, score, F.coalesce(F.when(heading != "", heading), source), url, snippet)


def compact_chunk(id_: Column, source: Column, heading: Column, url: Column, content: Column) -> Column:
    return F.format_string("# Chunk %d [%s > %s]\nURL: %s\n\n%s", id_, source, _or_empty(heading), url, F.regexp_replace(content, r"^\s+|\s+$", ""))


def long_chunk(id_: Column, source: Column, heading: Column, url: Column, fetched_at: Column, content: Column) -> Column:
    head = F.format_string("ID: %d\nSource: %s\nHeading: %s\nURL: %s\n", id_, source, _or_empty(heading), url)
    at = F.coalesce(F.concat(F.lit("Fetched At: "), F.date_format(fetched_at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\n")), F.lit(""))
    return F.concat(head, at, F.lit("\n---\n\n"), content)


def compact_node(name: Column, base_url: Column, pages: Column, chunks: Column) -> Column:
    return F.format_string("  - %s (pages: %d, chunks: %d) [%s]\n", name, pages, chunks, base_url)


def long_node(name: Column, base_url: Column, pages: Column, chunks: Column, synced: Column) -> Column:
    when = F.coalesce(F.date_format(synced, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("never"))
    return F.format_string("  - Source: %s\n    Base URL: %s\n    Pages: %d | Chunks: %d\n    Last Synced: %s\n", name, base_url, pages, chunks, when)


def bare_title(title: Column) -> Column:
    """A heading without its markdown link."""
    return F.regexp_replace(title, r"\[([^\]]+)\]\([^)]*\)", "$1")


def section_url(base: Column, title: Column, body: Column, slug: Column) -> Column:
    """A section's address: the link in its title, a Source line, or its slug on the file's address."""
    link = F.regexp_extract(title, r"\[[^\]]+\]\((https?://[^)\s]+)\)", 1)
    line = F.regexp_extract(body, r"(?m)^Source:\s*(https?://\S+)", 1)
    return F.when(link != "", link).when(line != "", line).otherwise(F.concat(base, F.lit("#"), slug))
