"""Uploaded files: walking, path rules, parsers by suffix, archives with guards, batches."""

from __future__ import annotations

import io
import stat
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of archives and of upload batches, and the suffixes that are read.
MAX_MEMBERS, MAX_EXPANDED, MAX_RATIO = 500, 200 << 20, 100
BATCH_FILES, BATCH_BYTES = 20, 40 << 20
MAX_PDF_PAGES, MIN_PDF_CHARS = 2000, 200
TEXT_BYTES, TITLE_CHARS = 1_000_000, 200
SUFFIXES = ("md", "markdown", "txt", "html", "htm", "pdf")

Parsed = tuple[str | None, str | None]


def _text(_: str, data: bytes) -> Parsed:
    return data.decode("utf-8", "replace"), None


def _html(_: str, data: bytes) -> Parsed:
    from skarn.operators.chunk import extract_html

    status, markdown, reason, _ = extract_html(data.decode("utf-8", "replace"))
    return (markdown, None) if status == "ok" else (None, f"no readable content: {reason}")


def _pdf(_: str, data: bytes) -> Parsed:
    try:
        from pypdf import PdfReader
    except ImportError:
        return None, "PDF support is not available"
    try:
        reader = PdfReader(io.BytesIO(data))
        if reader.is_encrypted:
            return None, "the PDF is encrypted"
        if len(reader.pages) > MAX_PDF_PAGES:
            return None, f"the PDF has more than {MAX_PDF_PAGES} pages"
        parts = []
        for page in reader.pages:
            try:
                parts.append(page.extract_text() or "")
            except Exception:  # noqa: BLE001  a bad page is empty
                parts.append("")
    except Exception:  # noqa: BLE001  the library raises many kinds
        return None, "the PDF can't be read"
    text = "\n\n".join(p.strip() for p in parts if p.strip())
    return (text, None) if len(text) >= MIN_PDF_CHARS else (None, "the PDF has no text")


PARSERS: dict[str, Callable[[str, bytes], Parsed]] = {"md": _text, "markdown": _text, "txt": _text, "html": _html, "htm": _html, "pdf": _pdf}


def register_parser(suffix: str, parser: Callable[[str, bytes], Parsed]) -> None:
    """A parser for a suffix; a later one replaces an earlier one."""
    PARSERS[suffix.lower().lstrip(".")] = parser


def _suffix(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""


def rel_path(path: Column) -> Column:
    """struct(path, error): dots dropped; empty, backslashed, absolute and climbing paths refused."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    error = (
        F.when(F.trim(F.coalesce(path, F.lit(""))) == "", "the path is empty").when(path.contains("\\"), "the path has a backslash").when(path.startswith("/"), "the path is absolute")
        .when(F.array_contains(parts, ".."), "the path climbs").when(F.size(parts) == 0, "the path is empty")
    )
    return F.struct(F.when(error.isNull(), F.array_join(parts, "/")).alias("path"), error.alias("error"))


def clean_path(path: str) -> tuple[str | None, str | None]:
    """The same rule for one path."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if not path.strip() or not parts and "\\" not in path and not path.startswith("/"):
        return None, "the path is empty"
    if "\\" in path:
        return None, "the path has a backslash"
    if path.startswith("/"):
        return None, "the path is absolute"
    if ".." in parts:
        return None, "the path climbs"
    return "/".join(parts), None


def expand_zip(name: str, data: bytes) -> list[tuple[str, str, str | None, str | None]]:
    """(member, outcome, reason, text): doc, failed or skipped. Sizes, links and paths are judged before anything is expanded."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return [(name, "failed", "not an archive", None)]
    members = [m for m in archive.infolist() if not m.is_dir()]
    if len(members) > MAX_MEMBERS:
        return [(name, "failed", f"more than {MAX_MEMBERS} members", None)]
    if sum(m.file_size for m in members) > MAX_EXPANDED:
        return [(name, "failed", "too large when expanded", None)]
    for m in members:
        if stat.S_ISLNK(m.external_attr >> 16):
            return [(name, "failed", "holds a symbolic link", None)]
        if clean_path(m.filename)[1]:
            return [(name, "failed", f"unsafe path {m.filename}", None)]
    out: list[tuple[str, str, str | None, str | None]] = []
    for m in members:
        path, suffix = clean_path(m.filename)[0], _suffix(m.filename)
        if suffix not in PARSERS:
            out.append((path, "skipped", "unknown type", None))
        elif m.file_size > MAX_RATIO * max(1, m.compress_size):
            out.append((path, "failed", "expands too much", None))
        else:
            try:
                text, error = PARSERS[suffix](path, archive.read(m))
            except (RuntimeError, zipfile.BadZipFile, NotImplementedError):
                text, error = None, "can't be read"
            out.append((path, "failed" if error else "doc", error, text))
    return out


def parse(name: str, data: bytes) -> list[tuple[str, str, str | None, str | None]]:
    """One upload as documents and failures; unknown types give nothing."""
    if _suffix(name) == "zip":
        return expand_zip(name, data)
    parser = PARSERS.get(_suffix(name))
    if parser is None:
        return []
    path, error = clean_path(name)
    text = None
    if not error:
        text, error = parser(name, data)
    return [(path or name, "failed" if error else "doc", error, text)]


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of all files below a folder whose suffix is known, any case."""
    pattern = "*.{" + ",".join(s for x in (*SUFFIXES, "zip") for s in (x, x.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    base = folder.removeprefix("file://").rstrip("/") + "/"
    return files.select(F.substring_index("path", base, -1).alias("name"), "content")


def documents(files: DataFrame) -> DataFrame:
    """(upload, member, outcome, reason, text) of files (name, content), a file at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(n, *r) for n, c in zip(f["name"], f["content"], strict=True) if n for r in parse(n, bytes(c or b""))]
            yield pd.DataFrame(rows, columns=["upload", "member", "outcome", "reason", "text"])

    return files.select("name", "content").mapInPandas(run, "upload string, member string, outcome string, reason string, text string")


def batches(sizes: list[tuple[str, int]]) -> list[list[str]]:
    """Files in order, at most BATCH_FILES or BATCH_BYTES together; a larger file goes alone."""
    out: list[list[str]] = []
    held, total = [], 0
    for name, size in sizes:
        if held and (len(held) == BATCH_FILES or total + size > BATCH_BYTES):
            out.append(held)
            held, total = [], 0
        held.append(name)
        total += size
    return [*out, held] if held else out


def checked_text(title: str, content: str) -> tuple[str, str]:
    """Slug and content of a text upload, within the caps."""
    import re

    if not title.strip() or len(title) > TITLE_CHARS:
        raise ValueError(f"the title must have 1 to {TITLE_CHARS} characters")
    if not content.strip() or len(content.encode()) > TEXT_BYTES:
        raise ValueError(f"the content must have 1 to {TEXT_BYTES} bytes")
    slug = re.sub("[^a-z0-9]+", "-", title.lower()).strip("-")
    if not slug:
        raise ValueError("the title has no letters or digits")
    return slug, content
