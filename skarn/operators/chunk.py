"""Chunking as table functions over pages, and the extraction and embedding in front of and behind it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Token bounds of a window, its overlap, and the character budget of short texts.
MIN_TOKENS, MAX_TOKENS, OVERLAP = 400, 600, 0.15
SHORT_CHARS = 2000
MIN_EXTRACTED = 200
_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
TokenCounter = Callable[[str], int]
Embedder = Callable[[list[str]], list[list[float]]]


def count_words(text: str) -> int:
    """The default token counter: words and marks, and two special tokens."""
    return len(re.findall(r"\w+|[^\w\s]", text)) + 2


def token_counter(path: str) -> TokenCounter:
    """A counter by a model's tokenizer, special tokens included; path is its tokenizer.json."""

    def count(text: str) -> int:
        if path not in _tokenizers:
            from tokenizers import Tokenizer

            _tokenizers[path] = Tokenizer.from_file(path)
        return len(_tokenizers[path].encode(text).ids)

    return count


_tokenizers: dict = {}


def segments(markdown: str) -> list[tuple[str, list[str]]]:
    """(breadcrumb, units) by heading; a fenced block is one unit, else paragraphs are."""
    out, trail, units, buffer = [], [], [], []

    def flush() -> None:
        units.extend(p.strip("\n") for p in re.split(r"\n\s*\n", "\n".join(buffer)) if p.strip())
        buffer.clear()

    def close() -> None:
        flush()
        if units:
            out.append((" > ".join(x for x in trail if x), list(units)))
        units.clear()

    fence: list[str] | None = None
    for line in markdown.split("\n"):
        if fence is not None:
            fence.append(line)
            if line.strip().startswith("```"):
                units.append("\n".join(fence))
                fence = None
        elif head := _HEADING.match(line):
            close()
            level = len(head[1])
            trail[:] = (trail + [""] * level)[: level - 1] + [head[2].strip()]
        elif line.strip().startswith("```"):
            flush()
            fence = [line]
        else:
            buffer.append(line)
    if fence is not None:
        units.append("\n".join(fence))
    close()
    return out


def windows(units: list[str], tokens: list[int]) -> Iterator[tuple[int, int]]:
    """Unit ranges: at most MAX_TOKENS unless one unit is longer, closed from MIN_TOKENS on, with overlap."""
    at, n = 0, len(units)
    while at < n:
        end, total = at, 0
        while end < n and (end == at or total + tokens[end] <= MAX_TOKENS) and total < MIN_TOKENS:
            total += tokens[end]
            end += 1
        yield at, end
        if end == n:
            return
        back, stepped = 0, 0
        while back < end - at and stepped < OVERLAP * total:
            back += 1
            stepped += tokens[end - back]
        at = end - back if end - back > at else end


def chunk_text(markdown: str, counter: TokenCounter = count_words) -> list[tuple[str, int, str]]:
    """(heading_path, chunk_index, content) of one page."""
    out = []
    for trail, units in segments(markdown):
        tokens = [counter(u) for u in units]
        for a, b in windows(units, tokens):
            out.append((trail, len(out), "\n\n".join(units[a:b])))
    return out


def chunk_short(markdown: str) -> list[tuple[str, int, str]]:
    """Chunks of uploaded texts: paragraphs packed up to SHORT_CHARS, no overlap, fences not special."""
    out, trail, buffer = [], [], []

    def close() -> None:
        packed = ""
        for p in (p.strip() for p in re.split(r"\n\s*\n", "\n".join(buffer)) if p.strip()):
            if packed and len(packed) + 2 + len(p) > SHORT_CHARS:
                out.append((" > ".join(x for x in trail if x), len(out), packed))
                packed = ""
            packed = f"{packed}\n\n{p}" if packed else p
        if packed:
            out.append((" > ".join(x for x in trail if x), len(out), packed))
        buffer.clear()

    for line in markdown.split("\n"):
        if head := _HEADING.match(line):
            close()
            trail[:] = (trail + [""] * 6)[: len(head[1]) - 1] + [head[2].strip()]
        else:
            buffer.append(line)
    close()
    return out


def chunks(pages: DataFrame, id_col: str, text_col: str, how: Callable[[str], list[tuple[str, int, str]]] = chunk_text) -> DataFrame:
    """(id, heading_path, chunk_index, content) of all pages; map-side, a page at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *c) for i, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) for c in how(t or "")]
            yield pd.DataFrame(rows, columns=["id", "heading_path", "chunk_index", "content"])

    return pages.select(id_col, text_col).mapInPandas(run, f"id {_kind(pages, id_col)}, heading_path string, chunk_index int, content string")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


class _Text(HTMLParser):
    """Text of a page: everything (plain), or markdown of its main part.

    As markdown, headings, list items, fenced blocks, inline code and tables are kept.
    """

    DROP = {"script", "style", "nav", "footer", "header", "aside"}
    BREAK = {"p", "div", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "article", "main", "section", "tr", "pre", "title", "ul", "ol", "table"}

    def __init__(self, main_only: bool):
        super().__init__()
        self.main_only, self.depth, self.inside, self.out = main_only, 0, 0, []
        self.fence: list[str] | None = None
        self.cells: list[str] | None = None
        self.fences: list[str] = []

    @property
    def live(self) -> bool:
        return self.main_only and not self.depth and bool(self.inside)

    def handle_starttag(self, tag, attrs):
        if tag in self.DROP:
            self.depth += 1
        if tag in ("article", "main"):
            self.inside += 1
        if tag == "pre" and self.live and self.fence is None:
            self.fence = []
        if self.fence is not None:
            if tag == "br":
                self.fence.append("\n")
            return
        if tag == "tr" and self.live:
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        if tag == "code" and self.live:
            self._add("`")
        if tag in self.BREAK and self.cells is None:
            self.out.append("\n")
            if self.live and re.fullmatch("h[1-6]", tag):
                self.out.append("#" * int(tag[1]) + " ")
            elif self.live and tag == "li":
                self.out.append("- ")

    def handle_endtag(self, tag):
        if tag in self.DROP:
            self.depth = max(0, self.depth - 1)
        if self.fence is not None:
            if tag == "pre":
                self.fences.append("```\n" + "".join(self.fence).strip("\n") + "\n```")
                self.out.append(f"\n\x00{len(self.fences) - 1}\n")
                self.fence = None
            return
        if tag == "code" and self.live:
            self._add("`")
        if tag == "tr" and self.cells is not None:
            row = [" ".join(c.split()) for c in self.cells]
            self.cells = None
            if any(row):
                self.out.append("\n| " + " | ".join(row) + " |\n")
        if tag in ("article", "main"):
            self.inside = max(0, self.inside - 1)
        if tag in self.BREAK and self.cells is None:
            self.out.append("\n")

    def _add(self, data: str) -> None:
        if self.cells is not None:
            if self.cells:
                self.cells[-1] += data
        else:
            self.out.append(data)

    def handle_data(self, data):
        if self.fence is not None:
            self.fence.append(data)
        elif not self.depth and (self.inside or not self.main_only):
            self._add(data)

    def text(self) -> str:
        lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(self.out).split("\n")]
        whole = lambda x: self.fences[int(x[1:])] if x[:1] == "\x00" else x
        lines = [x for x in lines if x and x.strip("#- ")]
        out = ""
        for x in lines:
            # rows of a table stay together
            gap = "\n" if not self.main_only or (x.startswith("| ") and out.endswith(" |")) else "\n\n"
            out += (gap if out else "") + whole(x)
        return out


def extract_html(html: str | None) -> tuple[str, str | None, str | None, int]:
    """(status, markdown, reason, length): main part first; the plain text only if that is short and shorter."""

    def read(main: bool) -> str:
        p = _Text(main)
        p.feed((html or "").replace("\x00", ""))
        p.close()
        return p.text().strip()

    best = read(True)
    if len(best) < MIN_EXTRACTED:
        plain = read(False)
        best = plain if len(plain) > len(best) else best
    if len(best) < MIN_EXTRACTED:
        return "skipped", None, "too short", len(best)
    return "ok", best, None, len(best)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, status, markdown, reason, length) of fetched pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *extract_html(h)) for i, h in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "status", "markdown", "reason", "length"])

    return pages.select(id_col, html_col).mapInPandas(run, f"id {_kind(pages, id_col)}, status string, markdown string, reason string, length int")


def hashing_embedder(dim: int = 384) -> Embedder:
    """Signed feature hashing of words, unit length: the offline default."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for r, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[r, (h >> 1) % dim] += 1.0 if h & 1 else -1.0
            size = float(np.linalg.norm(out[r]))
            if size:
                out[r] /= size
        return out.astype(np.float32).tolist()

    return embed


def embed_passages(chunks: DataFrame, id_col: str, text_col: str, embedder: Embedder | None = None, prompt: str = "", batch: int = 8, dim: int = 384) -> DataFrame:
    """(id, embedding): batches through the embedder, counts and widths checked."""
    embedder = embedder or hashing_embedder(dim)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, made = [prompt + (t or "") for t in f.iloc[:, 1]], []
            for lo in range(0, len(texts), batch):
                made += embedder(texts[lo : lo + batch])
            if len(made) != len(texts) or any(len(v) != dim for v in made):
                raise ValueError("the embedder returned a wrong number or width of vectors")
            yield pd.DataFrame({"id": f.iloc[:, 0], "embedding": made})

    return chunks.select(id_col, text_col).mapInPandas(run, f"id {_kind(chunks, id_col)}, embedding array<float>")
