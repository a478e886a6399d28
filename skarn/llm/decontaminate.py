"""Benchmark decontamination with an FM-index for each training shard.

Words are maximal runs of [0-9a-z] and characters beyond ASCII, after A-Z are lower-cased.
A test item's windows are its runs of WINDOW words (a shorter item is one window).

A shard is about SHARD_BYTES of documents inside one task. Its word sequence becomes an
FM-index over the alphabet of the test words: words that no test item has, and runs too
short for any window, collapse to separators. Windows are searched backwards, all at
once, through the ranks of a wavelet tree over the Burrows-Wheeler transform; occurrences
are located by walking to sampled suffix positions, one in SAMPLE; their word ranges are
merged into removal spans. No shuffle takes place.

The test items are cut into blocks of about BLOCK_WORDS words, built in tasks, kept in the
scratch folder and read by the tasks one after another, so no task holds more than a block
and nothing is broadcast; the driver sees the blocks' names.

Words are compared by hashes under a key drawn for each run, and document words in runs that
can hold a window are compared with the test words byte by byte before they count.

Null and word-free texts have no words and no hits; items without words or without an id
have no windows; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import arrow_map, local_files, saved, scratch_path, table, utf8

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 8 << 20
#: The same where whole rows are held and texts are written anew.
CUT_BYTES = 3 << 20
BLOCK_WORDS = 1 << 20


class Block:
    """Windows of some test items as codes over the items' own words."""

    def __init__(self, ids: list, texts: list[str], key: int = 0):
        raw = [t.encode() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        hashes, first, end, starts = words.split(data, at, words.ALNUM, key)
        self.vocabulary, place, codes = np.unique(hashes, return_index=True, return_inverse=True)
        self.letters, self.first, self.end = words.LOWER[data], first[place], end[place]
        codes = codes + 1
        rows, owner = [], []
        for i, item in enumerate(ids):
            own = codes[starts[i] : starts[i + 1]]
            if not len(own) or item is None:
                continue
            size = min(WINDOW, len(own))
            for j in range(len(own) - size + 1):
                rows.append(np.concatenate([np.zeros(WINDOW - size, np.int64), own[j : j + size]]))
                owner.append(item)
        table_ = np.array(rows, np.int64).reshape(-1, WINDOW)
        self.windows, which = np.unique(table_, axis=0, return_inverse=True) if len(table_) else (table_, np.zeros(0, np.int64))
        self.sizes = (self.windows > 0).sum(1)
        pairs = sorted(set(zip(which.ravel().tolist(), owner, strict=True)), key=lambda x: x[0])
        self.items = [p[1] for p in pairs]
        self.item_at = np.searchsorted([p[0] for p in pairs], np.arange(len(self.windows) + 1))
        self.bits = max(1, int(len(self.vocabulary)).bit_length())


class FMIndex:
    """Counts and places of patterns in a sequence of codes that ends with 0; 0 separates and never matches."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.seq, self.bits = seq, bits
        n = len(seq)
        order = suffix_array(seq, bits)
        start = np.empty(n, bool)
        start[:1] = True
        start[1:] = seq[:-1] == 0
        index = np.arange(n)
        since = index - np.maximum.accumulate(np.where(start, index, 0))
        self.marked = (since % SAMPLE == 0)[order]
        self.place = np.where(self.marked, order, -1)
        self.bwt = np.where(order > 0, seq[order - 1], 0)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=(1 << bits) + 1))])
        # wavelet tree, a level for each bit, zeros before ones
        self.levels, self.zeros = [], []
        x = self.bwt
        for b in range(bits - 1, -1, -1):
            one = (x >> b) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int32))
            self.zeros.append(n - int(one.sum()))
            x = np.concatenate([x[one == 0], x[one == 1]])

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often code occurs in the first i places of the transform."""
        lo = np.zeros(len(i), np.int64)
        hi = i.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            bit = (code >> (self.bits - 1 - k)) & 1
            a, b = ones[lo], ones[hi]
            lo = np.where(bit == 1, zeros + a, lo - a)
            hi = np.where(bit == 1, zeros + b, hi - b)
        return hi - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns, all stepped backwards together."""
        sp, ep = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.seq), np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            code = patterns[:, j]
            go = np.flatnonzero((code > 0) & (sp < ep))
            c = code[go]
            sp[go] = self.before[c] + self.rank(c, sp[go])
            ep[go] = self.before[c] + self.rank(c, ep[go])
        return sp, ep

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows."""
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            hit = self.marked[rows]
            out[todo[hit]] = self.place[rows[hit]] + steps
            todo, rows = todo[~hit], rows[~hit]
            c = self.bwt[rows]
            rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out


def suffix_array(seq: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes up to their separator; equal ones by place."""
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64)
    depth = max(1, 62 // bits)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(min(depth, n)):  # the last code is a separator: no suffix is longer
        sym = np.zeros(n, np.int64)
        sym[: n - j] = seq[j:]
        sym[~open_] = 0
        open_ &= sym > 0
        key = (key << bits) | sym
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = (sorted_[1:] != sorted_[:-1]) | ~open_[order[1:]]
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = head
    while True:
        size = np.bincount(head, minlength=n)
        rows = np.flatnonzero(size[head] > 1)  # rows of groups that still tie
        if not len(rows):
            return order
        at = order[rows]
        second = np.full(len(at), -1, np.int64)
        inside = at + depth < n
        second[inside] = rank[at[inside] + depth]
        resort = np.lexsort((at, second, head[rows]))
        group, second, at = head[rows][resort], second[resort], at[resort]
        order[rows] = at
        new = np.empty(len(rows), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        lead = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        head[rows] = lead
        rank[at] = lead
        depth *= 2


class Hits:
    """What the blocks find in one shard."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, key: int = 0):
        self.low = words.LOWER[data]
        self.hashes, self.first, self.end, self.starts = words.split(data, offsets, words.ALNUM, key)
        self.mask = np.zeros(len(self.hashes), bool)
        self.items: list[set] = [set() for _ in range(len(offsets) - 1)]

    def _runs(self, code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The run of each word, and the words in runs of least test words or more; runs end with documents."""
        n = len(code)
        edge = np.zeros(n + 1, bool)
        edge[self.starts] = True
        new = (code > 0) & np.concatenate([[True], (code[:-1] == 0) | edge[1:n]])
        run = np.cumsum(new)
        sizes = np.bincount(run[code > 0], minlength=run[-1] + 1)
        return run, np.flatnonzero((code > 0) & (sizes[run] >= least))

    def add(self, block: Block) -> None:
        n = len(self.hashes)
        if not n or not len(block.windows):
            return
        at = np.minimum(np.searchsorted(block.vocabulary, self.hashes), len(block.vocabulary) - 1)
        code = np.where(block.vocabulary[at] == self.hashes, at + 1, 0)
        run, use = self._runs(code, int(block.sizes.min()))
        if not len(use):
            return
        own = code[use] - 1
        same = words.same(self.low, self.first[use], self.end[use], block.letters, block.first[own], block.end[own])
        if not same.all():  # the same hash, another word
            code[use[~same]] = 0
            run, use = self._runs(code, int(block.sizes.min()))
            if not len(use):
                return
        # a separator before each run and one at the end
        jump = np.concatenate([[True], run[use[1:]] != run[use[:-1]]])
        place = np.arange(len(use)) + np.cumsum(jump)
        seq = np.zeros(len(use) + int(jump.sum()) + 1, np.int64)
        seq[place] = code[use]
        back = np.full(len(seq), -1, np.int64)
        back[place] = use
        index = FMIndex(seq, block.bits)
        sp, ep = index.search(block.windows)
        found = np.flatnonzero(sp < ep)
        if not len(found):
            return
        counts = (ep - sp)[found]
        rows = np.arange(counts.sum()) + np.repeat(sp[found] - np.cumsum(counts) + counts, counts)
        which = np.repeat(found, counts)
        begin = back[index.locate(rows)]
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + block.sizes[which], -1)
        self.mask |= np.cumsum(step[:-1]) > 0
        doc = np.searchsorted(self.starts, begin, "right") - 1
        for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            self.items[d].update(block.items[block.item_at[w] : block.item_at[w + 1]])

    def spans(self, row: int, base: int) -> list[tuple[int, int]]:
        """Byte spans of the row's merged hits, from the first byte of a word to the end of one."""
        lo, hi = self.starts[row], self.starts[row + 1]
        hit = np.concatenate([[False], self.mask[lo:hi], [False]])
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        return [(int(self.first[lo + a]) - base, int(self.end[lo + b - 1]) - base) for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def write_blocks(bench: DataFrame, key: int, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """The test items as blocks in the scratch folder, each built in a task; their names."""
    root = scratch_path(bench.sparkSession, "blocks")
    fs, path = local_files(root)
    fs.create_dir(path)
    items = bench.select(F.col(id_col).cast("string").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words_ = items.agg(F.sum(F.octet_length("text") / 4 + 1)).first()[0] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = local_files(root)
        made, ids, texts, size = [], [], [], 0

        def put() -> None:
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(pickle.dumps(Block(ids, texts, key)))
            made.append(f"{root}/{name}")

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text) // 4 + 1
                if size >= BLOCK_WORDS:
                    put()
                    ids, texts, size = [], [], 0
        if ids:
            put()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["block"])

    dealt = items.repartition(max(1, math.ceil(words_ / BLOCK_WORDS)))
    return sorted(r[0] for r in saved(arrow_map(dealt, build, "block string"), "blocks").collect())  # a name for BLOCK_WORDS words


_held: dict[str, Block] = {}


def _block(url: str) -> Block:
    if url not in _held:
        _held.clear()
        fs, path = local_files(url)
        with fs.open_input_stream(path) as f:
            _held[url] = pickle.loads(f.read())  # noqa: S301  written by this operator
    return _held[url]


def find_hits(data: np.ndarray, offsets: np.ndarray, blocks: list[str], key: int) -> Hits:
    hits = Hits(data, offsets, key)
    for url in blocks:
        hits.add(_block(url))
    return hits


def shards(batches: Iterator[pa.RecordBatch], text_at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to about limit bytes of text."""
    held, size = [], 0
    for batch in batches:
        lo = 0
        sizes = np.diff(utf8(batch.column(text_at))[1])
        for i, s in enumerate(sizes):
            size += int(s)
            if size >= limit:
                held.append(batch.slice(lo, i + 1 - lo))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, lo = [], 0, i + 1
        if lo < len(batch):
            held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) for each row.

    items are the item_ids with occurring windows, sorted as strings; spans are
    (first byte, end byte) of the text.
    """
    key = words.fresh_key()
    blocks = write_blocks(bench, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, 1, SHARD_BYTES):
            data, offsets = utf8(batch.column(1))
            hits = find_hits(data, offsets, blocks, key)
            total = np.concatenate([[0], np.cumsum(hits.mask)])
            n_hit = total[hits.starts[1:]] - total[hits.starts[:-1]]
            items = [sorted(x) for x in hits.items]
            spans = [[{"first": a, "end": b} for a, b in hits.spans(i, int(offsets[i]))] if n_hit[i] else [] for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(hits.starts)),
                    pa.array(n_hit.astype(np.int64)),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                    pa.array(n_hit > 0),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(chosen, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<first:long,end:long>>")


def without_hits(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with all hit spans cut out of their texts, until no window occurs in them.

    All columns stay; n_chars, where there is one, follows the text. A text that was
    nothing but test words becomes empty.
    """
    key = words.fresh_key()
    blocks = write_blocks(bench, key)
    at = docs.columns.index(text_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, at, CUT_BYTES):
            data, offsets = utf8(batch.column(at))
            hits = find_hits(data, offsets, blocks, key)
            total = np.concatenate([[0], np.cumsum(hits.mask)])
            dirty = np.flatnonzero(total[hits.starts[1:]] > total[hits.starts[:-1]])
            changed: dict[int, bytes] = {}
            now = {int(i): (bytes(data[offsets[i] : offsets[i + 1]]), hits.spans(int(i), int(offsets[i]))) for i in dirty}
            while now:
                changed |= {i: b" ".join(raw[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(raw)], strict=True)) for i, (raw, spans) in now.items()}
                rows = list(now)
                joined = np.frombuffer(b"".join(changed[i] for i in rows), np.uint8)
                ends = np.concatenate([[0], np.cumsum([len(changed[i]) for i in rows])]).astype(np.int64)
                again = find_hits(joined, ends, blocks, key)
                total = np.concatenate([[0], np.cumsum(again.mask)])
                now = {i: (changed[i], again.spans(k, int(ends[k]))) for k, i in enumerate(rows) if total[again.starts[k + 1]] > total[again.starts[k]]}
            columns = list(batch.columns)
            if changed:
                texts = batch.column(at).to_pylist()
                for i, raw in changed.items():
                    texts[i] = raw.decode()
                columns[at] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    k = names.index("n_chars")
                    counts = batch.column(k).to_pylist()
                    for i in changed:
                        counts[i] = len(texts[i])
                    columns[k] = pa.array(counts, batch.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs, run, docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")
