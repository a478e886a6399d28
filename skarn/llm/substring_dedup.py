"""Repeated passages: bytes covered by a LENGTH-byte string that starts anywhere else too.

A sparse suffix array over minimizer positions, partitioned by range:

1. Every window of LENGTH bytes owns an anchor, its K-gram of least hash. Equal windows
   own anchors at the same offset, so only windows of anchors whose K-gram occurs twice
   can repeat. The windows of one anchor follow each other; together they are a segment.
2. Segments that occur twice as a whole are repeated in all their windows; a count by
   digest within the K-gram, combined on every task before the shuffle, settles them,
   however many copies.
3. Of the other segments with a repeated anchor, and one copy of those under 2, the
   suffixes that start at the anchor (and behind it, what stands left of the anchor, read
   backwards) are range-partitioned with sampled splitters into buckets of about
   BUCKET_BYTES. A bucket is sorted by multikey quicksort over tokens of 8 bytes. Of
   neighbours the bytes they share right and left of the anchor are counted: windows that
   lie in what they share repeat. The first and last suffix of each bucket are sorted and
   compared among themselves, so neighbours across boundaries meet as well.
4. A neighbour shares the most bytes to the right that any segment shares. So windows that
   need more are unique, and segments that have only such windows go. The rest is sorted
   by its K-gram and then by the bytes left of the anchor, backwards, which gives the most
   that any segment shares on that side. Windows within both limits that no neighbour has
   confirmed (their two halves have different partners) are counted by digest with the
   windows of that K-gram within their own limits.
5. Covered bytes are merged and cut out of each text.

No segment meets all others of its K-gram, no copy is sent twice and no suffix is a key
that another one has, so a frequent passage spreads over many buckets.

Strings never cross documents, overlaps count, and all is judged on the input. Null is
empty. Texts below LENGTH bytes stay whole. Rows that repeat a doc_id and text are copies
of each other. Neighbours are compared by their bytes; segments of one K-gram as wholes,
and windows under 4, by 64-bit digests within the K-gram. Other columns are ignored; empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, saved, slices, table, utf8
from .words import _M2, _P, _PINV, _power, mix

LENGTH = 200
K = 32
#: Windows of a long text that are handled at once; positions in a piece take PLACE bits of a minimizer's key.
PIECE, PLACE = 8 << 20, 24
#: Bytes of a bucket's suffixes, on average.
BUCKET_BYTES = 16 << 20
ANCHORS = "kind int, gram long, seg long, cnt long, row long, key long, at int, first int, size int"


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("p", _P, len(data))[: len(data)], out=sums[1:])
    return sums


def _digest(sums: np.ndarray, first: np.ndarray, size) -> np.ndarray:
    inv = _power("inv", _PINV, len(sums))
    return mix((sums[first + size] - sums[first]) * inv[first] + np.asarray(size, np.uint64) * _M2)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of the rows: (row, anchor, first window, windows, gram digest, segment digest).

    More bytes than positions fit beside a hash are handled in pieces that overlap by
    LENGTH - 1 bytes, so each window is in one piece, and a segment that a piece's end
    cuts goes on as another segment of the same anchor.
    """
    found, begin = [], 0
    while True:
        end = min(len(data), begin + PIECE + LENGTH - 1)
        row, anchor, first, *rest = _anchors(data[begin:end], np.clip(offsets - begin, 0, end - begin))
        found.append((row, anchor + begin, first + begin, *rest))
        if end == len(data):
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))
        begin += PIECE


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    assert len(data) < 1 << PLACE
    n, w = len(data), LENGTH - K + 1
    starts = n - LENGTH + 1
    none = np.zeros(0, np.int64)
    if starts <= 0:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = _sums(data)
    grams = _digest(sums, np.arange(n - K + 1), K)
    keys = (grams & ~np.uint64((1 << PLACE) - 1)) | np.arange(n - K + 1, dtype=np.uint64)
    pad = -len(keys) % w
    tiles = np.concatenate([keys, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
    owner = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    valid = np.arange(starts) + LENGTH <= offsets[1:][row]
    s = np.flatnonzero(valid)
    if not len(s):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.concatenate([[True], (owner[s[1:]] != owner[s[:-1]]) | (row[s[1:]] != row[s[:-1]])])
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [len(s)]]))
    first = s[at]
    anchor = owner[first]
    seg = mix(_digest(sums, first, count + LENGTH - 1) + (anchor - first).astype(np.uint64) * _P)
    return row[first], anchor, first, count, grams[anchor], seg


def _merge(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return first[at], end[np.concatenate([at[1:] - 1, [len(end) - 1]])]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ANCHORS.split(", ")]
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, hi in slices(np.diff(offsets)):
            base = offsets[lo : hi + 1] - offsets[lo]
            row, anchor, first, count, gram, seg = anchors(data[offsets[lo] : offsets[hi]], base)
            if not len(row):
                continue
            # segments that a text holds twice repeat: one goes on, the places of all are covered here
            pair = mix(seg + row.astype(np.uint64) * _M2)
            _, one, which, copies = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            local = np.flatnonzero(copies[which] > 1)
            out = [np.zeros(len(one), np.int32), gram[one].view(np.int64), seg[one].view(np.int64), copies, row[one], row[one], anchor[one], first[one], count[one]]
            if len(local):
                shift = base[:-1] + np.arange(len(base) - 1)  # rows stay apart in the merge
                a, b = _merge(first[local] + row[local], first[local] + count[local] + LENGTH - 1 + row[local])
                r = np.searchsorted(shift, a, "right") - 1
                more = [np.ones(len(a), np.int32), a * 0, a * 0, a * 0, r, r, a - r, a - r, b - a]
                out = [np.concatenate([x, y]) for x, y in zip(out, more, strict=True)]
            r = out[4]
            out[6], out[7] = out[6] - base[r], out[7] - base[r]
            arrays = [pa.array(out[0], pa.int32()), *(pa.array(out[i], pa.int64()) for i in (1, 2, 3)), pa.array(ids[lo:hi][r]), pa.array(keys[lo:hi][r]), *(pa.array(out[i], pa.int32()) for i in (6, 7, 8))]
            yield pa.RecordBatch.from_arrays(arrays, names)


#: A segment: its windows start `low` to `high` bytes before the anchor `at`; the bytes from
#: the anchor on, and those before it backwards, each with an end mark that sorts last.
SEGMENT = "row long, key long, at int, gram long, open boolean, low int, high int, right binary, left binary"
#: The most bytes shared with any segment on a side, and the ranges of windows known to repeat.
FOUND = "most int, marks array<struct<a:int,b:int>>, edge boolean"
_END = b"\xff"  # in no UTF-8 text
_MARKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for row, key, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            for p in parts:
                at, first, size = p["at"], p["first"], p["size"]
                rows.append((row, key, at, p["gram"], p["open"], at - first - size + 1, at - first, raw[at : first + size - 1 + LENGTH] + _END, raw[first:at][::-1] + _END))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SEGMENT.split(", ")])


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, filled up with end marks to a multiple of 8; and their lengths without the mark."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    sizes = np.diff(at)
    out = np.full((len(column), -(-width // 8) * 8), 255, np.uint8)
    if len(column):
        inside = np.arange(out.shape[1])[None, :] < sizes[:, None]
        out[inside] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return out, sizes - 1


def multikey(tokens: np.ndarray) -> np.ndarray:
    """Order of rows of tokens: multikey quicksort, all parts of one depth together.

    Rows are split by one token; only parts of several rows go on to the next one.
    """
    order = np.argsort(tokens[:, 0], kind="stable")
    part = np.concatenate([[0], np.cumsum(tokens[order[1:], 0] != tokens[order[:-1], 0])]) if len(order) else order
    for depth in range(1, tokens.shape[1]):
        sizes = np.bincount(part)
        at = np.flatnonzero(sizes[part] > 1)
        if not len(at):
            break
        again = np.lexsort((tokens[order[at], depth], part[at]))
        order[at] = order[at[again]]
        new = np.zeros(len(order), bool)
        new[1:] = part[1:] != part[:-1]
        inner = at[1:][at[1:] == at[:-1] + 1]
        new[inner] |= (tokens[order[inner], depth] != tokens[order[inner - 1], depth]) & (part[inner] == part[inner - 1])
        part = np.cumsum(new)
    return order


def _shared(x: np.ndarray, nx: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that rows a and b of a matrix share."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), 4096):
        i, j = a[lo : lo + 4096], b[lo : lo + 4096]
        differ = x[i] != x[j]
        out[lo : lo + 4096] = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    return np.minimum(out, np.minimum(nx[a], nx[b]))


def _sorted(backwards: bool):
    """The suffixes of one bucket, compared with their neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        del held
        names = rows.column_names
        (right, nr), (left, nl) = (_matrix(rows.column(c).combine_chunks(), w) for c, w in (("right", LENGTH + 1), ("left", LENGTH - K + 1)))
        whole = np.concatenate([right[:, :K], left, right[:, K:]] if backwards else [right, left], 1)
        order = multikey(whole.view(">u8").astype(np.uint64))
        del whole
        a, b = order[:-1], order[1:]
        to_right, to_left = _shared(right, nr, a, b), _shared(left, nl, a, b)
        same = to_right >= K  # else they don't share the anchor
        n = len(order)
        most = np.full(n, -1, np.int64)
        best = np.where(same, to_left if backwards else to_right, -1)
        most[a] = best
        most[b] = np.maximum(most[b], best)
        low = np.where(same & (LENGTH - to_right <= to_left), LENGTH - to_right, -1)
        before, after, upto = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros((2, n), np.int64)
        after[a], upto[0, a] = low, to_left
        before[b], upto[1, b] = low, to_left
        edge = np.zeros(n, bool)
        edge[order[[0, -1]]] = True
        starts, ends = np.stack([after, before], 1), np.stack([upto[0], upto[1]], 1)
        ok = starts >= 0
        offsets = np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(starts[ok], pa.int32()), pa.array(ends[ok], pa.int32())], names=["a", "b"])
        marks = pa.ListArray.from_arrays(pa.array(offsets), pairs)
        out = pa.Table.from_arrays([*(rows.column(c) for c in names), pa.array(most, pa.int32()), marks, pa.array(edge)], [*names, "most", "marks", "edge"])
        if not backwards:  # without a partner for even one window: no use to anyone
            high = rows.column("high").to_numpy()
            out = out.filter(pa.array(edge | (most + high >= LENGTH)))
        yield from out.to_batches(max_chunksize=2000)

    return run


def _neighbours(segments: DataFrame, backwards: bool, size: int) -> DataFrame:
    """The segments with FOUND: what they share with their neighbours in sorted order."""
    spark, ids = segments.sparkSession, ["row", "key", "at", "low"]  # a piece's end can cut a segment in two
    schema = T.StructType([*segments.schema.fields, *T._parse_datatype_string(FOUND).fields])
    order = [F.substring("right", 1, K), F.col("left"), F.col("right")] if backwards else [F.col("right"), F.col("left")]
    n = max(1, -(-size // BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = saved(arrow_map(segments.repartitionByRange(n, *order), _sorted(backwards), schema), "sorted")
    # two rows of each bucket: one task sorts them, or they are dealt over buckets again
    edges = found.where("edge").select(*segments.columns)
    ends = 2 * n * (2 * LENGTH)
    if ends <= BUCKET_BYTES:
        across = arrow_map(edges.repartition(1), _sorted(backwards), schema)
    else:
        across = _neighbours(saved(edges, "edges"), backwards, ends)
    across = across.select(*ids, F.col("most").alias("_most"), F.col("marks").alias("_marks"))
    fixed = found.where("edge").join(saved(across, "across"), ids, "left")
    fixed = fixed.withColumn("most", F.greatest("most", "_most")).withColumn("marks", F.when(F.col("_marks").isNull(), F.col("marks")).otherwise(F.concat("marks", "_marks")))
    return found.where("not edge").unionByName(fixed.drop("_most", "_marks")).drop("edge")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows known to repeat, and ranges (a, b) of those that still may."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for row, key, at, gram, open_, low, high, r, l, *marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not open_:
                continue
            done, at_ = [], max(low, LENGTH - r)
            last = min(high, l)
            for m in sorted((m["a"], m["b"]) for x in marks for m in x):
                if done and m[0] <= done[-1][1] + 1:
                    done[-1][1] = max(done[-1][1], m[1])
                else:
                    done.append(list(m))
            rest = []
            for a, b in done:
                if at_ < a:
                    rest.append((at_, a - 1))
                at_ = max(at_, b + 1)
            if at_ <= last:
                rest.append((at_, last))
            for kind, ranges in ((0, done), (1, rest)):
                for a, b in ranges:
                    for x, v in zip(out, (kind, row, key, gram, at, (a, b)), strict=True):
                        x.append(v)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out, kinds, strict=False)), pa.array([x[0] for x in out[5]], pa.int32()), pa.array([x[1] for x in out[5]], pa.int32())], ["kind", "row", "key", "gram", "at", "a", "b"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows a to b of segments, by digest."""
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for lo in range(0, len(rows), 2000):
            part = rows[lo : lo + 2000]
            raws = [left[:-1][::-1] + right[:-1] for _, _, _, _, left, right, _, _ in part]
            begin = np.cumsum([0, *map(len, raws)])[:-1]
            count = np.array([b - a + 1 for *_, a, b in part], np.int64)
            which = np.repeat(np.arange(len(part)), count)
            back = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.array([a for *_, a, _ in part], np.int64)[which]
            high = np.array([len(x[4]) - 1 for x in part], np.int64)
            data = np.frombuffer(b"".join(raws), np.uint8)
            digest = _digest(_sums(data), begin[which] + high[which] - back, LENGTH)
            ids = [pa.array([x[i] for x in part], t).take(pa.array(which)) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(back, pa.int32()), pa.array(digest.view(np.int64))], ["row", "key", "at", "gram", "back", "digest"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,end:long>>"
_RESULT = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]


def _kept(doc, raw: bytes, spans: list) -> tuple:
    """A row of RESULT."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if spans:
        a, b = _merge(np.array([s["first"] for s in spans], np.int64), np.array([s["first"] + s["size"] for s in spans], np.int64))
    edge = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
    keep = b"".join(raw[x:y] for x, y in zip(edge[0::2], edge[1::2], strict=True))
    return doc, len(raw), len(raw) - len(keep), len(a), hashlib.sha256(keep).hexdigest(), [{"first": int(p), "end": int(q)} for p, q in zip(a, b, strict=True)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")][:5] + ["spans"]
    for batch in batches:
        rows = [_kept(doc, (text or "").encode(), spans) for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_RESULT)], names)


#: Results of the texts that no segment waits for; the others with what is known of them.
PARTLY = "row long, key long, text string, known array<struct<first:int,size:int>>, parts array<struct<at:int,first:int,size:int,gram:long,open:boolean>>"


def _early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")][:5] + ["spans", "row", "key", "text", "known", "parts"]
    for batch in batches:
        doc, row, key, text, known, parts = batch.columns
        n = [len(p) if p is not None else 0 for p in parts.to_pylist()]
        rows = [_kept(d, (t.as_py() or "").encode(), k) if not w else (d, None, None, None, None, None) for d, t, k, w in zip(doc.to_pylist(), text, known.to_pylist(), n, strict=True)]
        waits = pa.array([w > 0 for w in n])
        none = pa.scalar(None, pa.string())
        yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in enumerate(_RESULT)), row, key, pc.if_else(waits, text, none), known, parts], names)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row; spans are in bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text").alias("key"), "text")
    found = arrow_map(docs.select("row", "key", "text"), _find, ANCHORS)
    places = found.where("kind = 0")
    grams = places.groupBy("gram").agg(F.sum("cnt").alias("n")).where("n > 1").select("gram")
    open_ = saved(places.join(grams, "gram"), "repeated-anchors")
    rep = F.min(F.struct("row", "key", "at", "first", "size")).alias("rep")
    segs = saved(open_.groupBy("gram", "seg").agg(F.sum("cnt").alias("n"), rep), "segments").select("gram", "seg", "n", "rep.*")
    whole, single = segs.where("n > 1"), segs.where("n = 1")
    # what occurs once as a whole is compared with its like and with one copy of what repeats
    parts = single.withColumn("open", F.lit(True)).unionByName(whole.join(single.select("gram").distinct(), "gram", "left_semi").withColumn("open", F.lit(False)))
    parts = parts.select("row", "key", F.struct("at", "first", "size", "gram", "open").alias("part"), F.lit(None).cast("struct<first:int,size:int>").alias("span"))
    spans = open_.join(whole.select("gram", "seg"), ["gram", "seg"], "left_semi").select("row", "key", "first", (F.col("size") + LENGTH - 1).alias("size"))
    spans = spans.unionByName(found.where("kind = 1").select("row", "key", "first", "size"))
    spans = spans.select("row", "key", F.lit(None).cast(T.StructType(parts.schema["part"].dataType.fields)).alias("part"), F.struct("first", "size").alias("span"))
    by_doc = spans.unionByName(parts).distinct().groupBy("row", "key").agg(F.collect_list("span").alias("known"), F.collect_list("part").alias("parts"))
    joined = docs.join(by_doc, ["row", "key"], "left").select("doc_id", "row", "key", "text", "known", "parts")
    joined = saved(arrow_map(joined, _early, f"{RESULT}, {PARTLY}"), "documents")
    waiting = joined.where("text is not null")
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    segments = saved(arrow_map(waiting.select("row", "key", "text", "parts"), _segments, SEGMENT), "suffixes")
    size = segments.agg(F.sum(F.octet_length("right") + F.octet_length("left"))).first()[0] or 0
    forward = _neighbours(segments, False, size)
    # a window needs LENGTH bytes: those to the right that some segment shares, the others at most all on the left
    forward = forward.where(f"most + high >= {LENGTH}").withColumnsRenamed({"most": "to_right", "marks": "known"})
    size = forward.agg(F.sum(F.octet_length("right") + F.octet_length("left"))).first()[0] or 0
    both = _neighbours(forward.select(*names, "to_right", "known"), True, size)
    settled = saved(arrow_map(both.select("row", "key", "at", "gram", "open", "low", "high", "to_right", "most", "known", "marks"), _settled, "kind int, row long, key long, gram long, at int, a int, b int"), "settled")
    rest = settled.where("kind = 1")
    more = settled.where("kind = 0").select("row", "key", (F.col("at") - F.col("b")).alias("first"), (F.col("b") - F.col("a") + LENGTH).alias("size"))
    if rest.limit(1).count():
        ranges = rest.groupBy("gram").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        near = forward.select("row", "key", "at", "gram", "left", "right", "high", F.greatest("low", LENGTH - F.col("to_right")).alias("lo")).join(ranges, "gram")
        near = near.select("row", "key", "at", "gram", "left", "right", F.greatest("lo", "a").alias("a"), F.least("high", "b").alias("b")).where("a <= b")
        windows = saved(arrow_map(near, _windows, "row long, key long, at int, gram long, back int, digest long"), "windows")
        twice = windows.groupBy("gram", "back", "digest").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        late = windows.join(twice, ["gram", "back", "digest"]).select("row", "key", (F.col("at") - F.col("back")).alias("first"), F.lit(LENGTH).alias("size"))
        more = more.unionByName(late)
    more = more.distinct().groupBy("row", "key").agg(F.collect_list(F.struct("first", "size")).alias("more"))
    nothing = F.array().cast("array<struct<first:int,size:int>>")
    open_texts = waiting.join(more, ["row", "key"], "left").select("doc_id", "text", F.concat("known", F.coalesce("more", nothing)).alias("spans"))
    done = joined.where("text is null").select(*[x.split()[0] for x in RESULT.split(", ")][:5], "spans")
    return done.unionByName(arrow_map(open_texts, _cut, RESULT))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")
