"""WARC archives of captured pages, and their capture index by an external merge.

1. A page's payload is its html in UTF-8 (null: empty). Of equal payloads of at least
   MIN_BYTES the smallest page_id becomes a response record, the others revisit it; a count
   by digest, combined before the shuffle, decides that. Marks go back to the rows by
   page_id and digest, so each row is judged by its own payload.
2. Every task writes its records, one gzip member each, to archives of at most
   ARCHIVE_BYTES in the shared scratch folder, under a name of its own that is renamed
   when complete; a repeated task leaves a second archive that no one reads.
3. The archives are read back record by record; each makes a capture run, sorted by
   (URL key, timestamp, page_id) and written next to it in blocks of BLOCK_LINES. The
   first and last key of each block are rows of a table.
4. The key space is cut into ranges of about RANGE_LINES captures, at most RANGES of them,
   whose bounds come from a range partitioning of the block table. Runs form groups of
   about FAN_IN. A task merges one range of one group with a loser tree, reading each run
   as a stream, into a run of its own; the groups' runs form groups again, until one is
   left. Every level has ranges x groups tasks, the last one a task for each range. What
   a task reads is rows of a table; only bounds and counts come to the driver. Bounds are
   whole keys, so a URL with very many captures is cut by time.

The result follows the merged histories and comes from what was read back, never from
the input. Ties in (URL key, timestamp) go by page_id; a null url has an empty key;
repeated rows become records of their own, and rows that repeat the response's page_id
and payload are responses too, and so are rows without a page_id. Other columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, local_files, saved, scratch_path, table

MIN_BYTES = 0
ARCHIVE_BYTES = 64 << 20
FAN_IN = 64
#: Lines of a run between two places where reading can begin.
BLOCK_LINES = 256
RANGE_LINES, RANGES = 50_000, 4096
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, timestamp string, archive string, offset long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower-cased: captures of a site sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


def stamp(page_id: int | None) -> str:
    """The capture time of a page without one: seconds since 2024 by page_id."""
    import datetime as dt

    return (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the format's own digest


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {stamp(page_id)}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Page-ID: {"" if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"WARC-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(http) + len(body)}")
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n") + pack.flush()


def read_records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each gzip member of an archive."""
    offset, raw = 0, b""
    while True:
        if not raw:
            raw = stream.read(1 << 20)
            if not raw:
                return
        unpack, parts, size = zlib.decompressobj(31), [], 0
        while True:
            parts.append(unpack.decompress(raw))
            size += len(raw) - len(unpack.unused_data)
            raw = unpack.unused_data
            if unpack.eof:
                break
            raw = stream.read(1 << 20)
            if not raw:
                raise ValueError("an archive ends inside a record")
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield offset, headers, rest[: int(headers["Content-Length"])]
        offset += size


def _capture(archive: str, offset: int, headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    found = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != found):
        raise ValueError(f"a payload differs from its digest: {archive} at {offset}")
    refers = headers.get("WARC-Refers-To-Page")
    return (url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], int(headers["WARC-Page-ID"]) if headers["WARC-Page-ID"] else None, size, found, headers["WARC-Type"], int(refers) if refers else None, archive, offset)


class LoserTree:
    """k sorted iterators as one: every inner node keeps the loser of the match below it."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while True:
            i = self.tree[0]
            if i < 0 or self.heads[i] is None:
                return
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            node, winner = (i + self.k) // 2, i
            while node > 0:
                other = self.tree[node]
                if self._less(other, winner):
                    self.tree[node], winner = winner, other
                node //= 2
            self.tree[0] = winner


def _line(row: tuple) -> bytes:
    return b"\t".join(str("" if x is None else x).replace("\t", "%09").replace("\n", "%0A").encode() for x in row)


def _row(line: bytes) -> tuple:
    f = line.decode().split("\t")
    return (f[0], f[1], int(f[2]) if f[2] else None, int(f[3]), f[4], f[5], int(f[6]) if f[6] else None, f[7], int(f[8]))


def _key(row: tuple) -> tuple:
    """Order of captures; rows without a page_id come first."""
    return row[0], row[1], -1 << 63 if row[2] is None else row[2]


def _rank(row: tuple) -> tuple:
    return *_key(row), row[7], row[8]


def write_run(root: str, rows: Iterator[tuple]) -> tuple[str, list[tuple]]:
    """Sorted rows as a file of blocks; its name, and (offset, lines, first key, last key) of each block."""
    fs, path = local_files(root)
    name = f"run-{uuid.uuid4().hex}"
    blocks, at, buffer, first, last = [], 0, [], None, None
    with fs.open_output_stream(f"{path}/{name}.tmp") as f:

        def flush() -> None:
            nonlocal at, buffer, first
            if buffer:
                raw = b"\n".join(buffer)
                f.write(struct.pack("<I", len(raw)) + raw)
                blocks.append((at, len(buffer), _key(first), _key(last)))
                at += 4 + len(raw)
                buffer, first = [], None

        for row in rows:
            first, last = first or row, row
            buffer.append(_line(row))
            if len(buffer) == BLOCK_LINES:
                flush()
        flush()
    fs.move(f"{path}/{name}.tmp", f"{path}/{name}")
    return f"{root}/{name}", blocks


def read_run(url: str, offset: int, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The rows of a run from low on and below high, as a stream."""
    fs, path = local_files(url)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        while head := f.read(4):
            for line in f.read(struct.unpack("<I", head)[0]).split(b"\n"):
                row = _row(line)
                if high is not None and _key(row) >= high:
                    return
                if low is None or _key(row) >= low:
                    yield row


def merge_task(sources: list[tuple[str, int]], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    streams = [((_rank(r), r) for r in read_run(url, at, low, high)) for url, at in sources]
    return (r for _, r in LoserTree(streams))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, read back, index and merge: FIELDS for each page, in the order of the histories."""
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    fs, path = local_files(root)
    fs.create_dir(path)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    pages = pages.withColumn("sum", F.sha1("html"))
    sums = pages.select("page_id", F.octet_length("html").alias("size"), "sum")
    first = sums.where(F.col("size") >= MIN_BYTES).groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sum", "first")
    again = sums.join(first, "sum").where("page_id <> first").select("page_id", "sum", F.col("first").alias("refers_to")).distinct()
    rows = pages.join(again, ["page_id", "sum"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = local_files(root)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        part, size, out, made = 0, 0, None, []
        for batch in batches:
            for page, url, text, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}-{part:04d}.tmp")
                raw = record(page, url, text.encode(), refers)
                out.write(raw)
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    made.append(f"{name}-{part:04d}")
                    part, size, out = part + 1, 0, None
        if out is not None:
            out.close()
            made.append(f"{name}-{part:04d}")
        for x in made:
            fs.move(f"{path}/{x}.tmp", f"{path}/{x}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([f"{x}.warc.gz" for x in made], pa.string())], ["archive"])

    archives = saved(arrow_map(rows.select("page_id", "url", "html", "refers_to"), write, "archive string"), "archives")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = local_files(root)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{path}/{archive}", compression=None) as f:
                    found = [_capture(archive, *x) for x in read_records(f)]
                found.sort(key=_rank)
                run, blocks = write_run(root, iter(found))
                columns = list(zip(*((run, at, n, *low, *high) for at, n, low, high in blocks), strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK_TYPES, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

    count = max(1, archives.count())
    blocks = saved(arrow_map(archives.repartition(count, "archive"), index, BLOCKS), "blocks")
    lines = blocks.agg(F.sum("lines")).first()[0] or 0
    ranges = min(RANGES, max(1, -(-lines // RANGE_LINES)))
    # the least keys of a range partitioning, at most RANGES or the session's partitions
    parted = blocks.select("key", "stamp", "page").repartitionByRange(ranges, "key", "stamp", "page").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "stamp", "page")).alias("low"))
    edges = sorted({tuple(r["low"]) for r in parted.collect()})[1:]
    groups = -(-count // FAN_IN)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each range that a block has keys of."""
        for batch in batches:
            out: list[list] = [[], [], []]
            for run, at, _, *keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in range(bisect.bisect_right(edges, tuple(keys[:3])), bisect.bisect_right(edges, tuple(keys[3:])) + 1):
                    for x, v in zip(out, (r, run, at), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.string(), pa.int64()), strict=True)], ["part", "run", "offset"])

    def tasks_of(sources: DataFrame, groups: int) -> DataFrame:
        """(part, group, sources): a merge for each row."""
        one = sources.groupBy("part", F.pmod(F.xxhash64("run") if "group" not in sources.columns else F.col("group"), F.lit(groups)).cast("int").alias("group"), "run").agg(F.min("offset").alias("offset"))
        return one.groupBy("part", "group").agg(F.collect_list(F.struct("run", "offset")).alias("sources"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, group, sources in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                run, _ = write_run(root, merge_task([(s["run"], s["offset"]) for s in sources], *_between(edges, part)))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([group], pa.int32()), pa.array([run]), pa.array([0], pa.int64())], ["part", "group", "run", "offset"])

    sources = arrow_map(blocks, assign, "part int, run string, offset long")
    while groups > 1:
        tasks = saved(tasks_of(sources, groups), "merges").repartition(min(MERGES, (len(edges) + 1) * groups), "part", "group")
        sources = saved(arrow_map(tasks, merge, "part int, group int, run string, offset long"), "merged")
        groups = -(-groups // FAN_IN)

    def histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sources in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = []
                for row in merge_task([(s["run"], s["offset"]) for s in sources], *_between(edges, part)):
                    held.append(row)
                    if len(held) == 5000:
                        yield _fields(held)
                        held = []
                if held:
                    yield _fields(held)

    last = saved(tasks_of(sources, 1).select("part", "sources"), "merges")
    return arrow_map(last.repartitionByRange(len(edges) + 1, "part").sortWithinPartitions("part"), histories, FIELDS)


#: Tasks of a level at most; a task merges several ranges and groups where there are more.
MERGES = 20_000
BLOCKS = "run string, offset long, lines long, key string, stamp string, page long, last_key string, last_stamp string, last_page long"
_BLOCK_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in BLOCKS.split(", ")]


def _between(edges: list[tuple], part: int) -> tuple[tuple | None, tuple | None]:
    """The bounds of a range."""
    return edges[part - 1] if part else None, edges[part] if part < len(edges) else None


def _fields(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    order = [(2, pa.int64()), (3, pa.int64()), (4, pa.string()), (5, pa.string()), (6, pa.int64()), (0, pa.string()), (1, pa.string()), (7, pa.string()), (8, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c[i], t) for i, t in order], [x.split()[0] for x in FIELDS.split(", ")])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
