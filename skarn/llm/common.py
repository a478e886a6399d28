"""What the training-data operators share: scratch tables, components, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20
#: Rows and bytes of the batches that Spark sends to a worker; a longer single text goes alone.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

#: Rows of keys that are broadcast.
FEW = 300_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the session.

    Where it is unset (tests, notebooks on one machine) a local session gets a
    temporary folder; a session on a cluster must name a shared folder itself.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skarn-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared scratch folder."""
    return f"{scratch_root(spark)}/skarn/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table of the scratch folder: lineage is cut and any executor can read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(keys: DataFrame, name: str) -> DataFrame:
    """A table of row keys (two numbers) for a join: broadcast where it has FEW rows at most, else shuffled."""
    keys = saved(keys, name)
    return F.broadcast(keys) if keys.count() <= FEW else keys


def drop_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables, once the results that read them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark) + "/skarn")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches of bounded size, so that long texts don't pile up in a worker."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None) or ""
        if not (now.isdigit() and 0 < int(now) <= most):  # only ever lowered: the frame runs later, under the session's settings of then
            conf.set(key, str(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give a worker's freed memory back, as it stays alive for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to about limit, one row at least."""
    ends = np.cumsum(lengths, dtype=np.int64)
    start, n = 0, len(lengths)
    while start < n:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, end
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of each node of links (a, b): large-star and small-star rounds.

    A round takes the least neighbour of each node. Where every node has larger neighbours
    only, or exactly one smaller one, all components are stars and the round ends the
    search. Aggregations combine before the shuffle, equi-joins can be split by adaptive
    execution, so a hub's neighbours never meet in one task. Returns (id, component) for
    the ids that have a link to another one.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        edges = saved(edges, "edges")
        wide = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(wide.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("z")), "least")
        if not low.where("m < u and z > m").limit(1).count():
            return low.select(F.col("u").alias("id"), F.least("u", "m").alias("component"))
        large = edges.join(low.select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "v").select("u", "m").distinct()
        least = large.groupBy("u").agg(F.min("m").alias("v"))
        crossed = large.join(least, "u").where("m <> v").select(F.col("m").alias("u"), "v").distinct()
        edges = least.unionByName(crossed)


def local_files(root: str):
    """(pyarrow file system, path) of a folder that all machines share."""
    import pyarrow.fs as fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root)
