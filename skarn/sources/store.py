"""Versioned tables of a catalogue: merge on read, one log, one winner of every version.

A table is a list of immutable segments. A commit adds segments and, for tables with a key,
delete vectors: the keys whose rows in older segments are dead. Reading joins the two, so a
change costs what it changes. `compact` merges segments of one size tier, and applies the
vectors, once FANOUT of them have come together.

The log holds one file for each version, made by an atomic create: of two writers that
start from one version, one gets Conflict and has changed nothing.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments of one tier that are merged, and the bytes at which the tiers above the lowest begin.
FANOUT, SMALL = 8, 1 << 20
#: Keys of delete vectors that are broadcast to the reads; more are joined by a shuffle, and compaction is due.
FEW = 300_000
#: Spark's setting by which an execution removes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Layout:
    """How a table lies: key of its delete vectors, column whose ranges its files hold, folders, order in files."""

    key: str | None = None
    cluster: str | None = None
    partition: tuple[str, ...] = ()
    deal: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    nested: bool = False  # rows hold several keys: only the owner of the table can apply its delete vectors


LAYOUTS = {
    "pages": Layout("id", "id"),
    "chunks": Layout("page_id", "chunk_id"),
    "postings": Layout("page_id", None, ("shard",), ("shard", "part"), ("lexeme", "cell"), True),
    "cells": Layout("page_id", None, ("cell",), ("cell",), ("chunk_id",)),
}


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, or a temporary one of a local session."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skarn-")
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


class Store:
    """Tables below a folder: segments `<table>/_seq=N/_w=ID/`, delete vectors `_dead/<table>/...`, zones and the log.

    Files go through Hadoop, so any shared store works; versions are made by a hard link on
    a local file system and else by a rename that refuses to overwrite, which is atomic on
    HDFS. A store without such a rename needs a lock around `commit`.
    """

    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, Layout] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.layouts = LAYOUTS | (layouts or {})
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._known: dict[int, dict] = {0: {}}

    # the log

    def version(self) -> int:
        log = self._path(f"{self.root}/_log")
        if not self._fs.exists(log):
            return 0
        return max((int(n.removesuffix(".json")) for n in (s.getPath().getName() for s in self._fs.listStatus(log)) if n.endswith(".json")), default=0)

    def _entry(self, version: int | None) -> dict[str, dict]:
        version = self.version() if version is None else version
        if version not in self._known:
            stream = self._fs.open(self._path(f"{self.root}/_log/{version}.json"))
            try:
                self._known[version] = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self._known[version]

    def _put(self, version: int, entry: dict) -> int:
        """The log entry of a version; Conflict where it exists."""
        log, text = f"{self.root}/_log", json.dumps(entry, sort_keys=True)
        temp, target = f"{log}/.{uuid.uuid4().hex}", f"{log}/{version}.json"
        if self._fs.getScheme() == "file":
            place = lambda url: self._path(url).toUri().getPath()
            os.makedirs(place(log), exist_ok=True)
            with open(place(temp), "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(place(temp), place(target))
            except FileExistsError:
                raise Conflict(f"version {version} exists") from None
            finally:
                os.unlink(place(temp))
        else:
            self._renamed(temp, target, text, version)
        self._known[version] = entry
        return version

    def _renamed(self, temp: str, target: str, text: str, version: int) -> None:
        out = self._fs.create(self._path(temp), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(temp).toUri(), self._conf)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context.rename(self._path(temp), self._path(target), self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as e:
            self._fs.delete(self._path(temp), False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {version} exists") from None
            raise

    # reading

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self._entry(version))

    def _table(self, name: str, version: int | None) -> dict:
        entry = self._entry(version)
        if name not in entry:
            raise LookupError(f"no table {name}")
        return entry[name]

    def _scan(self, base: str, schema: T.StructType, paths: list[str]) -> DataFrame:
        """Files with the number of the commit that wrote them, _seq."""
        full = T.StructType([*schema.fields, T.StructField("_seq", T.IntegerType()), T.StructField("_w", T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], full).drop("_w")
        return self.spark.read.schema(full).option("basePath", base).parquet(*paths).drop("_w")

    def raw(self, name: str, version: int | None = None) -> tuple[DataFrame, DataFrame | None]:
        """The rows of all segments with _seq, and (key, _dead): a row is dead if _seq < _dead of its key."""
        held = self._table(name, version)
        return self._rows(name, held, [s["path"] for s in held["segments"]]), self._dead(name, held)

    def _rows(self, name: str, held: dict, paths: list[str]) -> DataFrame:
        return self._scan(f"{self.root}/{name}", T.StructType.fromJson(held["schema"]), paths)

    def _dead(self, name: str, held: dict) -> DataFrame | None:
        if not held["deletes"]:
            return None
        schema = T.StructType([f for f in T.StructType.fromJson(held["key"]).fields])
        keys = self._scan(f"{self.root}/_dead/{name}", schema, [d["path"] for d in held["deletes"]])
        dead = keys.groupBy(schema.fieldNames()[0]).agg(F.max("_seq").alias("_dead"))
        return F.broadcast(dead) if sum(d["rows"] for d in held["deletes"]) <= FEW else dead

    @staticmethod
    def living(rows: DataFrame, dead: DataFrame | None, key: str | None) -> DataFrame:
        """The rows that no delete vector has killed, without _seq."""
        if dead is None:
            return rows.drop("_seq")
        columns = [c for c in rows.columns if c != "_seq"]
        return rows.join(dead, key, "left").where("_dead is null or _seq >= _dead").select(*columns)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The live rows; of a nested table the rows as they lie."""
        layout = self.layouts.get(name, Layout())
        rows, dead = self.raw(name, version)
        return rows.drop("_seq") if layout.nested else self.living(rows, dead, layout.key)

    def files_with(self, name: str, ids: list[int], version: int | None = None) -> list[str]:
        """The files whose range of the clustered column holds one of the ids."""
        zones = [s["zones"] for s in self._table(name, version)["segments"] if s.get("zones")]
        if not zones or not ids:
            return []
        held = self.spark.read.schema("file string, lo long, hi long").parquet(*zones)
        wanted = F.array(*[F.lit(int(i)).cast("long") for i in sorted(set(ids))])
        return sorted(r["file"] for r in held.where(F.exists(wanted, lambda i: (i >= F.col("lo")) & (i <= F.col("hi")))).select("file").collect())

    def lookup(self, name: str, ids: list[int], version: int | None = None) -> DataFrame:
        """The live rows whose clustered column is one of a few ids; other files are not opened."""
        held, layout = self._table(name, version), self.layouts[name]
        rows = self._rows(name, held, self.files_with(name, ids, version)).where(F.col(layout.cluster).isin([int(i) for i in ids]))
        return self.living(rows, self._dead(name, held), layout.key)

    # writing

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """A frame that several tables of a commit read, written once; swept by `sweep`."""
        path = f"{self.root}/_staged/{name}-{uuid.uuid4().hex}"
        self._written(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _written(self, df: DataFrame, path: str, *partition: str) -> None:
        """Files of a frame; its shuffle files go when they are written, not when the driver collects its garbage."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").partitionBy(*partition).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)

    def sweep(self) -> None:
        """Remove staged frames; no commit may be under way."""
        self._fs.delete(self._path(f"{self.root}/_staged"), True)

    def _size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def _segment(self, name: str, df: DataFrame, seq: int, dealt: bool = False) -> dict | None:
        """Written rows; None where there are none."""
        layout, mark = self.layouts.get(name, Layout()), uuid.uuid4().hex[:12]
        path = f"{self.root}/{name}/_seq={seq}/_w={mark}"
        if layout.cluster:
            df = df.repartitionByRange(F.col(layout.cluster)).sortWithinPartitions(layout.cluster)
        elif layout.order:
            df = (df if dealt else df.repartition(*layout.deal)).sortWithinPartitions(*layout.partition, *layout.order)
        self._written(df, path, *layout.partition)
        written = self.spark.read.schema(df.schema).option("basePath", path).parquet(path)
        if layout.cluster:
            zones = f"{self.root}/_zones/{name}/{seq}-{mark}"
            found = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(layout.cluster).cast("long").alias("lo"), F.max(layout.cluster).cast("long").alias("hi"), F.count("*").alias("n"))
            self.staged(found, "zones").coalesce(1).write.parquet(zones)
            rows = self.spark.read.parquet(zones).agg(F.sum("n")).first()[0] or 0
            return {"path": path, "seq": seq, "rows": rows, "bytes": self._size(path), "zones": zones} if rows else None
        rows = written.count()
        return {"path": path, "seq": seq, "rows": rows, "bytes": self._size(path)} if rows else None

    def _vector(self, name: str, keys: DataFrame, seq: int) -> dict | None:
        path = f"{self.root}/_dead/{name}/_seq={seq}/_w={uuid.uuid4().hex[:12]}"
        keys.distinct().write.parquet(path)
        rows = self.spark.read.schema(keys.schema).parquet(path).count()
        return {"path": path, "seq": seq, "rows": rows} if rows else None

    @staticmethod
    def _useful(held: dict) -> dict:
        """Without the delete vectors that no segment is older than."""
        oldest = min((s["seq"] for s in held["segments"]), default=None)
        return held | {"deletes": [d for d in held["deletes"] if oldest is not None and oldest < d["seq"]]}

    def commit(self, tables: dict[str, DataFrame] | None = None, based_on: int | None = None, added: dict[str, DataFrame] | None = None, deleted: dict[str, DataFrame] | None = None, dealt: tuple[str, ...] = ()) -> int:
        """A new version: tables replaced as a whole, rows added, keys (frames of one column) deleted before that.

        dealt has the tables whose frames lie as their layout deals rows already.

        Segments are written first and the log entry last, so readers see all of a commit
        or none of it.
        """
        base = self.version() if based_on is None else based_on
        if self.version() != base:
            raise Conflict(f"version {base + 1} exists")
        entry, seq = dict(self._entry(base)), base + 1
        for name, df in (tables or {}).items():
            made = self._segment(name, df, seq, name in dealt)
            entry[name] = {"schema": json.loads(df.schema.json()), "segments": [made] if made else [], "deletes": []}
        for name, keys in (deleted or {}).items():
            key = self.layouts[name].key
            made = self._vector(name, keys.select(F.col(keys.columns[0]).alias(key)), seq)
            if made:
                shape = T.StructType([T.StructField(key, keys.schema.fields[0].dataType)])
                entry[name] = self._useful(entry[name] | {"deletes": [*entry[name]["deletes"], made], "key": json.loads(shape.json())})
        for name, df in (added or {}).items():
            if name not in entry:
                entry[name] = {"schema": json.loads(df.schema.json()), "segments": [], "deletes": []}
            fields = {f.name: f for f in T.StructType.fromJson(entry[name]["schema"]).fields}
            new = [f for f in df.schema.fields if f.name not in fields]
            shape = T.StructType([*fields.values(), *new])
            made = self._segment(name, df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape.fields if f.name in df.columns]), seq, name in dealt)
            entry[name] = entry[name] | {"schema": json.loads(shape.json()), "segments": [*entry[name]["segments"], *([made] if made else [])]}
        return self._put(seq, entry)

    @staticmethod
    def _tier(size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALL, FANOUT)) + 1) if size >= SMALL else 0

    def due(self, name: str, version: int | None = None) -> list[dict]:
        """The segments that are to be merged: tiers that are full, all that many delete vectors lie on."""
        held = self._table(name, version)
        tiers: dict[int, list] = {}
        for s in held["segments"]:
            tiers.setdefault(self._tier(s["bytes"]), []).append(s)
        full = [s for group in tiers.values() if len(group) >= FANOUT for s in group]
        if sum(d["rows"] for d in held["deletes"]) > FEW or len(held["deletes"]) > 4 * FANOUT:
            newest = max(d["seq"] for d in held["deletes"])
            full += [s for s in held["segments"] if s["seq"] < newest and s not in full]
        return full

    def compact(self, merge: dict | None = None) -> int | None:
        """Merge what is due; the version it makes, None where nothing is. merge has what rebuilds nested tables from (rows, dead)."""
        base = self.version()
        entry, seq, any_ = dict(self._entry(base)), base + 1, False
        for name, held in list(entry.items()):
            old, layout = self.due(name, base), self.layouts.get(name, Layout())
            if not old or (layout.nested and name not in (merge or {})):
                continue
            any_ = True
            rows, dead = self._rows(name, held, [s["path"] for s in old]), self._dead(name, held)
            made = self._segment(name, merge[name](rows, dead) if layout.nested else self.living(rows, dead, layout.key), seq)
            entry[name] = self._useful(held | {"segments": [s for s in held["segments"] if s not in old] + ([made] if made else [])})
        return self._put(seq, entry) if any_ else None

    def vacuum(self, keep: int = 2) -> int:
        """Remove the log entries before the newest `keep`, and the segments that none of those names; how many paths went."""
        top = self.version()
        log = self._path(f"{self.root}/_log")
        have = sorted(int(n.removesuffix(".json")) for n in (s.getPath().getName() for s in self._fs.listStatus(log)) if n.endswith(".json"))
        used, names = set(), set()
        for v in have:
            for name, held in self._entry(v).items():
                names.add(name)
                if v in have[-keep:]:
                    used |= {x["path"] for x in [*held["segments"], *held["deletes"]]}
        gone = 0
        for name in names:
            for folder in (f"{self.root}/{name}", f"{self.root}/_dead/{name}"):
                for s in self._fs.globStatus(self._path(f"{folder}/_seq=*/_w=*")) or []:
                    seq, mark = s.getPath().getParent().getName(), s.getPath().getName()
                    if int(seq.removeprefix("_seq=")) <= top and f"{folder}/{seq}/{mark}" not in used:  # later ones are being written
                        gone += bool(self._fs.delete(s.getPath(), True))
        for v in have[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_log/{v}.json"), False)
        return gone


def difference(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of after with a key that has changed, those keys): what a commit adds and deletes to turn one into the other."""
    both = before.select(*after.columns, F.lit(-1).alias("_n")).unionByName(after.withColumn("_n", F.lit(1)))
    odd = both.groupBy(*after.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").select(key).distinct()
    return after.join(odd, key, "left_semi").select(*after.columns), odd
