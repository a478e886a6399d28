"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles. Its sketch holds M registers; a
register is the truncated logarithm, base B, of the smallest value that one of M hash
functions takes on the set. Registers of a union are the larger ones of each pair, so
sketches merge, and two sets share a register about as often as their Jaccard
similarity says.

1. Documents with the same set form a class (64-bit digest of the set); the rest works on classes.
2. Bands of ROWS registers make bucket keys. In every bucket each member is paired with
   one representative, never with all others.
3. A pair's similarity is estimated from all registers jointly, by likelihood given both
   set sizes; pairs that the likelihood ratio excludes go, all others are confirmed on
   the full sets.
4. Components of the confirmed links. Where a representative still has neighbours of other
   components, those are compared, on full sets, with each other and with its neighbours
   of its own component: about BLOCK of them stay in memory, the others stream by, once for
   each main component whatever the number of bands, and only links between components
   come out. The components of those links join the first ones.

A pair at the threshold misses every band with probability (1 - t**ROWS)**BANDS, which is
7e-9 for t = 0.85 and 3e-6 for t = 0.8.

Full sets are sets of 64-bit hashes of shingles under a key drawn for each run: texts can't be
made to collide, and two shingles of a run share a hash with probability 2**-64.

Null or word-free texts have an empty set: n_shingles 0, linked with nothing, kept.
Every row is returned, rows that repeat a doc_id too, each placed by its own text; a
component is named by the smallest doc_id in it. A row without a doc_id is linked like any
other and kept only where its whole component has none. Other columns are ignored; empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import arrow_map, components, few, saved, slices, table, utf8

ROWS, BANDS = 5, 32
M = ROWS * BANDS
#: So small a base that unrelated sets seldom share a register, let alone a bucket.
B = 1.02
#: Twice the log-likelihood by which the best similarity may beat the threshold before a pair goes.
RATIO = 26.0
#: Documents whose sets stay in memory while STREAM others go by.
BLOCK, STREAM = 256, 1024
_A = np.random.default_rng(7).integers(0, 1 << 32, M, dtype=np.uint32) | np.uint32(1)
_C = np.random.default_rng(8).integers(0, 1 << 32, M, dtype=np.uint32)


def registers(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (rows x M, uint16) of non-empty sets of 64-bit hashes, laid end to end."""
    low = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(starts), M), np.uint16)
    for i in range(M):
        x = low ^ _C[i]
        x *= _A[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        smallest = np.minimum.reduceat(x, starts)
        out[:, i] = np.floor((32 - np.log2(smallest + 1.0)) * (math.log(2) / math.log(B)))
    return out


def distinct_sets(data: np.ndarray, offsets: np.ndarray, k: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, end to end; and the n + 1 row offsets."""
    hashes, _, _, starts = words.split(data, offsets, words.SPACE, key)
    found, at = words.grams(hashes, starts, k)
    parts, sizes = [], np.zeros(len(at), np.int64)
    for r in range(len(at) - 1):
        if at[r + 1] > at[r]:
            own = np.sort(found[at[r] : at[r + 1]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            parts.append(own)
            sizes[r + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


def _class(own: np.ndarray) -> int:
    """The id of a set: 64 bits of a digest of its sorted members."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(k: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(np.diff(offsets)):
                sets, at = distinct_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k, key)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                regs = registers(sets, at[:-1][full]) if len(full) else np.zeros((0, M), np.uint16)
                packed: list = [None] * len(sizes)
                ids: list = [None] * len(sizes)
                for j, r in enumerate(full):
                    packed[r] = regs[j].tobytes()
                    ids[r] = _class(sets[at[r] : at[r + 1]])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "row", "n", "id", "regs"])

    return run


def _sets(k: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in slices(np.diff(offsets)):
                sets, at = distinct_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k, key)
                own = [sets[at[i] : at[i + 1]] for i in range(hi - lo) if at[i + 1] > at[i]]
                yield pa.RecordBatch.from_arrays([pa.array([_class(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "set"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seed = np.random.default_rng(11).integers(1, 1 << 63, ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        if not len(batch):
            continue
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = words.mix((words.mix(regs * seed[:ROWS] + seed[1:]) * seed[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * seed[0]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "id"])


def estimate(greater: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity of pairs, and twice the log-likelihood it wins over the threshold.

    greater and less count the registers in which the first sketch is above or below the
    second; na and nb are the set sizes.
    """
    u = (na / (na + nb))[:, None]
    v = 1.0 - u
    most = np.minimum(u / v, v / u)
    grid = most * np.linspace(0.0, 1.0, 101)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (B - 1) / B) / math.log(B)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        same = np.maximum(1.0 - up - down, 1e-12)
        return greater[:, None] * np.log(up) + less[:, None] * np.log(down) + (M - greater - less)[:, None] * np.log(same)

    values = likelihood(grid)
    best = values.argmax(axis=1)
    rows = np.arange(len(best))
    at = likelihood(np.minimum(most, threshold))[:, 0]
    return grid[rows, best], np.where(grid[rows, best] >= threshold, 0.0, 2 * (values[rows, best] - at))


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b, na, nb = (batch.column(i) for i in range(4))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (4, 5))
            est, lost = estimate((x > y).sum(1), (x < y).sum(1), na.to_numpy().astype(float), nb.to_numpy().astype(float), threshold)
            ok = pa.array(lost <= RATIO)
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok), pa.array(est).filter(ok)], ["a", "b", "estimate"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                s, t = (x, y) if len(x) <= len(y) else (y, x)
                common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                good.append(den * common >= num * (len(x) + len(y) - common))
            ok = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return run


def _tiles(num: int, den: int):
    """Links between components, of tiles (main, tile, stream) that arrive sorted, outsiders first.

    The outsiders' sets, about BLOCK of them, stay in memory; every row of the tile is
    intersected with all of them at once and goes by. Only links that join components
    not yet joined in the tile come out, so their number is below that of the outsiders.
    """

    class Tile:
        def __init__(self) -> None:
            self.comps, self.sets, self.up = [], [], {}
            self.index = None

        def find(self, c: int) -> int:
            while self.up.setdefault(c, c) != c:
                self.up[c] = self.up[self.up[c]]
                c = self.up[c]
            return c

        def match(self, comp: int, own: np.ndarray, after: int, out: tuple[list, list]) -> None:
            if self.index is None:
                everything = np.concatenate(self.sets)
                owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
                order = np.argsort(everything, kind="stable")
                self.index = everything[order], owner[order], np.array([len(x) for x in self.sets])
            values, owner, sizes = self.index
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = hi - lo
            ends = np.cumsum(n)
            common = np.bincount(owner[np.arange(ends[-1]) + np.repeat(lo - ends + n, n)], minlength=len(sizes))
            for j in np.flatnonzero(den * common >= num * (sizes + len(own) - common)):
                x, y = self.find(comp), self.find(self.comps[j])
                if j > after and x != y:
                    self.up[x] = y
                    out[0].append(comp)
                    out[1].append(self.comps[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, Tile()
        out: tuple[list, list] = ([], [])

        def inner() -> None:
            if key[2]:  # once is enough
                return
            for j, own in enumerate(tile.sets[:-1]):
                tile.match(tile.comps[j], own, j, out)

        for batch in batches:
            out = ([], [])
            for main, t, stream, side, comp, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (main, t, stream) != key:
                    if tile.index is None and len(tile.sets) > 1:
                        inner()
                    key, tile = (main, t, stream), Tile()
                own = np.frombuffer(raw, np.uint64)
                if side == 0:
                    tile.comps.append(comp)
                    tile.sets.append(own.copy())
                elif tile.sets:
                    if tile.index is None:
                        inner()
                    tile.match(comp, own, -1, out)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
        out = ([], [])
        if tile.index is None and len(tile.sets) > 1:
            inner()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return run


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, row, n_shingles, component, component_id) for each row.

    row is a hash of doc_id and text, component a name of the group (null for empty sets).
    """
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    threshold, key = num / den, words.fresh_key()
    sketches = saved(arrow_map(docs, _sketch(shingle, key), "doc_id long, row long, n long, id long, regs binary"), "sketches")
    classes = sketches.where("id is not null").groupBy("id")
    nodes = saved(classes.agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("regs").alias("regs")), "nodes")
    bands = saved(arrow_map(nodes.select("id", "regs"), _bands, "band long, id long"), "bands")
    # class ids are digests, so the smallest is as good a representative as any; partial
    # minima combine before the shuffle: a frequent bucket is one row per task here
    stars = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("rep")).where("size > 1")
    near = saved(bands.join(stars, "band").where("id <> rep").groupBy("rep", "id").agg(F.max("size").alias("size")), "near")
    x = nodes.select(F.col("id").alias("rep"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    y = nodes.select("id", F.col("n").alias("nb"), F.col("regs").alias("rb"))
    pairs = near.join(x, "rep").join(y, "id").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)").select(F.col("rep").alias("a"), F.col("id").alias("b"), "na", "nb", "ra", "rb")
    likely = saved(arrow_map(pairs, _likely(threshold), "a long, b long, estimate double"), "likely").select("a", "b")
    # the full sets of all classes that may be compared, from the text of one row each
    need = near.where("size > 2").select("id").unionByName(likely.select(F.explode(F.array("a", "b")).alias("id")))
    rows = few(nodes.join(need, "id", "left_semi").select("row"), "needed")
    sets = arrow_map(docs.join(rows, "row", "left_semi").select("text"), _sets(shingle, key), "id long, set binary")
    sets = saved(sets.groupBy("id").agg(F.first("set").alias("set")), "sets")
    both = likely.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    comp = components(arrow_map(both.select("a", "b", "x", "y"), _confirm(num, den), "a long, b long"))
    # representatives with neighbours outside their component: those, and the neighbours
    # inside it, meet once for each main component
    mine, its = comp.select("id", F.col("component").alias("c")), comp.select(F.col("id").alias("rep"), F.col("component").alias("rc"))
    placed = saved(near.where("size > 2").join(mine, "id", "left").join(its, "rep", "left").select("rep", "id", F.coalesce("c", "id").alias("c"), F.coalesce("rc", "rep").alias("main")), "placed")
    if placed.where("c <> main").limit(1).count():
        mixed = placed.where("c <> main").select("rep").distinct()
        met = saved(placed.join(mixed, "rep", "left_semi").select("main", "id", "c").distinct(), "met")
        # outsiders fall into blocks by a hash, of BLOCK members on average
        outside = F.count(F.when(F.col("c") != F.col("main"), 1))
        blocks = met.groupBy("main").agg(F.ceil(outside / F.lit(BLOCK)).cast("int").alias("nb"), F.ceil(F.count("*") / F.lit(STREAM)).cast("int").alias("ns"))
        split = met.join(blocks, "main").withColumn("blk", F.when(F.col("c") == F.col("main"), F.col("nb")).otherwise(F.pmod(F.xxhash64("id", F.lit(3)), F.col("nb")).cast("int")))
        stays = split.where("blk < nb").select("main", F.col("blk").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("stream"), F.lit(0).alias("side"), "id", "c")
        passes = split.where("blk > 0").select("main", F.explode(F.sequence(F.lit(0), F.col("blk") - 1)).alias("tile"), F.pmod(F.xxhash64("id", F.lit(5)), F.col("ns")).cast("int").alias("stream"), F.lit(1).alias("side"), "id", "c")
        by = ["main", "tile", "stream"]
        tiled = stays.unionByName(passes).join(sets, "id").select(*by, "side", "c", "set")
        more = components(arrow_map(tiled.repartition(*by).sortWithinPartitions(*by, "side"), _tiles(num, den), "a long, b long"))
        merged = more.select(F.col("id").alias("c"), F.col("component").alias("d"))
        linked = mine.unionByName(more.select("id", F.col("id").alias("c"))).distinct().join(merged, "c", "left").select("id", F.coalesce("d", "c").alias("c"))
    else:
        linked = mine
    linked = saved(linked, "linked").join(nodes.select("id", F.col("doc_id").alias("first")), "id")
    named = linked.join(linked.groupBy("c").agg(F.min("first").alias("least")), "c").select("id", "c", "least")
    named = nodes.select("id", F.col("doc_id").alias("first")).join(named, "id", "left").select("id", F.coalesce("c", "id").alias("component"), F.when(F.col("c").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    out = sketches.where("id is not null").select("doc_id", "row", F.col("n").alias("n_shingles"), "id").join(named, "id").drop("id")
    empty = sketches.where("id is null").select("doc_id", "row", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; links have den * |A & B| >= num * |A | B|."""
    out = grouped(docs, id_col, text_col, shingle, num, den)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, and all rows with empty sets, with all their columns.

    The row with the smallest doc_id stays (null last; of rows that share it the one with
    the smallest hash; of repeated rows one). Decisions are by row, not by doc_id.
    """
    rows = saved(grouped(docs, id_col, text_col, shingle, num, den).where("component is not null").select("component", F.col("doc_id").isNull().alias("x"), "doc_id", "row"), "grouped")
    best = rows.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("x", "doc_id", "row")).alias("best")).where("n > 1")
    several = saved(rows.join(best, "component").select(F.coalesce("doc_id", F.lit(-1)).alias("_skarn_id"), F.col("row").alias("_skarn_row"), (F.struct("x", "doc_id", "row") == F.col("best")).alias("stays")), "several")
    key = ["_skarn_id", "_skarn_row"]
    lost = few(several.where("not stays").select(*key).distinct(), "lost")
    twice = several.where("stays").groupBy(*key).count().where("count > 1").select(*key)
    id_ = F.col(id_col).cast("long")
    found = docs.withColumn("_skarn_id", F.coalesce(id_, F.lit(-1))).withColumn("_skarn_row", F.xxhash64(id_, F.col(text_col).cast("string")))
    left = found.join(lost, key, "left_anti")
    if not twice.limit(1).count():
        return left.select(*docs.columns)
    one = left.join(twice, key, "left_semi").withColumn("_skarn_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).where("_skarn_n = 1")
    return left.join(twice, key, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)
