"""Increase of scraped counters over a sliding range: resets, extrapolation to the range's ends, held conditions.

Samples are (series columns, at, value); a counter that falls has restarted from zero.
An instant's range is (at - range, at]. With two samples or more in it, their growth,
resets added, is stretched to the ends of the range: as far as a sample was due there
(1.1 average gaps), else by half a gap, and never to before the counter was zero.
Instants with fewer samples have no row. Null values and null times are no samples;
samples of one series at one time count once, with the greatest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .health import MIN_TOTAL, RATIO, WINDOW_SECONDS

STEP_SECONDS = 1800


def increases(samples: DataFrame, keys: list[str], step: int = STEP_SECONDS, window: int = WINDOW_SECONDS) -> DataFrame:
    """(keys, at, increase) at every multiple of step seconds.

    A series is cut into stretches of time as long as the range; samples go to their own
    stretch and the next, so a range lies within one stretch and no task has to hold a
    whole series. Samples and instants are sorted together; no sample meets each of its ranges.
    """
    micros, every = 1_000_000, step * 1_000_000
    span = -(-window // step) * every  # whole steps
    t = F.unix_micros(F.col("at").cast("timestamp"))
    clean = samples.where(F.col("value").isNotNull() & F.col("at").isNotNull()).select(*keys, t.alias("t"), F.col("value").cast("double").alias("value"))
    own = F.floor(F.col("t") / F.lit(span))
    cut = clean.select(*keys, "t", "value", F.explode(F.array(own, own + 1)).alias("stretch"))
    cut = cut.groupBy(*keys, "stretch", "t").agg(F.max("value").alias("value"))
    start = F.col("stretch") * F.lit(span)
    asked = cut.select(*keys, "stretch").distinct().select(*keys, "stretch", F.explode(F.sequence(start, start + F.lit(span - every), F.lit(every))).alias("t"))
    rows = cut.withColumn("asked", F.lit(False)).unionByName(asked.select(*keys, "stretch", "t", F.lit(None).cast("double").alias("value"), F.lit(True).alias("asked")))
    rows = rows.withColumn("s", F.when(~F.col("asked"), F.struct("t", "value")))
    # samples of an instant's own time come first; grown never falls
    line = Window.partitionBy(*keys, "stretch").orderBy("t", "asked")
    so_far = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("fell", F.when(F.col("value") < F.last("value", ignorenulls=True).over(so_far), F.last("value", ignorenulls=True).over(so_far)).otherwise(0.0))
    rows = rows.withColumn("grown", F.col("value") + F.sum("fell").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("s", F.when(~F.col("asked"), F.struct("t", "value", "grown")))
    within = Window.partitionBy(*keys, "stretch").orderBy("t").rangeBetween(-window * micros + 1, 0)
    rows = rows.withColumn("a", F.first("s", ignorenulls=True).over(within)).withColumn("b", F.last("s", ignorenulls=True).over(within)).withColumn("n", F.count("s").over(within))
    rows = rows.where("asked and n >= 2")
    return rows.select(*keys, F.timestamp_micros("t").alias("at"), _stretched(window * micros).alias("increase"))


def _stretched(window: int) -> Column:
    """The growth from a to b, stretched to a range that ends with t."""
    grown = F.col("b.grown") - F.col("a.grown")
    seen = (F.col("b.t") - F.col("a.t")).cast("double")
    gap = seen / (F.col("n") - 1)
    before = (F.col("a.t") - (F.col("t") - F.lit(window))).cast("double")
    after = (F.col("t") - F.col("b.t")).cast("double")
    before = F.when(before >= gap * 1.1, gap / 2).otherwise(before)
    after = F.when(after >= gap * 1.1, gap / 2).otherwise(after)
    since_zero = F.when((grown > 0) & (F.col("a.value") >= 0), seen * (F.col("a.value") / F.nullif(grown, F.lit(0.0))))
    return grown * ((seen + F.least(before, F.coalesce(since_zero, before)) + after) / seen)


# Fixed values of the rules: the counters that make up a total.
INDEXED, PAGES = ("fetched", "skipped", "not_modified"), ("fetched", "skipped", "not_modified", "soft_failed")


def _wide(inc: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(source, at, a column for each counter) of increases (source, name, at, increase); null where a counter has none."""
    used = inc.where(F.col("name").isin(list(names)))
    return used.groupBy("source", "at").agg(*[F.max(F.when(F.col("name") == c, F.col("increase"))).alias(c) for c in names])


def _total(names: tuple[str, ...]) -> Column:
    """Null where one of the counters is."""
    out = F.col(names[0])
    for c in names[1:]:
        out = out + F.col(c)
    return out


def indexed_nothing(inc: DataFrame) -> DataFrame:
    """(source, at) where runs ended in the range and no page was indexed; all counters must be there."""
    return _wide(inc, ("runs", *INDEXED)).where((F.col("runs") > 0) & (_total(INDEXED) == 0)).select("source", "at")


def ratio_high(inc: DataFrame, column: str) -> DataFrame:
    """(source, at, ratio) where a counter makes up more than RATIO of more than MIN_TOTAL pages."""
    wide = _wide(inc, tuple(dict.fromkeys([*PAGES, column])))
    r = F.col(column) / F.greatest(_total(PAGES), F.lit(1.0))
    return wide.where((r > RATIO) & (_total(PAGES) > MIN_TOTAL)).select("source", "at", r.alias("ratio"))


def firing(on: DataFrame, hold: int, step: int = STEP_SECONDS) -> DataFrame:
    """(source, at, since): instants at which a condition (source, at) has been true without a break for `hold` seconds."""
    t = F.unix_micros(F.col("at").cast("timestamp"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("at"))
    runs = on.select("source", "at").distinct().withColumn("g", t - nth.cast("long") * F.lit(step * 1_000_000))
    since = F.min("at").over(Window.partitionBy("source", "g"))
    out = runs.select("source", "at", since.alias("since"))
    return out.where(t - F.unix_micros(F.col("since").cast("timestamp")) >= hold * 1_000_000)
