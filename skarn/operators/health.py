"""Health rules over run counters, and the gauges of a run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the rules.
STALE_SECONDS, WINDOW_SECONDS, RATIO, MIN_TOTAL = 172_800, 30 * 3600, 0.2, 20
SEARCH_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
BUCKETS = (1, 5, 10, 30, 60, 300, 900, 3600)


def increase(runs: DataFrame, columns: list[str], window: int = WINDOW_SECONDS) -> DataFrame:
    """Sums of the counters over the window that ends with each run of a source."""
    at = F.unix_micros(F.col("finished_at").cast("timestamp"))
    w = Window.partitionBy("source").orderBy(at).rangeBetween(-window * 1_000_000, 0)
    return runs.select("source", "finished_at", *[F.sum(c).over(w).alias(c) for c in columns], F.count("*").over(w).alias("runs"))


def indexed_nothing(runs: DataFrame) -> DataFrame:
    inc = increase(runs, ["fetched", "skipped", "not_modified"])
    return inc.where("runs > 0 and fetched + skipped + not_modified = 0").select("source", "finished_at")


def ratio_alert(runs: DataFrame, column: str) -> DataFrame:
    """Runs whose window has more than RATIO of its pages in column, of more than MIN_TOTAL pages."""
    inc = increase(runs, list(dict.fromkeys(["fetched", "skipped", "not_modified", "soft_failed", column])))
    total = F.col("fetched") + F.col("skipped") + F.col("not_modified") + F.col("soft_failed")
    r = F.col(column) / F.greatest(total, F.lit(1))
    return inc.select("source", "finished_at", total.alias("total"), F.round(r, 9).alias("ratio")).where((F.col("ratio") > RATIO) & (F.col("total") > MIN_TOTAL))


def stale(runs: DataFrame, now: Column) -> DataFrame:
    """Sources whose latest ok or partial run is older than two days; those without one are absent."""
    last = runs.where(F.col("status").isin("ok", "partial")).groupBy("source").agg(F.max("finished_at").alias("last_success"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_success").cast("timestamp"))) / 1_000_000
    return last.where(age > STALE_SECONDS)


def last_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source").agg(F.max_by("status", "finished_at").alias("status"), F.max("finished_at").alias("finished_at"))


def one_hot(runs: DataFrame) -> DataFrame:
    """(source, status, value): one for the current status of each source."""
    return last_status(runs).select("source", F.explode(F.array(*[F.struct(F.lit(s).alias("status"), (F.col("status") == s).cast("long").alias("value")) for s in ("ok", "partial", "failed")])).alias("x")).select("source", "x.status", "x.value")


def histogram(values: DataFrame, column: str, bounds: tuple = BUCKETS) -> DataFrame:
    """Cumulative counts (le, n) of a duration column."""
    counts = values.agg(*[F.count_if(F.col(column) <= b).alias(str(b)) for b in bounds], F.count(column).alias("inf"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"`{b}`").alias("n")) for b in bounds] + [F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("n"))]
    return counts.select(F.inline(F.array(*rows)))


def held(samples: DataFrame, hold_seconds: int) -> DataFrame:
    """(source, since, until) of stretches of true samples (source, at, on) that last hold_seconds or more."""
    w = Window.partitionBy("source").orderBy("at")
    g = samples.withColumn("g", F.sum((~F.col("on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("on")
    out = g.groupBy("source", "g").agg(F.min("at").alias("since"), F.max("at").alias("until"))
    return out.where((F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 1_000_000 >= hold_seconds).select("source", "since", "until")


def no_metrics(runs: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row: whether no run at all finished between start and end."""
    return runs.agg((F.count_if(F.col("finished_at").between(start, end)) == 0).alias("absent"))


def counters(runs: DataFrame, columns: list[str]) -> DataFrame:
    """(source, name, value): each counter summed over all runs of a source."""
    sums = runs.groupBy("source").agg(*[F.sum(c).cast("long").alias(c) for c in columns])
    return sums.select("source", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(c, F.lit(0)).alias("value")) for c in columns])))


def last_success(runs: DataFrame) -> DataFrame:
    """(source, last_success): the end of the latest ok or partial run, in seconds."""
    good = runs.where(F.col("status").isin("ok", "partial"))
    return good.groupBy("source").agg((F.unix_micros(F.max("finished_at").cast("timestamp")) / 1_000_000).alias("last_success"))


def search_metrics(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status, n) of searches, and the histogram of their seconds."""
    return log.groupBy("status").agg(F.count("*").alias("n")), histogram(log, "seconds", SEARCH_BUCKETS)
