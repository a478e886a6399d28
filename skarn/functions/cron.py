"""Five-field cron: fields as arrays of values, matches, and errors that never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The range of minute, hour, day of month, month, day of week (0 is Sunday).
RANGES = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 6)]


def field(text: Column, low: int, high: int) -> Column:
    """Values of one field: '*', '*/N', integers, comma lists; null when it can't be read."""
    whole = F.sequence(F.lit(low), F.lit(high))

    def part(p: Column) -> Column:
        step = F.regexp_extract(p, r"^\*/([0-9]{1,4})$", 1)
        number = F.when(p.rlike("^[0-9]{1,4}$"), p.cast("int"))
        return (
            F.when(p == "*", whole)
            .when((step != "") & (F.coalesce(F.expr("0") + F.when(step != "", step.cast("int")), F.lit(0)) > 0), F.sequence(F.lit(low), F.lit(high), F.greatest(F.when(step != "", step.cast("int")).otherwise(1), F.lit(1))))
            .when(number.between(low, high), F.array(number))
        )

    parts = F.transform(F.split(text, ","), part)
    return F.when(F.exists(parts, lambda x: x.isNull()), None).otherwise(F.array_sort(F.array_distinct(F.flatten(parts))))


def fields(expr: Column) -> Column:
    """struct of the five arrays, null when the expression is not valid."""
    parts = F.filter(F.split(F.trim(expr), r"\s+"), lambda x: x != "")
    read = [field(F.get(parts, F.lit(i)), lo, hi) for i, (lo, hi) in enumerate(RANGES)]
    ok = F.size(parts) == 5
    for r in read:
        ok = ok & r.isNotNull()
    return F.when(ok, F.struct(*[r.alias(n) for r, n in zip(read, ("minute", "hour", "dom", "month", "dow"), strict=True)]))


def matches(parsed: Column, ts: Column) -> Column:
    """All five fields must hold, day of month and day of week both."""
    now = [F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.dayofweek(ts) - 1]
    found = F.lit(True)
    for name, value in zip(("minute", "hour", "dom", "month", "dow"), now, strict=True):
        found = found & F.array_contains(parsed[name], value)
    return F.coalesce(found, F.lit(False))
