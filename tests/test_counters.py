"""Counter increase: the recorded cases of the rules, resets, ends of ranges, brute force."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from skarn.operators import counters

ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)
SERIES = "source string, name string, at timestamp, value double"
HOUR = 3600


def scraped(spark, **series):
    """Samples half an hour apart."""
    return spark.createDataFrame([("s", n, ZERO + timedelta(minutes=30 * i), float(v)) for n, vs in series.items() for i, v in enumerate(vs) if v is not None], SERIES)


def at(hours):
    return ZERO + timedelta(hours=hours)


def times(df):
    return {r.at.replace(tzinfo=timezone.utc) if r.at.tzinfo is None else r.at for r in df.collect()}


LATE = [0] * 10 + [1] * 51


@pytest.mark.parametrize(("rule", "values", "fires"), [
    ("nothing", {"runs": LATE, "fetched": [0] * 61, "skipped": [0] * 61, "not_modified": [0] * 61}, True),
    ("nothing", {"runs": LATE, "fetched": LATE, "skipped": [0] * 61, "not_modified": [0] * 61}, False),
    ("nothing", {"runs": LATE, "fetched": [0] * 61, "skipped": [0] * 61}, False),  # a counter is not there
    ("soft_failed", {"fetched": [163 * x for x in LATE], "skipped": [0] * 61, "not_modified": [0] * 61, "soft_failed": [117 * x for x in LATE]}, True),
    ("shell_suspected", {"fetched": [163 * x for x in LATE], "skipped": [0] * 61, "not_modified": [0] * 61, "soft_failed": [117 * x for x in LATE], "shell_suspected": [117 * x for x in LATE]}, True),
    ("shell_suspected", {"fetched": [280 * x for x in LATE], "skipped": [0] * 61, "not_modified": [0] * 61, "soft_failed": [0] * 61, "shell_suspected": [0] * 61}, False),
])
def test_recorded_cases(spark, rule, values, fires):
    inc = counters.increases(scraped(spark, **values), ["source", "name"])
    on = counters.indexed_nothing(inc) if rule == "nothing" else counters.ratio_high(inc, rule)
    assert (at(29.5) in times(counters.firing(on, 900))) == fires
    assert at(4) not in times(counters.firing(on, 0))  # before anything has happened


def plain(points, t, window):
    """One instant, written out."""
    inside = [(a, v) for a, v in sorted(points) if t - window < a <= t]
    if len(inside) < 2:
        return None
    grown = sum(v - u if v >= u else v for (_, u), (_, v) in zip(inside, inside[1:]))
    seen = inside[-1][0] - inside[0][0]
    gap = seen / (len(inside) - 1)
    ends = [x if x < 1.1 * gap else gap / 2 for x in (inside[0][0] - (t - window), t - inside[-1][0])]
    if grown > 0:
        ends[0] = min(ends[0], seen * inside[0][1] / grown)
    return grown * (seen + sum(ends)) / seen


def test_against_brute_force(spark):
    rnd, points = random.Random(5), {}
    for k in range(4):
        t, v, own = rnd.randrange(10_000), 0.0, []
        for _ in range(150):
            t += rnd.choice([600, 1800, 1800, 1800, 40_000, 3])
            v = 0.0 if rnd.random() < 0.1 else v + rnd.choice([0, 0, 1, 7])
            own.append((t, v))
        points[f"k{k}"] = own
    points["once"] = [(100, 5.0)]
    rows = [("s", k, ZERO + timedelta(seconds=t), v) for k, own in points.items() for t, v in own]
    rows += rows[:20] + [("s", "k0", None, 3.0), ("s", "k0", at(1), None)]
    got = {(r.name, int((r.at.replace(tzinfo=timezone.utc) - ZERO).total_seconds())): r.increase for r in counters.increases(spark.createDataFrame(rows, SERIES), ["source", "name"], 3600, 5 * HOUR).collect()}
    want = {(k, t): plain(own, t, 5 * HOUR) for k, own in points.items() for t in range(0, 60 * 24 * HOUR, 3600)}
    want = {k: v for k, v in want.items() if v is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_holds_break_and_empty_tables(spark):
    on = spark.createDataFrame([("a", at(h)) for h in (0, 0.5, 1, 1, 2, 2.5)] + [("b", at(1))], "source string, at timestamp")
    assert times(counters.firing(on, HOUR)) == {at(1)} and times(counters.firing(on.where("source = 'b'"), 1)) == set()
    none = counters.increases(spark.createDataFrame([], SERIES), ["source", "name"])
    assert none.isEmpty() and counters.firing(counters.indexed_nothing(none), 0).isEmpty() and counters.ratio_high(none, "failed").isEmpty()
