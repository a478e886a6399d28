"""op11 against brute force; keys that collide."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skarn.llm import spelling

SCHEMA = "word string, text string, n int, doc_id long, root string"


def frame(spark, rows):
    return spark.createDataFrame([("w", b, 1, a, "r") for a, b in rows], SCHEMA)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, chars=7, typos=31):
    counts = Counter()
    for a, b in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", b or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if a is None else a}:{run}".encode())
            if typos and h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= chars:
                counts[run] += 1
    return counts


def brute(counts, least=2, factor=10):
    counts = {w: n for w, n in counts.items() if n >= least}
    by_size = {}
    for w in counts:
        by_size.setdefault(len(w), []).append(w)
    form, size = {}, {}
    for w, n in counts.items():
        others = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if near(w, v)]
        size[w] = len(others)
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, size[w], counts.get(form[w])))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    letters = "abcdeéÿ×÷"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.choice([6, 7, 8, 9, 14]))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaabaaa", "Straße", "ÀÉÎÕÜàé"]
    pool = []
    for w in base:
        pool += [w] * rnd.choice([1, 5, 60, 700])
        for _ in range(12):
            at = rnd.randrange(len(w))
            pool += [rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1 :]])] * rnd.choice([1, 1, 2, 3, 20])
    rnd.shuffle(pool)
    made = [(i, rnd.choice([" ", "-", "1", "ā", "\n"]).join(x.upper() if rnd.random() < 0.2 else x for x in pool[20 * i : 20 * i + 20])) for i in range(len(pool) // 20)]
    # a chain of forms, each ten times as frequent
    for k, (w, n) in enumerate([("chainaaaa", 2), ("chainaaab", 20), ("chainaabb", 200), ("chainabbb", 2000)]):
        made += [(5000 + k, " ".join([w] * n))]
    long = "".join(rnd.choice("abc") for _ in range(3000))
    made += [(6000, f"{long} {long} {long[:1500] + long[1501:]}"), (6001, long[:1500] + long[1501:]), (6002, f"{long[:7]}d{long[8:]} " * 2)]
    return made + [(7000, None), (7001, ""), (7002, "x"), (None, "missing identifier missing"), (3, made[3][1]), (3, made[3][1]), (7003, "same thing again " * 2000)]


def test_matches_brute_force(spark, rows):
    for typos in (31, 2, None):
        counts = counted(rows, typos=typos)
        got = Counter(map(tuple, spelling.spelling_variants(frame(spark, rows).repartition(5), typos=typos).collect()))
        want = brute(counts)
        assert got == want
        assert any(r[1] is not None and r[2] != r[1] for r in want) and any(r[4] > 3 for r in want)


def test_other_settings(spark, rows):
    got = spelling.spelling_variants(frame(spark, rows), min_chars=3, min_count=1, factor=2).collect()
    assert Counter(map(tuple, got)) == brute(counted(rows, 3, None), 1, 2)


def test_keys_that_collide(spark, rows, monkeypatch):
    """With tiny primes many words share keys; strings tell them apart."""
    monkeypatch.setattr(spelling, "COUNTED", 10)
    monkeypatch.setattr(spelling, "LETTERS", 50)
    whole = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda *x: tuple(v % np.uint64(3) if k < 2 else v for k, v in enumerate(whole(*x))))
    few = rows[:40] + rows[-8:]
    got = []
    counts = [(w, n) for w, n in counted(few).items() if n >= 2]
    batch = spelling.pa.RecordBatch.from_arrays([spelling.pa.array(range(len(counts))), spelling.pa.array([w for w, _ in counts])], ["id", "word"])
    keys = spelling.pa.Table.from_batches(list(spelling._keys((777_777, 888_888))([batch]))).sort_by([("key", "ascending"), ("kind", "ascending")])
    kept = spelling.pa.Table.from_batches(list(spelling._shared(iter(keys.to_batches(max_chunksize=7)))))
    at = [kept.column(i).to_pylist() for i in (0, 1, 3, 2)]
    table = spelling.pa.table({"key": at[0], "kind": at[1], "at": at[2], "id": at[3], "word": [counts[i][0] for i in at[3]], "n": [counts[i][1] for i in at[3]]})
    near_ = Counter()
    for b in spelling._neighbours(iter(table.to_batches(max_chunksize=11))):
        got += b.to_pylist()
    for r in got:
        near_[counts[r["id"]][0]] += r["near"]
    assert near_ == Counter({r[0]: r[4] for r in brute(dict(counts)) if r[4]})


def test_keys_are_hashes_of_the_shortened_words():
    rnd = random.Random(5)
    made = ["".join(rnd.choice("abÿ") for _ in range(rnd.randint(1, 40))) for _ in range(200)]
    hashed = lambda xs: spelling.deletion_keys(np.frombuffer("".join(xs).encode("utf-32-le"), "<u4"), np.array([len(x) for x in xs]), (123_456_789, 987_654_321))
    _, without, place = hashed(made)
    short = [w[:i] + w[i + 1 :] for w in made for i in range(len(w))]
    assert without.tolist() == hashed(short)[0].tolist() and place.tolist() == [i for w in made for i in range(len(w))]
    assert len(set(without.tolist())) == len(set(short))


def test_nothing(spark):
    assert spelling.spelling_variants(frame(spark, [])).collect() == []
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, "a b c")])).collect() == []
