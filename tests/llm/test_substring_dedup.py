"""op5 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from skarn.llm import substring_dedup as s


def brute(rows):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, r in raws:
        for j in range(len(r) - 199):
            seen[r[j : j + 200]] += 1
    out = []
    for i, r in raws:
        cover = bytearray(len(r))
        for j in range(len(r) - 199):
            if seen[r[j : j + 200]] > 1:
                cover[j : j + 200] = b"\1" * 200
        keep = bytes(c for c, m in zip(r, cover, strict=True) if not m)
        runs = sum(1 for j in range(len(r)) if cover[j] and (j == 0 or not cover[j - 1]))
        out.append((i, len(r), sum(cover), runs, hashlib.sha256(keep).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(8)
    say = lambda n: "".join(rnd.choice("abcdefgh äö\n") for _ in range(n))
    passages = [say(rnd.choice([150, 199, 200, 230, 400, 900])) for _ in range(8)]
    rows = []
    for i in range(90):
        parts = [say(rnd.randint(0, 300))]
        for _ in range(rnd.choice([0, 1, 2])):
            p = rnd.choice(passages)
            cut = rnd.randint(0, 60)
            parts += [p[cut:] if rnd.random() < 0.5 else p, say(rnd.randint(0, 120))]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, passages[5][:300] + say(3)) for i in range(40)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (202, None), (203, ""), (204, "x" * 5000), (205, "ab" * 130), (206, "y" * 201), (207, "z" * 200), (208, "é" * 99 + say(30)), (None, passages[4] + "!"), (209, "q" + "ab" * 101)]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(b, a, 1, 2) for a, b in rows], "text string, doc_id long, key int, first int").repartition(6)
    assert sorted((tuple(r)[:5] for r in s.repeated_passages(df).collect()), key=str) == brute(rows)
    assert s.repeated_passages(df.limit(0)).collect() == []


def test_one_passage_over_many_buckets(spark):
    rnd = random.Random(3)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    p = say(260)
    rows = [(i, say(100) + p[rnd.randint(0, 30) :] + say(100)) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
        assert sorted((tuple(r)[:5] for r in s.repeated_passages(df).collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_partners_of_both_sides_differ(spark):
    """A text shares most to the right with one text, most to the left with another, and whole windows with a third."""
    rnd = random.Random(12)
    say = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    rows = []
    for _ in range(12):
        t = say(420)
        rows += [t, say(50) + t[:215] + say(90), say(70) + t[200:], say(40) + t[70:330] + say(60), say(9) + t[30:240] + say(30), say(5) + t[110:320] + say(20)]
    for n in ("4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
        assert sorted((tuple(r)[:5] for r in s.repeated_passages(df).collect()), key=str) == brute(list(enumerate(rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_multikey_sorts():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = s.multikey(tokens)
    assert sorted(order.tolist()) == list(range(500))
    rows = [tuple(tokens[i]) for i in order]
    assert rows == sorted(rows)


def test_windows_own_the_same_anchors_in_pieces(monkeypatch):
    raws = [(t or "").encode() for _, t in corpus()]
    data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])

    def owned():
        row, anchor, first, count, gram, _ = s.anchors(data, offsets)
        return sorted((int(r), int(f) + j, int(a), int(g)) for r, a, f, n, g in zip(row, anchor, first, count, gram, strict=True) for j in range(n))

    whole = owned()
    monkeypatch.setattr(s, "PIECE", 700)
    assert owned() == whole


def test_passage_behind_16_mib(spark):
    rng = np.random.default_rng(6)
    say = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    passage, head = say(900), say((1 << 24) + 5000)
    df = spark.createDataFrame([(1, head + passage + say(700)), (2, passage), (3, say(900))], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in s.repeated_passages(df).collect()}
    assert got == {1: [(len(head), len(head) + 900)], 2: [(0, 900)], 3: []}
