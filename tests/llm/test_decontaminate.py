"""op2 against brute force; the index against plain search."""

import hashlib
import random
import re

import numpy as np

from skarn.llm import decontaminate as d

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    wins = [(i, tuple(w[j : j + min(10, len(w))])) for i, t in items for w in [words(t)] if w and i is not None for j in range(len(w) - min(10, len(w)) + 1)]
    out = []
    for doc, text in rows:
        w = words(text)
        hit, found = set(), set()
        for i, win in wins:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit.update(range(j, j + len(win)))
                    found.add(i)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["ähm", "ÜBER"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice([3, 9, 10, 15, 40]))) for i in range(25)] + [(100, None), (101, ""), (102, "..."), (2, "zz yy"), (None, say(4)), (7, "w1 w1 w1 w1")]
    rows = []
    for i in range(90):
        text = say(rnd.randint(0, 80))
        if i % 2:
            text += "--" + (rnd.choice(items)[1] or "").upper().replace(" ", ", ") + "\n" + say(5)
        rows.append((i, text))
    rows += [(900, None), (901, ""), (901, ""), (902, "w1 " * 500), (903, "?!")]
    return rows, items


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_WORDS", 150)
    rows, items = corpus()
    docs = spark.createDataFrame([(b, a, 1, "q") for a, b in rows], "text string, doc_id long, item_id int, spans string")
    bench = spark.createDataFrame([(a, b) for a, b in items], "item_id long, text string")
    got = d.contamination(docs, bench)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == brute(rows, items)
    assert d.contamination(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in d.contamination(docs, bench.limit(0)).collect())


def test_removal_leaves_no_window(spark):
    rows, items = corpus()
    docs = spark.createDataFrame([(a, b, len(b or ""), "keep") for a, b in rows], "doc_id long, text string, n_chars long, note string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = d.without_hits(docs, bench)
    assert out.columns == docs.columns and out.count() == len(rows)
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert not any(r[2] for r in brute(left, items))
    clean = {r[0] for r in brute(rows, items) if not r[2]}
    before = dict(rows)
    assert all(t == before[i] for i, t in left if i in clean)
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())


def test_index_counts_and_locates():
    rng = np.random.default_rng(4)
    for bits, n in ((2, 300), (5, 2000)):
        seq = rng.integers(0, 1 << bits, n)
        seq[100:180] = seq[10:90]
        seq[-1] = 0
        index = d.FMIndex(seq, bits)
        for size in (1, 2, 5, 30):
            for at in rng.integers(0, n - size, 20):
                pat = seq[at : at + size]
                if (pat == 0).any():
                    continue
                sp, ep = index.search(pat[None, :])
                want = [i for i in range(n - size + 1) if (seq[i : i + size] == pat).all()]
                assert sorted(index.locate(np.arange(sp[0], ep[0]))) == want


def test_suffix_order_of_short_sequences():
    rng = np.random.default_rng(6)
    for bits in range(1, 21):
        for n in (*range(1, 12), 31, 62, 70):
            seq = rng.integers(0, min(1 << bits, 3), n)
            seq[-1] = 0
            ends = [next(j for j in range(i, n) if seq[j] == 0) for i in range(n)]
            want = sorted(range(n), key=lambda i: (seq[i : ends[i]].tolist() + [0], i))
            assert d.suffix_array(seq, bits).tolist() == want, (bits, n)


def test_short_items_and_names(spark):
    """One-word items on one-word shards, and item ids that are no numbers."""
    docs = spark.createDataFrame([(1, "hello world foo"), (2, "world"), (3, "other")], "doc_id long, text string")
    long = " ".join(f"t{i}" for i in range(1000))
    for items in ([("a", "world")], [("b", "World!"), ("x-1", long)]):
        bench = spark.createDataFrame(items, "item_id string, text string")
        assert sorted(tuple(r)[:6] for r in d.contamination(docs, bench).collect()) == brute([(1, "hello world foo"), (2, "world"), (3, "other")], items)
        assert {r.doc_id: r.text for r in d.without_hits(docs, bench).collect()} == {1: "hello   foo", 2: " ", 3: "other"}


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(d.words, "hashes", lambda low, first, end, key: np.ones(len(first), np.uint64))
    item = d.Block(["i"], ["same same"])
    raw = b"same other same same"
    hits = d.Hits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    hits.add(item)
    assert hits.mask.tolist() == [False, False, True, True]
