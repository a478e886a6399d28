"""op1 against brute force, and the defined results of odd rows."""

import random
import re

import numpy as np

from skarn.llm import near_dedup, words
from skarn.llm.near_dedup import distinct_documents, near_duplicates

SCHEMA = "doc_id long, text string, lang string, n long, id string"


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [shingles(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)], least[find(i)] == r[0]) for i, r in enumerate(rows))


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 40, 120]))]
        rows.append((len(rows) * 3 + 1, " ".join(base)))
        for _ in range(rnd.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows) * 3, "\n".join(copy).upper()))
    rows += [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "é" * 50_000), (9004, "é" * 50_000), (9005, "alone")]
    rnd.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "en", 7, "x") for a, b in rows], SCHEMA).repartition(5)
    for k, num in ((3, 85), (5, 80)):
        got = sorted(tuple(r) for r in near_duplicates(df, shingle=k, num=num).select("doc_id", "n_shingles", "component_id", "kept").collect())
        assert got == brute(rows, k, num, 100)


def test_large_group_without_its_centre_as_representative(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "STREAM", 10)
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        copy = list(base)
        copy[rnd.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(df, shingle=3, num=85).collect())
    assert got == brute(rows, 3, 85, 100)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).collect() == []
    assert distinct_documents(none).collect() == []


def test_rows_without_an_id_link_like_others(spark):
    words_ = [f"t{i}" for i in range(80)]
    rows = [(3, " ".join(words_)), (None, " ".join(words_[:-1])), (None, "lonely row without any id here"), (None, None), (7, "another")]
    got = {r["n_shingles"]: (r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {76: (3, 3, True), 75: (None, 3, False), 2: (None, None, True), 0: (None, None, True), 1: (7, 7, True)}


def test_one_row_of_a_component_stays(spark):
    base = [f"t{i}" for i in range(80)]
    near, other = " ".join(base[:-1]), " ".join(f"o{i}" for i in range(30))
    # id 5 has a near copy and a text of its own; id 1 occurs twice as it is
    rows = [(1, " ".join(base), "p"), (1, " ".join(base), "p"), (5, near, "q"), (5, other, "r"), (None, near, "s"), (8, None, "t"), (9, "", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = distinct_documents(docs)
    assert got.columns == docs.columns
    assert sorted(r["row"] for r in got.collect()) == ["p", "r", "t", "u"]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = both[:2400], both[600:]
    ra, rb, ru = (near_dedup.registers(x, np.array([0]))[0] for x in (a, b, both))
    assert (np.maximum(ra, rb) == ru).all()
    est, lost = near_dedup.estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([2400.0]), np.array([2400.0]), 0.6)
    assert abs(est[0] - 0.6) < 0.15 and lost[0] < 26


def test_words_of_bytes():
    texts = ["Ab  c\td", "", "x", "Straße über"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h, first, end, starts = words.split(data, at, words.SPACE)
    got = [[bytes(data[first[i] : end[i]]).decode() for i in range(starts[r], starts[r + 1])] for r in range(4)]
    assert got == [["Ab", "c", "d"], [], ["x"], ["Straße", "über"]]


def test_words_that_a_polynomial_confuses(spark):
    """Thue-Morse words collide under every polynomial modulo 2**64."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = near_duplicates(spark.createDataFrame([(1, word), (2, other), (3, word.upper())], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}
    made = [other[:n] + x for n in (0, 1, 7, 8, 9, 16, 17, 300, 505) for x in ("a", "b", "aa", "ab", "ba", "\u00e9")]
    raw = " ".join(made).encode()
    one, two = (words.split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), words.SPACE, key)[0] for key in (1, 2))
    assert len(set(one.tolist())) == len(set(made)) and not set(one.tolist()) & set(two.tolist())
