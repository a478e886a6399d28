"""op4's base spans against Python's re; bootstrapping on a planted pattern."""

import hashlib
import random
import re

from skarn.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum((x * 2 - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(rows):
    out = []
    for i, t in rows:
        found = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if good(k, m[0])]
        counts = [sum(x.startswith(k) for x in found) for k in PATTERNS]
        out.append((i, *counts, hashlib.sha256(",".join(found).encode()).hexdigest(), ",".join(found)))
    return sorted(out, key=str)


def texts():
    rnd = random.Random(4)
    bits = ["a.b@c.de", "x@y", "@", "a@b.c.d-e..f", "q_@r-.s", "é", "𝔘", " ", "\n", "1.2.3.4", "256.1.1.1", "0001.02.255.0", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "4465758382889437", "+1 (743) 555-3824", "+49 30 123", "+1" + "2" * 20, "+", "12 34", "-", ".", "%", "\x01", "\x02", "\x03", "5" * 13, "0" * 14, "word", "a@b.c@d.e", "a@b.c_d@e.f"]
    made = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    return [(i, t) for i, t in enumerate(made)] + [(900, None), (901, ""), (902, "a." * 30_000 + "@" + "b." * 30_000), (903, "1 " * 40_000), (904, "7" * 60_000), (905, "+1" + " " * 40_000), (1, "a@b.c"), (1, "a@b.c"), (None, "1.2.3.4")]


def test_base_spans(spark):
    rows = texts()
    df = spark.createDataFrame([(b, a, 1, "z") for a, b in rows], "text string, doc_id long, key int, spans string")
    got, want = sorted((tuple(r)[:7] for r in pii.personal_data(df).collect()), key=str), brute(rows)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert all(set(w[6].split(",")) - {""} <= set(g[6].split(",")) for g, w in zip(got, want, strict=True))  # the method adds spans
    assert pii.personal_data(df.limit(0)).collect() == []


def test_bootstrapping_finds_what_the_patterns_mark(spark):
    rows = [(i, f"some words here Reach me +1 (212) 555-{1000 + i} thanks") for i in range(40)]
    rows += [(100, "other words here reach me 212-555-7788 thanks"), (101, "in the year of 19999 nothing")]
    rows += [(200 + i, f"in the year of {10000 + i} nothing") for i in range(20)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[40][1]
    at = text.index("212-555")
    assert got[100].spans == f"phone:{at}:{at + 12}" and got[100].n_phone == 0
    assert all(not got[i].spans for i in (101, *range(200, 220)))
    assert all(got[i].n_phone == 1 and "," not in got[i].spans for i in range(40))


def test_candidates_are_runs_with_the_words_before(spark):
    rows = [(i, f"some words here Reach me +1 (212) 555-{1000 + i} thanks") for i in range(40)]
    said = {100: "(212) 555-7788", 101: "212 555 7788", 102: "9" * 80, 103: "212 - 555 - 7799"}
    rows += [(i, f"other words here reach me {x} thanks") for i, x in said.items()]
    # digits stand among the words before, as they do before the seeds
    rows += [(200 + i, f"line a1 +1 (313) 555-{1000 + i} ok") for i in range(40)] + [(300, "line a1 313-555-7788 ok")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in said.items():
        at = dict(rows)[i].index(x)
        assert got[i].spans == f"phone:{at}:{at + len(x)}", x
    assert got[300].spans == "phone:8:20"


def test_trusted_instances_seed_patterns(spark):
    edges = [("reach me", f"base{i}", "phone") for i in range(95)]
    edges += [(left, f"new{i}", None) for left in ("reach me", "or dial") for i in range(5)]
    got = pii.bootstrap(spark.createDataFrame(edges, "left string, s string, kind string"))
    assert {tuple(r) for r in got.collect()} == {("reach me", "phone"), ("or dial", "phone")}
