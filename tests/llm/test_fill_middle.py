"""op13 against plain Python and SQL, and the round trip."""

import hashlib
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from skarn.llm import fill_middle as f

SCHEMA = "n int, text string, form string, doc_id long, output string"


def frame(spark, rows):
    return spark.createDataFrame([(1, b, "f", a, "o") for a, b in rows], SCHEMA)


def brute(a, b, seed=7, rate=100, spm=50, pattern=r"[^\n]*\n|[^\n]+"):
    text = b or ""
    units = re.findall(pattern, text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if a is None else a}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (a, n, "plain", None, None, text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h4 % 100 < spm else "psm"
    return (a, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def rows():
    rnd = random.Random(13)
    bits = ["a line\n", "\n", "é ü\r\n", "😀 no end", "<", "<P", "<S\n", "M>", "tail ", "\x00\x85\n", "日本語\n"]
    made = [(i, "".join(rnd.choice(bits) for _ in range(rnd.choice([1, 2, 5, 60])))) for i in range(250)]
    made += [(300, None), (301, ""), (302, "\n"), (303, "one <P> mark\n"), (304, "<M>"), (305, "x<S>"), (None, "no id\nhere\n"), (None, None), (5, "again\n"), (5, "again\n"), (-3, "a\nb\nc")]
    return made + [(400, "long line " * 400_000), (401, "short\n" * 300_000)]


def test_matches_brute_force_sql_and_round_trip(spark):
    data = rows()
    df = frame(spark, data).repartition(3)
    out = f.fill_in_middle(df).withColumn("restored", f.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in out) == Counter(brute(*x) for x in data)
    assert Counter((r.doc_id, r.restored) for r in out) == Counter((a, b or "") for a, b in data)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", data)
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    want = Counter((*brute(*x)[:5], sha(brute(*x)[5]), sha(x[1])) for x in data)
    assert Counter(con.execute(f.ORACLE_SQL["op13_fill_middle"]).fetchall()) == want


def test_shares_and_other_units(spark):
    data = [(a, b) for a, b in rows() if len(b or "") < 1000]
    got = f.fill_in_middle(frame(spark, data), seed=11, rate=40, spm=90, pattern=r"[\s\S]").collect()
    assert Counter(map(tuple, got)) == Counter(brute(*x, 11, 40, 90, r"[\s\S]") for x in data)


def test_nothing(spark):
    assert f.fill_in_middle(frame(spark, [])).collect() == []
