"""op12 against plain Python, on odd rows, and its plan."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from skarn.llm import line_dedup

SCHEMA = "line string, text string, h string, doc_id long, key int, docs int"


def frame(spark, rows):
    return spark.createDataFrame([("l", b, "h", a, 1, 2) for a, b in rows], SCHEMA)


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, chars=40, docs=5):
    held = defaultdict(set)
    for a, b in rows:
        for line in (b or "").split("\n"):
            held[key(line)].add(a)
    out = []
    for a, b in rows:
        lines = (b or "").split("\n")
        stay = []
        for line in lines:
            k = key(line)
            gone = len(k) >= chars and len(held[k]) >= docs and a != max((x for x in held[k] if x is not None), default=None)
            if not gone:
                stay.append(line)
        out.append((a, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    wide = [f"Line {i} of ÄÖÜ É and a LICENCE that many documents hold, and more" for i in range(40)]
    edge = ["x" * 39, "y" * 40, "É" * 40, "é" * 40, "İ" * 40, " " * 40, "Z" * 40 + "\r", " \t" + "z" * 40]
    made = []
    for i in range(150):
        lines = [rnd.choice(wide + edge + ["", " ", f"own {i}"]) for _ in range(rnd.choice([1, 3, 20, 200]))]
        made.append((rnd.randrange(10**6) if i % 10 else i, "\n".join(lines)))
    made += [(9, None), (10, ""), (11, "\n"), (12, "\n\n" + wide[0] + "\n"), (None, wide[0] + "\n" + wide[1]), (None, wide[0]), (-5, wide[2]), (-5, wide[3])]
    made += [(2_000_000 + i, "the same LINE is in a third of all rows of this table, at least\nown " + "k" * i) for i in range(90)]
    made += [made[3], made[3], (77, "\n".join(f"{wide[0]}" for _ in range(5000))), (78, "long " * 200_000 + "\n" + wide[5])]
    return made


def test_matches_brute_force_and_sql(spark, rows):
    got = line_dedup.without_shared_lines(frame(spark, rows).repartition(7)).collect()
    want = brute(rows)
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r[2] for r in want) > 1000
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    sql = con.execute(line_dedup.ORACLE_SQL["op12_line_dedup"]).fetchall()
    assert Counter(sql) == Counter((a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in want)


def test_other_thresholds_and_hot_lines(spark, rows, monkeypatch):
    for support in (0.9, 0.01):
        monkeypatch.setattr(line_dedup, "SUPPORT", support)
        got = line_dedup.without_shared_lines(frame(spark, rows), min_chars=1, min_docs=2).collect()
        assert Counter(map(tuple, got)) == Counter(brute(rows, 1, 2))


def test_bitmaps_store_only_words_that_drop(spark):
    shared = "a line of forty code points, and a few of more"
    rows = [(i, "\n".join(["own"] * 200 + [shared] + ["own"] * 100)) for i in range(6)]
    got = {r.doc: r for r in line_dedup.keep_bitmaps(frame(spark, rows)).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert [(w.word, ~w.bits) for w in got[0].keep] == [(3, 1 << 8)] and got[0].n_dropped == 1


def test_nothing(spark):
    assert line_dedup.without_shared_lines(frame(spark, [])).collect() == []


def test_windows_add_no_shuffle_and_no_python(spark, rows):
    read = line_dedup._read(frame(spark, rows), "doc_id", "text")
    plan = line_dedup._dropped(read, 40, 5)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "rangepartitioning(h" in plan and "Python" not in plan and "Arrow" not in plan
    windows = plan[plan.index("Window") : plan.index("rangepartitioning(h")]
    assert "hashpartitioning" not in windows and "CartesianProduct" not in plan and "NestedLoop" not in plan
