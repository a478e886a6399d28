"""op10: exact round trip, order of the histories, the loser tree."""

import base64
import gzip
import hashlib
import io
import random

from skarn.llm import warc


def want(rows):
    by = {}
    for i, _, h in rows:
        if i is not None:
            by.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        raw, first = (h or "").encode(), i if i is None else min(by[h or ""])
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, f"https://www.h{rnd.randint(0, 5)}.example.com/p{rnd.randint(0, 20)}?q=ü{i % 3}", "é<p>\r\n\r\n" * rnd.randint(0, 6)) for i in range(400)]
    rows += [(500, None, None), (501, "not a url\nat all", ""), (502, "http://[bad", "x" * 300_000), (503, "http://a:8080/b", "x"), (503, "http://a:8080/b", "x"), (None, "http://a/", "x"), (None, None, None)]
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "RANGE_LINES", 60)
    df = spark.createDataFrame([(c, b, a, 1) for a, b, c in rows], "html string, url string, page_id long, archive int").repartition(5)
    got = warc.archive_pages(df).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want(rows)
    keys = [(r.url_key, r.timestamp, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)
    assert warc.archive_pages(df.limit(0)).collect() == []


def test_one_page_id_with_two_payloads(spark):
    for rows in ([(1, "u", "A"), (5, "u", "A"), (5, "u", "unique")], [(1, "u", "A"), (2, "u", "B"), (5, "u", "A"), (5, "u", "B")]):
        got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == want(rows)


def test_records_are_gzip_members():
    raw = [warc.record(1, "http://a/", b"one\r\n\r\ntwo", None), warc.record(2, "http://a/", b"one\r\n\r\ntwo", 1)]
    assert gzip.decompress(b"".join(raw)).startswith(b"WARC/1.1\r\nWARC-Type: response")
    found = [warc._capture("x", *r) for r in warc.read_records(io.BytesIO(b"".join(raw)))]
    assert [(f[2], f[3], f[5], f[6], f[8]) for f in found] == [(1, 10, "response", None, 0), (2, 10, "revisit", 1, len(raw[0]))]


def test_loser_tree():
    rnd = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rnd.randint(0, 50) for _ in range(rnd.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
