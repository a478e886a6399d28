"""The store: one winner, changes that cost what they change, reads and searches after changes."""

import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skarn import api
from skarn.functions import fts
from skarn.operators import blocks, search
from skarn.sources import store as st
from skarn.sources.store import Conflict, Store, difference

CHUNK = "chunk_id long, page_id long, source_id int, url string, heading_path string, chunk_index int, content string, embedding array<float>, fts_config string"


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_two_writers_have_one_winner(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.commit({"a": spark.range(1)})
    met, said = threading.Barrier(2), []

    def write(name):
        mine = Store(spark, s.root)
        put = mine._put

        def late(version, entry):
            met.wait(60)  # both have written their segments and found no newer version
            return put(version, entry)

        mine._put = late
        try:
            said.append((name, mine.commit({name: spark.range(3)}, based_on=1)))
        except Conflict:
            said.append((name, None))

    threads = [threading.Thread(target=write, args=(n,)) for n in ("b", "c")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [n for n, v in said if v == 2]
    assert len(won) == 1 and len(said) == 2 and s.tables() == ["a", won[0]] and s.read(won[0]).count() == 3
    with pytest.raises(Conflict):
        s._put(2, {})
    other = Store(spark, s.root)  # the way of other file systems
    other._renamed(f"{s.root}/_log/.x", f"{s.root}/_log/7.json", "{}", 7)
    with pytest.raises(Conflict):
        other._renamed(f"{s.root}/_log/.y", f"{s.root}/_log/7.json", "{}", 7)
    assert s.version() == 7 and s._entry(7) == {}


def test_changes_equal_copies_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FANOUT", 3)
    s, rnd, want = Store(spark, f"file://{tmp_path}/s"), random.Random(4), {}
    make = lambda ids, v: spark.createDataFrame([(i * 10 + k, i, f"{v} {i} {k}") for i in ids for k in range(i % 3 + 1)], "chunk_id long, page_id long, content string")
    s.commit({"chunks": make(range(40), 0)})
    want = {i: 0 for i in range(40)}
    for v in range(1, 6):
        gone, new = rnd.sample(range(50), 6), rnd.sample(range(50), 4)
        s.commit(added={"chunks": make(new, v)}, deleted={"chunks": spark.createDataFrame([(i,) for i in {*gone, *new}], "id long")})
        want = {i: x for i, x in want.items() if i not in gone} | dict.fromkeys(new, v)
        made = s.compact()
        assert rows_of(s.read("chunks"), "chunk_id", "content") == Counter((i * 10 + k, f"{x} {i} {k}") for i, x in want.items() for k in range(i % 3 + 1)), (v, made)
    assert len(s._entry(None)["chunks"]["segments"]) < 4 and s.compact() is None
    old = s.version() - 1
    assert s.read("chunks", old).count() >= 0 and s.vacuum(keep=1) > 0
    assert s.read("chunks").count() == sum(i % 3 + 1 for i in want)
    # columns that come later, tables without a key, and empty changes
    s.commit(added={"log": spark.createDataFrame([(1,)], "a int")})
    s.commit(added={"log": spark.createDataFrame([("x", 2)], "b string, a long")})
    assert rows_of(s.read("log"), "a", "b") == Counter({(1, None): 1, (2, "x"): 1})
    before = s.read("chunks").count()
    s.commit(added={"chunks": make([], 9)}, deleted={"chunks": spark.createDataFrame([], "id long")})
    assert s.read("chunks").count() == before


def test_difference(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, None), (5, "q")], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None), (5, "q")], "id long, v string")
    added, keys = difference(a, b, "id")
    assert {r.id for r in keys.collect()} == {2, 3, 4} and rows_of(added, "id", "v") == Counter([(2, "y"), (3, "z"), (4, None)])


def chunk_rows(n, seed=5):
    rnd = random.Random(seed)
    words = ["spark", "joins", "running", "maison", "the", "de", "la", "rare", "window"]
    weight = [3, 2, 1, 1, 30, 8, 6, 0.05, 2]
    out = []
    for i in range(n):
        text = " ".join(rnd.choices(words, weight, k=rnd.choice([3, 8, 20, 60])))
        out.append((i * 7 + 3, i // 2, i % 5, f"u{i}", "", i % 2, text, None, rnd.choice(["simple", "french", "english", "klingon", None])))
    return out


@pytest.fixture(scope="module")
def big(spark):
    return spark.createDataFrame(chunk_rows(3000), CHUNK).persist()


def test_blocks_equal_a_scan(spark, big, monkeypatch):
    monkeypatch.setattr(blocks, "FIRST", 4)  # fewer than the results: a second round opens what may still reach them
    made = blocks.build(big, 100).withColumn("_seq", F.lit(1)).persist()
    for text in ("the", "spark joins", '"the spark" -joins or window', "run", "the -the", "spark or zebra joins"):
        found, stats = blocks.top(made, None, text)
        assert found == [tuple(r) for r in search.text_candidates(big, text).collect()], text
        assert stats["opened"] <= stats["blocks"]
    # in French nothing but a negation is left of the first alternative
    assert blocks.top(made, None, '"de la" -spark or window') is None and blocks.top(made, None, "-the or spark") is None and blocks.top(made, None, "???")[0] == []
    # few of a frequent word's blocks are opened, ties and all
    monkeypatch.setattr(blocks, "FIRST", 32)
    fine = blocks.build(big, 600)
    found, stats = blocks.top(fine, None, "the")
    assert found == [tuple(r) for r in search.text_candidates(big, "the").collect()]
    assert stats["blocks"] > 800 and stats["opened"] < stats["blocks"] / 5
    found, _ = blocks.top(made, None, "window de", source_id=3, limit=5)
    assert found == [tuple(r) for r in search.text_candidates(big, "window de", 3, 5).collect()]
    monkeypatch.setattr(blocks, "LISTED", 0)
    assert blocks.top(made, None, "spark or de")[0] == [tuple(r) for r in search.text_candidates(big, "spark or de").collect()]


def test_lookups_open_few_files(spark, big, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        s.commit({"chunks": big})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = [3, 10, 17, 7003]
    files = s.files_with("chunks", ids)
    assert len(files) == 2
    some = s.lookup("chunks", ids)
    assert {r.chunk_id for r in some.collect()} == set(ids) and len(some.inputFiles()) == 2
    sixty = [i * 7 + 3 for i in range(0, 3000, 50)]
    assert len(s.files_with("chunks", sixty)) <= 32 and s.lookup("chunks", sixty).count() == 60
    assert s.lookup("chunks", [4]).count() == 0 and s.lookup("chunks", []).count() == 0
    s.commit(deleted={"chunks": spark.createDataFrame([(0,)], "page_id long")})
    assert {r.chunk_id for r in s.lookup("chunks", ids).collect()} == {17, 7003}


FETCHED = "source_id int, source string, url string, fetch_ok boolean, not_modified boolean, markdown string"


def test_searches_follow_the_data(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/s")
    sources = spark.createDataFrame([(1, "a", "https://a.dev/", "active", "crawl", "english"), (2, "up", "upload://up", "active", "upload", "simple")], "id int, name string, base_url string, status string, source_type string, language string")
    pages = spark.createDataFrame([], "id long, source_id int, url string, content_hash string, fetched_at timestamp, etag string, last_modified string")
    s.commit({"sources": sources, "pages": pages})
    api.upload_text(s, "up", "One", "zebra crossing of the street " * 50)
    filler = "words of a page that is long enough to be kept " * 8
    fetch = lambda *texts: spark.createDataFrame([(1, "a", f"https://a.dev/{i}", True, False, f"{t} {filler}") for i, t in texts], FETCHED)
    api.run_sync(s, fetch(*[(i, f"animal{i} lives here") for i in range(20)]))
    api.index(s, cells=2)
    size = lambda: sum(x["bytes"] for t in s._entry(None).values() for x in t["segments"])
    before, seen = size(), {x["path"] for t in s._entry(None).values() for x in t["segments"]}
    api.upload_text(s, "up", "Two", "quokka on the beach")
    new = sum(x["bytes"] for t in s._entry(None).values() for x in t["segments"] if x["path"] not in seen)
    assert 0 < new < before / 2 and {x["path"] for t in s._entry(None).values() for x in t["segments"]} > seen  # nothing is written again

    def same(*texts):
        for text in texts:
            found, _ = blocks.top(*s.raw("postings"), text)
            assert found == [tuple(r) for r in search.text_candidates(s.read("chunks"), text).collect()], text
        assert rows_of(s.read("cells"), "chunk_id") == rows_of(s.read("chunks"), "chunk_id")

    hit = api.search_chunks(s, "quokka", limit=1).first()
    assert "quokka" in hit.content and hit.source == "up"
    same("quokka")
    # a changed page, a new one, and one text again: the old words find nothing
    api.run_sync(s, fetch(*[(i, f"animal{i} lives here") for i in range(19)], (19, "badger moved in"), (20, "okapi is new")))
    api.upload_text(s, "up", "One", "giraffe " * 40)
    same("badger", "giraffe", "okapi or animal1")
    assert blocks.top(*s.raw("postings"), "zebra")[0] == [] and blocks.top(*s.raw("postings"), "animal19")[0] == []
    api.purge(s, 2)
    assert blocks.top(*s.raw("postings"), "giraffe")[0] == []
    # one version for a whole crawl anew
    version = s.version()
    monkeypatch.setattr(st, "FANOUT", 100)
    api.reindex(s, fetch((0, "heron stands"), (1, "animal1 lives here")))
    assert s.version() == version + 1 and s.read("pages").count() == 2
    same("animal1")
    monkeypatch.setattr(st, "FANOUT", 2)
    s.compact({"postings": blocks.merged})
    same("heron")
    shards = fts.shards_of(spark, ["heron"])
    plan = s.raw("postings")[0].where(F.col("shard").isin(shards) & F.col("lexeme").isin(["heron"])).select("max_tf")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "rows" not in plan.split("ReadSchema")[1]
    with pytest.raises(Conflict):
        s.commit({"x": spark.range(1)}, based_on=1)


def test_blocks_take_one_shuffle(spark, big, monkeypatch):
    """A chunk's words are grouped where it is read; blocks are those of grouped rows, whatever the pieces they travel in."""
    odd = spark.createDataFrame([(1, None, None, "n", "", 0, "the spark the", None, "simple"), (2, 5, 1, "e", "", 0, None, None, "french"), (9, 5, 1, "t", "", 0, "la window", None, "simple"), (9, 5, 1, "t", "", 0, "window rare", None, "simple"), (70, 6, 1, "s", "", 0, "la de la", None, "french")], CHUNK)
    rows = big.unionByName(odd)
    cell = F.pmod(F.xxhash64("chunk_id"), F.lit(100)).cast("int")
    by_hand = blocks.blocked(fts.by_language(rows, carry=("page_id", "source_id")).withColumn("cell", cell))
    plain = lambda df: sorted(map(str, df.select(*by_hand.columns).collect()))
    want = plain(by_hand)
    made = blocks.build(rows, 100)
    assert plain(made) == want and made.dtypes == [(c, dict(by_hand.dtypes)[c]) for c in made.columns]
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    monkeypatch.setattr(blocks, "PIECE", 50)
    monkeypatch.setattr(blocks, "SPAN", 2)
    assert plain(blocks.build(rows, 100)) == want
    assert blocks.build(rows.limit(0), 100).isEmpty()


def test_a_sync_writes_its_postings_once(spark, tmp_path, monkeypatch):
    """No copy of the postings is staged, and they are not dealt again."""
    import os

    from skarn.plans import search as plans

    root, exchanges, segment = f"file://{tmp_path}/s", [], Store._segment
    monkeypatch.setattr(plans, "scratch_folder", lambda _: root)

    def seen(self, name, df, *more):
        exchanges.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(shard")))
        return segment(self, name, df, *more)

    monkeypatch.setattr(Store, "_segment", seen)
    assert plans.search_after_sync(spark, "/root/testdata/sf0.001").count() > 0
    assert [n for name, n in exchanges if name == "postings"] == [1, 1]
    assert not [d for d in os.listdir(tmp_path / "s/_staged") if d.startswith("postings")]
    files = [f for d, _, fs in os.walk(tmp_path / "s/postings") for f in fs if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)
