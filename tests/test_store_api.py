"""One store through sync, uploads, sources, search and purge."""

import pytest
from pyspark.sql import functions as F

from skarn import api
from skarn.functions import urls
from skarn.operators import blocks, crawl, search, sync
from skarn.sources import uploads
from skarn.sources.store import Conflict, Store

FETCHED = "source_id int, source string, url string, fetch_ok boolean, not_modified boolean, markdown string, etag string, last_modified string"
LONG = "word of a page that is long enough to be kept " * 8


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    sources = spark.createDataFrame([(1, "a", "https://a.dev/docs/", "active", "crawl", "english"), (2, "b", "https://b.dev/", "active", "crawl", "french"), (3, "up", "upload://up", "active", "upload", "simple")], "id int, name string, base_url string, status string, source_type string, language string")
    sources = sources.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("sitemap", "string"), ("include_prefixes", "array<string>"), ("exclude_prefixes", "array<string>"), ("max_pages", "int"), ("rate_limit_rps", "float"), ("llms_txt", "string"), ("js_render", "boolean"), ("schedule_cron", "string"), ("proposed_by", "string"))])
    pages = spark.createDataFrame([], "id long, source_id int, url string, content_hash string, fetched_at timestamp, etag string, last_modified string")
    s.commit({"sources": sources, "pages": pages})
    return s


def rows(spark, *pages):
    return spark.createDataFrame([(1 if src == "a" else 2, src, url, ok, nm, md, etag, None) for src, url, ok, nm, md, etag in pages], FETCHED)


def test_sync_then_purge(spark, store):
    first = rows(spark, *[("a", f"https://a.dev/{i}", True, False, f"# Page {i}\n\n{LONG}{i}", "e1") for i in range(30)], ("b", "https://b.dev/x", True, False, LONG + "x", None))
    got = {r.source: r for r in api.run_sync(store, first).collect()}
    assert (got["a"].fetched, got["a"].status, got["a"].chunks_indexed) == (30, "ok", 30)
    assert store.read("pages").count() == 31 and store.read("chunks").count() == 31
    assert {r.fts_config for r in store.read("chunks").where("source_id = 2").collect()} == {"french"}
    assert {(r.name, r.last_status) for r in store.read("sources").collect()} == {("a", "ok"), ("b", "ok"), ("up", None)}
    ids = {r.url: r.id for r in store.read("pages").collect()}
    # five pages are seen again, one of them changed: the purge is refused, and the run says so
    again = rows(spark, *[("a", f"https://a.dev/{i}", True, False, f"# Page {i}\n\n{LONG}{i}" + ("!" if i == 2 else ""), "e2") for i in range(5)])
    run = api.run_sync(store, again).first()
    assert (run.fetched, run.skipped, run.purge_refused, run.status, run.pages_removed) == (1, 4, True, "partial", 0)
    now = {r.url: (r.id, r.etag) for r in store.read("pages").collect()}
    assert len(now) == 31 and now["https://a.dev/2"][0] != ids["https://a.dev/2"] and now["https://a.dev/3"] == (ids["https://a.dev/3"], "e2")
    assert store.read("chunks").where("url = 'https://a.dev/2'").first().content.endswith("!") and store.read("chunks").count() == 31
    # most pages are seen: what is gone goes, with its chunks
    most = rows(spark, *[("a", f"https://a.dev/{i}", True, True, None, None) for i in range(20)])
    run = api.run_sync(store, most).first()
    assert (run.not_modified, run.pages_removed, run.status) == (20, 10, "ok")
    assert store.read("pages").count() == 21 and store.read("chunks").count() == 21
    # an incomplete crawl purges nothing; an unchanged index keeps all
    part = rows(spark, ("a", "https://a.dev/1", True, True, None, None))
    signals = spark.createDataFrame([(1, "a", True, False, False), (2, "b", False, False, True)], "source_id int, source string, truncated boolean, aborted boolean, unchanged boolean")
    got = {r.source: r for r in api.run_sync(store, part, signals).collect()}
    assert (got["a"].status, got["a"].pages_removed, got["a"].truncated) == ("partial", 0, True)
    assert (got["b"].status, got["b"].not_modified) == ("ok", 1) and store.read("pages").count() == 21
    assert {r.source: r.page_count for r in api.source_tree(store).select(F.col("name").alias("source"), "page_count").collect()} == {"a": 20, "b": 1, "up": 0}
    assert api.purge(store, 1) == 20
    assert store.read("pages").count() == 1 and store.read("chunks").count() == 1
    assert store.read("sync_runs").count() == 6  # 2 + 1 + 1 + 2 rows
    assert api.metrics(store).where("source = 'a' and status = 'partial'").first().value == 1


def test_script_shells_get_a_second_look(spark, store):
    shells = rows(spark, *[("a", f"https://a.dev/s{i}", True, False, "loading", None) for i in range(4)])
    shown = spark.createDataFrame([("https://a.dev/s1", f"<main><p>{LONG}</p></main>")], "url string, html string")
    run = api.run_sync(store, shells, rendered=shown).first()
    assert (run.fetched, run.soft_failed, run.shell_suspected) == (1, 3, 3)
    # the same rendered page again is unchanged
    run = api.run_sync(store, shells, rendered=shown).first()
    assert (run.fetched, run.skipped) == (0, 1)


def test_uploads(spark, store):
    files = spark.createDataFrame([("a.md", bytearray(b"# A\n\nshort text")), ("dir/b.txt", bytearray(LONG.encode())), ("c.pdf", bytearray(b"%PDF")), ("d.bin", bytearray(b"x"))], "name string, content binary")
    run = api.ingest_uploads(store, "up", uploads.documents(files)).first()
    assert (run.fetched, run.failed, run.status, run.chunks_indexed) == (2, 1, "partial", 2)
    run = api.ingest_uploads(store, "up", uploads.documents(files.where("name like 'a%'"))).first()
    assert (run.skipped, run.fetched, run.status) == (1, 0, "ok")
    assert {r.url for r in store.read("pages").collect()} == {"upload://up/a.md", "upload://up/dir/b.txt"}
    for content in ("# T\n\none", "# T\n\ntwo"):
        made = api.upload_text(store, "up", "My Title", content).collect()
        assert [(r.url, r.heading_path, r.content) for r in made] == [("upload://up/my-title.md", "T", content[-3:])]
    assert store.read("chunks").count() == 3 and store.read("pages").count() == 3
    with pytest.raises(PermissionError):
        api.upload_text(store, "a", "t", "c")
    with pytest.raises(LookupError):
        api.ingest_uploads(store, "zz", uploads.documents(files))


def test_sources(spark, store):
    assert api.propose_source(store, "secret", "https://docs.foo.io/__/bar/") == "foo-bar"
    assert api.propose_source(store, "secret", "https://docs.foo.io/bar/x") == "foo-bar-2"
    with pytest.raises(ValueError):
        api.propose_source(store, "secret", "https://foo.io/", name="foo-bar")
    with pytest.raises(ValueError):
        api.propose_source(store, "secret", "http://127.0.0.1/")
    got = store.read("sources").where("name = 'foo-bar'").first()
    assert (got.status, got.max_pages, got.include_prefixes, got.id) == ("pending", 500, ["/__/bar/"], 4) and got.proposed_by.startswith("token-") and "secret" not in got.proposed_by
    api.update_source(store, 4, max_pages=7, exclude_prefixes=["/__/bar/old"])
    got = store.read("sources").where("id = 4").first()
    assert (got.max_pages, got.exclude_prefixes, got.status) == (7, ["/__/bar/old"], "pending")
    for bad in ({"max_pages": 0}, {"status": "active"}):
        with pytest.raises(ValueError):
            api.update_source(store, 4, **bad)
    file = [{"name": "a", "base_url": "https://a.dev/docs/", "max_pages": 9}, {"name": "new", "base_url": "https://new.dev/"}]
    assert {(r.name, r["class"]) for r in api.import_sources(store, file).collect()} == {("a", "updated"), ("new", "created")}
    assert {(r.name, r["class"]) for r in api.import_sources(store, file).collect()} == {("a", "skipped"), ("new", "skipped")}
    assert store.read("sources").where("name = 'new'").first().status == "active" and store.read("sources").count() == 6
    api.set_index_validators(store, 1, "etag", None)
    assert store.read("sources").where("id = 1").first().llms_etag == "etag"


def test_search_over_stored_postings(spark, store, tmp_path):
    texts = {"a": ["Running shuffles in Spark joins", "the broadcast join is small", "nothing of note here"], "b": ["les jointures de la diffusion", "la maison est grande"]}
    api.run_sync(store, rows(spark, *[(s, f"https://{s}.dev/{i}", True, False, f"# H{i}\n\n{t}. {'filler ' * 40}", None) for s, ts in texts.items() for i, t in enumerate(ts)]))
    scan = [tuple(r) for r in api.search_chunks(store, '"spark joins" or jointures -maison', limit=3).collect()]
    assert {scan[0][2], scan[1][2]} == {"https://a.dev/0", "https://b.dev/0"}
    api.index(store, cells=1)
    assert [tuple(r) for r in api.search_chunks(store, '"spark joins" or jointures -maison', limit=3).collect()] == scan
    # stems of the row's own language: run finds Running, and french stop words are no words
    words = search.text_candidates(store.read("chunks"), "run shuffle")
    assert words.count() == 1 and search.text_candidates(store.read("chunks").where("source_id = 2"), "la").count() == 0
    assert blocks.top(*store.raw("postings"), "run shuffle")[0] == [tuple(r) for r in words.collect()]
    assert api.search_chunks(store, "???", limit=2).count() == 2 and search.text_candidates(store.read("chunks"), "???").isEmpty()
    hits, line = api.timed_search(store, "spark", source="a")
    api.log_searches(store, [line, {"status": "error", "seconds": 9.0}])
    assert hits and store.read("search_log").count() == 2
    version = api.backup(store, f"file://{tmp_path}/copy")
    api.purge(store, 1)
    api.restore(store, f"file://{tmp_path}/copy", version)
    assert store.read("chunks").count() == 5
    with pytest.raises(Conflict):
        store.commit({"x": spark.range(1)}, based_on=1)


def test_command_line(spark, store, capsys):
    from skarn import cli

    api.run_sync(store, rows(spark, ("a", "https://a.dev/1", True, False, f"# Joins\n\nshuffled joins {LONG}", None)))
    run = lambda *args: (cli.main(["--store", store.root, *args], spark), capsys.readouterr().out)[1]
    chunk_id = store.read("chunks").first().chunk_id
    assert run("search", "joins").startswith(f"ID: {chunk_id} | Source: a | Score: 0.033\nHeading: Joins\nURL: https://a.dev/1\nSnippet: shuffled joins")
    assert run("--compact", "search", "joins").startswith(f"[{chunk_id}] a > Joins (score: 0.033)\n  shuffled")
    assert '"heading_path": "Joins"' in run("--json", "search", "joins", "--source", "a", "--limit", "99")
    assert run("get", str(chunk_id)).startswith(f"ID: {chunk_id}\nSource: a\nHeading: Joins\nURL: https://a.dev/1\nFetched At: 2")
    assert "  - a (pages: 1, chunks: 1) [https://a.dev/docs/]\n" in run("--compact", "tree")
    assert cli.main(["--store", store.root, "search", " "], spark) == 1 and cli.main(["--store", store.root, "get", "5"], spark) == 1


def test_stream_into_the_store(spark, store, tmp_path):
    batch = rows(spark, *[("a", f"https://a.dev/{i}", True, False, f"{LONG}{i}", None) for i in range(6)])
    src = f"{tmp_path}/in"
    batch.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = api.sync_stream(store, stream, f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert store.read("pages").count() == 6 and store.read("chunks").count() == 6
    assert {r.pages_removed for r in store.read("sync_runs").collect()} == {0}


def test_names_and_scope(spark):
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert not one(urls.in_scope(F.lit("/compose/releases"), arr(), arr("/compose/releases/")))
    assert not one(urls.in_scope(F.lit("/proxy/v2.11/x"), arr(), arr("proxy/v2")))
    assert one(urls.in_scope(F.lit("/a/b"), arr("a/"), arr())) and one(urls.in_scope(F.lit("/a/b"), arr("/"), arr()))
    assert urls.free_name("x", ["x", "x-2", "x-4"]) == "x-3"
    wanted = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x"), (5, "x-3"), (6, "z")], "i int, name string")
    taken = spark.createDataFrame([("x",), ("x-2",), ("q",)], "name string")
    got = {r.i: r["name"] for r in urls.unique_names(wanted, taken, "i").collect()}
    assert got == {1: "x-4", 2: "x-5", 3: "y", 4: "x-6", 5: "x-3", 6: "z"}


def test_purge_is_refused_by_coverage_of_all_that_was_seen(spark):
    pages = spark.createDataFrame([(1, f"u{i}") for i in range(40)], "source_id int, url string")
    seen = spark.createDataFrame([(1, f"n{i}") for i in range(20)], "source_id int, url string")
    plan = sync.purge_plan(pages, seen, seen.select("url").limit(0)).first()
    assert (plan.would_delete, plan.covered, plan.guarded, plan.refused) == (40, 20, False, False)


SOURCE = "source_id long, source string, base_url string, sitemap string, include_prefixes array<string>, exclude_prefixes array<string>, max_pages int, llms_txt string"


def test_crawl(spark):
    page = lambda *links: "<main>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</main>"
    index = "# Docs\n\n- [one](/d/1)\n- [two](https://l.dev/d/2?utm_source=x#f)\n- [off](https://other.dev/)\n- [out](/e/9)\n"
    answers = [
        # links: a cap of ok pages, a redirect, a refused one, robots, a loop, a 304
        ("https://a.dev/", 200, page("/1", "/2#frag", "mailto:x", "/1", "/private/x", "/moved", "https://b.dev/x"), None, "e"),
        ("https://a.dev/1", 200, page("/3", "/gone", "/off"), None, None), ("https://a.dev/2", 304, None, None, None), ("https://a.dev/moved", 301, None, "/m2#x", None), ("https://a.dev/m2", 200, "moved", None, None),
        ("https://a.dev/off", 302, None, "https://b.dev/", None), ("https://a.dev/3", 302, None, "/3", None), ("https://a.dev/private/x", 200, "no", None, None), ("https://a.dev/late", 200, "late", None, None),
        # an index of links, a whole documentation, an unchanged index, a sitemap with a cap
        ("https://l.dev/llms-full.txt", 200, "<html>", None, None), ("https://l.dev/llms.txt", 200, index, None, None), ("https://l.dev/d/1", 200, "one", None, None), ("https://l.dev/d/2", 200, "two", None, None),
        ("https://w.dev/llms-full.txt", 200, "# First\n\ntext\n# Second\n\nmore", None, None), ("https://u.dev/llms.txt", 304, None, None, None),
        ("https://s.dev/map.xml", 200, "<urlset>" + "".join(f"<url><loc>https://s.dev/p{i}</loc></url>" for i in range(5)) + "</urlset>", None, None), ("https://s.dev/p0", 200, "p0", None, None), ("https://s.dev/p1", 200, "p1", None, None),
    ]
    fetches = spark.createDataFrame([(*a, None) for a in answers], "url string, status int, body string, location string, etag string, last_modified string")
    robots = spark.createDataFrame([("a.dev", 200, "User-agent: *\nDisallow: /private/")], "host string, status int, body string")
    validators = spark.createDataFrame([("https://a.dev/2", "v", None), ("https://u.dev/llms.txt", "v", None)], "url string, etag string, last_modified string")
    rows_ = [
        (1, "a", "https://a.dev/", None, [], [], None, "off"), (2, "l", "https://l.dev/", None, ["/d"], [], None, "auto"), (3, "w", "https://w.dev/", None, [], [], 1, "only"), (4, "u", "https://u.dev/", None, [], [], None, "auto"),
        (5, "s", "https://s.dev/", "https://s.dev/map.xml", [], [], 2, "off"), (6, "n", "https://n.dev/", None, [], [], None, "only"), (7, "p", "http://10.0.0.1/", None, [], [], None, "off"),
    ]
    items, signals = crawl.crawl(spark.createDataFrame(rows_, SOURCE), fetches, robots, validators)
    got = {}
    for r in items.orderBy("source_id", "ord").collect():
        got.setdefault(r.source, []).append((r.url.split(".dev")[1], "304" if r.not_modified else "ok" if r.fetch_ok else "failed"))
    assert got["a"] == [("/", "ok"), ("/1", "ok"), ("/2", "304"), ("/private/x", "failed"), ("/moved", "ok"), ("/3", "failed"), ("/gone", "failed"), ("/off", "failed")]
    assert got["l"] == [("/d/1", "ok"), ("/d/2", "ok")] and got["s"] == [("/p0", "ok"), ("/p1", "ok")]
    assert set(got) == {"a", "l", "w", "s"} and len(got["w"]) == 1
    assert {r.source: (r.unchanged, r.truncated, r.overflow) for r in signals.collect()} == {"a": (False, False, 0), "l": (False, False, 0), "w": (False, False, 0), "u": (True, False, 0), "s": (False, True, 3), "n": (False, False, 0)}
    capped = crawl.by_links(spark.createDataFrame([(1, "a", "https://a.dev/", None, [], [], 2, "off")], SOURCE), crawl.answers(fetches), robots, validators)
    assert [r.url for r in capped.orderBy("ord").collect()] == ["https://a.dev/", "https://a.dev/1"]
    ready = crawl.fetched_pages(items).collect()
    assert {r.markdown for r in ready if r.source == "w"} == {"# First\n\ntext"} and len(ready) == 13
