"""Goldens and properties of the operators that SQL can't check."""

import io
import zipfile
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.functions import cron, fts, urls
from skarn.operators import chunk, discovery, health, search, sync
from skarn.sources import configs, uploads
from skarn.sources.store import Conflict, Store
from skarn.streaming import rules


@pytest.mark.parametrize(
    ("fetched", "purged", "refused"),
    [(60, 337, True), (280, 232, False)],
)
def test_purge_guard_of_397_pages(spark, fetched, purged, refused):
    pages = spark.createDataFrame([(1, f"page-{i}") for i in range(397)], "source_id int, url string")
    if refused:
        seen = [f"page-{i}" for i in range(60)]
    else:  # many new addresses: coverage counts pages that exist
        seen = [f"page-{i}" for i in range(165)]
    plan = sync.purge_plan(pages, spark.createDataFrame([(u,) for u in seen], "url string"), spark.createDataFrame([], "url string")).first()
    assert plan.would_delete == 397 - len(seen) and plan.refused == refused


RUN = {"fetched": 0, "skipped": 0, "not_modified": 0, "soft_failed": 0, "failed": 0, "cancelled": False, "purge_refused": False, "aborted": False, "truncated": False}


@pytest.mark.parametrize(
    ("change", "status"),
    [
        ({"fetched": 9}, "ok"), ({"fetched": 9, "cancelled": True}, "failed"), ({}, "failed"), ({"failed": 3}, "failed"), ({"not_modified": 1}, "ok"),
        ({"skipped": 5, "purge_refused": True}, "partial"), ({"skipped": 5, "aborted": True}, "partial"), ({"skipped": 5, "truncated": True}, "partial"),
        ({"fetched": 99, "failed": 1}, "partial"), ({"fetched": 8, "soft_failed": 2}, "ok"), ({"fetched": 163, "soft_failed": 117}, "partial"),
    ],
)
def test_run_classes(spark, change, status):
    row = {**RUN, **change}
    assert sync.with_status(spark.createDataFrame([row])).first().status == status


def test_shells_share_a_length(spark):
    rows = [("a", 61, "soft_failed")] * 115 + [("a", 45, "soft_failed")] * 2 + [("a", 7, "soft_failed")]
    got = sync.shells(spark.createDataFrame(rows, "source string, length int, outcome string")).collect()
    assert [(r.length, r.pages) for r in got] == [(61, 115)]


def test_breaker(spark):
    rows = [("a", i, ok) for i, ok in enumerate([False, False, True, False, False, False, True])] + [("b", 0, False), ("b", 1, True)]
    assert [tuple(r) for r in sync.breaker_trips(spark.createDataFrame(rows, "source string, ord int, ok boolean")).collect()] == [("a", 5)]


CANON = {
    "https://a/b": "https://a/b", "https://a/b?": "https://a/b", "https://a/b#x": "https://a/b", "https://a/b?utm_source=x&page=2&HL=de": "https://a/b?page=2", "https://a/b?ref=1&source=2&l=3": "https://a/b?ref=1&source=2&l=3",
    "https://a/b?flag": "https://a/b?flag=", "https://a/b?x=&&y=1": "https://a/b?x=&y=1", "https://a/b?q=a+b/c": "https://a/b?q=a%20b%2Fc", "https://a/b?q=a%2Fb": "https://a/b?q=a%2Fb", "https://a/b?q=ä": "https://a/b?q=%C3%A4", None: None,
}


def test_canonical_urls(spark):
    df = spark.createDataFrame([(u,) for u in CANON], "url string")
    assert {r.url: r.c for r in df.select("url", urls.canonical(F.col("url")).alias("c")).collect()} == CANON


def test_scope_ends_at_segments(spark):
    cases = [("/proxy", ["/proxy"], [], True), ("/proxy-hub", ["/proxy"], [], False), ("/proxy/v2.11/x", ["/proxy/v2"], [], False), ("/proxy/v2/x", ["/proxy/v2/"], [], True), ("/a/b", [], ["/a"], False), ("/ab", [], ["/a"], False), ("/a", ["/"], [], True), ("/a/b", ["/a"], ["/a/b"], False)]
    df = spark.createDataFrame(cases, "p string, inc array<string>, exc array<string>, want boolean")
    assert all(r.got == r.want for r in df.select("want", urls.in_scope(F.col("p"), F.col("inc"), F.col("exc")).alias("got")).collect())


def test_private_hosts():
    assert all(urls.private_literal(h) for h in ("127.0.0.1", "10.1.2.3", "192.168.0.1", "169.254.1.1", "[::1]", "240.0.0.1"))
    assert not any(urls.private_literal(h) for h in ("8.8.8.8", "example.com", "", None))
    assert urls.private_literal("224.0.0.1", multicast=True)


def test_unresolved_hosts_count_as_private(spark):
    hosts = spark.createDataFrame([("a",), ("b",), ("c",)], "host string")
    known = spark.createDataFrame([("a", "8.8.8.8"), ("b", "8.8.8.8"), ("b", "10.0.0.1")], "host string, address string")
    assert {r.host: r.private for r in urls.resolved_private(hosts, known).collect()} == {"a": False, "b": True, "c": True}
    assert {r.host: r.private for r in urls.resolved_private(hosts, known, fail_open=True).collect()}["c"] is False


@pytest.mark.parametrize(
    ("expr", "when", "want"),
    [
        ("0 0 * * *", datetime(2024, 1, 7), True), ("*/15 * * * *", datetime(2024, 1, 7, 3, 45), True), ("*/15 * * * *", datetime(2024, 1, 7, 3, 46), False), ("0 0 7 * 0", datetime(2024, 1, 7), True),
        ("0 0 7 * 1", datetime(2024, 1, 7), False), ("0,30 * * * *", datetime(2024, 1, 7, 1, 30), True), ("1-5 * * * *", datetime(2024, 1, 7, 0, 1), None), ("60 * * * *", datetime(2024, 1, 7), None), ("*/0 * * * *", datetime(2024, 1, 7), None),
        ("* * * * 7", datetime(2024, 1, 7), None), ("* * * *", datetime(2024, 1, 7), None), ("", datetime(2024, 1, 7), None), ("x * * * *", datetime(2024, 1, 7), None),
    ],
)
def test_cron(spark, expr, when, want):
    r = spark.createDataFrame([(expr, when)], "e string, t timestamp").select(cron.fields(F.col("e")).alias("f"), cron.matches(cron.fields(F.col("e")), F.col("t")).alias("m")).first()
    assert (r.f is None) == (want is None) and r.m == bool(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["para", "code", "h1", "h3"]), st.integers(1, 700)), max_size=25))
def test_windows_cover_units_in_order(parts):
    made = []
    for kind, n in parts:
        body = " ".join(f"w{i}" for i in range(n))
        made.append({"para": body, "code": f"```\n# {body}\n\n{body}\n```", "h1": f"# t{n}", "h3": f"### u{n}"}[kind])
    segs = chunk.segments("\n\n".join(made))
    for _, units in segs:
        tokens = [chunk.count_words(u) for u in units]
        last, seen = -1, set()
        for a, b in chunk.windows(units, tokens):
            assert a > last and b > a and (b - a == 1 or sum(tokens[a:b]) <= chunk.MAX_TOKENS)
            seen |= set(range(a, b))
            last = a
        assert seen == set(range(len(units)))
        assert all(u.count("```") in (0, 2) for u in units)
    assert [c[1] for c in chunk.chunk_text("\n\n".join(made))] == list(range(len(chunk.chunk_text("\n\n".join(made)))))


def test_breadcrumbs_and_fences():
    got = chunk.segments("pre\n# A\n\ntext\n### C\n```\n# not\n```\nx\n## B\n\ny")
    assert got == [("", ["pre"]), ("A", ["text"]), ("A > C", ["```\n# not\n```", "x"]), ("A > B", ["y"])]


def test_short_chunks_keep_paragraphs():
    got = chunk.chunk_short("# T\n\n" + "\n\n".join("p" * 900 for _ in range(3)) + "\n\n" + "q" * 3000)
    assert [len(c[2]) for c in got] == [1802, 900, 3000] and {c[0] for c in got} == {"T"}


def test_extraction_prefers_longer_text():
    assert chunk.extract_html("<nav>x</nav><p>Too short.</p>") == ("skipped", None, "too short", len("Too short."))
    status, md, _, n = chunk.extract_html("<nav>menu</nav><article><h2>T</h2><p>" + "word " * 60 + "</p></article>")
    assert status == "ok" and md.startswith("## T") and "menu" not in md and n == len(md)


def test_sitemaps():
    ns = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a/1 </loc></url></urlset>'
    assert discovery.parse_sitemap(ns) == (["https://a/1"], [], None)
    assert discovery.parse_sitemap("<sitemapindex><sitemap><loc>c</loc></sitemap></sitemapindex>") == ([], ["c"], None)
    assert all(discovery.parse_sitemap(x)[2] for x in ("", "<x", "<html/>", '<!DOCTYPE a [<!ENTITY b "c">]><urlset/>'))


def test_links_and_robots(spark):
    assert discovery.links_of('<a href="/x">a</a><a href="mailto:b">b</a><a href="">c</a><a href="y#z">d</a><a href="#top">e</a>', "https://h/p/q") == ["https://h/x", "https://h/p/y", "https://h/p/q"]
    f = spark.createDataFrame([("h", "https://h/a"), ("h", "https://h/b"), ("k", "https://k/b")], "host string, url string")
    r = spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /b"), ("k", 500, "x")], "host string, status int, body string")
    assert {x.url: x.allowed for x in discovery.allowed(f, r).collect()} == {"https://h/a": True, "https://h/b": False, "https://k/b": True}


def test_archives():
    def pack(names, link=None):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, d in names:
                z.writestr(n, d)
            if link:
                info = zipfile.ZipInfo(link)
                info.external_attr = 0o120777 << 16
                z.writestr(info, "/etc")
        return out.getvalue()

    got = uploads.expand_zip("z", pack([("a.md", "x"), ("b.exe", "y"), ("c.txt", "0" * 10**6), ("n.zip", "z")]))
    assert [(m, o) for m, o, _, _ in got] == [("a.md", "doc"), ("b.exe", "skipped"), ("c.txt", "failed"), ("n.zip", "skipped")]
    assert uploads.expand_zip("z", pack([("a.md", "x"), ("../b.md", "y")]))[0][1:3] == ("failed", "unsafe path ../b.md")
    assert uploads.expand_zip("z", pack([("a.md", "x")], link="l.md"))[0][1] == "failed"
    assert uploads.expand_zip("z", pack([(f"{i}.md", "x") for i in range(501)]))[0][1] == "failed"
    assert uploads.parse("x.pdf", b"%PDF")[0][2] == "PDF support is not available" and uploads.parse("x.bin", b"") == []


def test_parsers_can_be_replaced(monkeypatch):
    monkeypatch.setattr(uploads, "PARSERS", dict(uploads.PARSERS))
    uploads.register_parser(".RST", lambda n, d: ("rst", None))
    assert uploads.parse("a.rst", b"")[0][3] == "rst"


def test_upload_batches():
    sizes = [(f"f{i}", 1) for i in range(45)] + [("big", 50 << 20), ("x", 1)]
    assert [len(b) for b in uploads.batches(sizes)] == [20, 20, 5, 1, 1]


def test_folder_walk(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.MD").write_text("# A")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "c.bin").write_bytes(b"x")
    got = uploads.documents(uploads.read_files(spark, str(tmp_path))).collect()
    assert sorted((r.member, r.text) for r in got) == [("b.txt", "caf�"), ("d/a.MD", "# A")]


def test_configs(spark, tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text("sources:\n- {name: a, base_url: 'https://docs.a.dev/x', include_prefixes: [/x], schedule_cron: '0 4 * * *'}\n")
    assert configs.load_sources(spark, str(f)).first().language == "english"
    for bad in ({"name": "a b"}, {"base_url": "ftp://x"}, {"base_url": "https://localhost/"}, {"base_url": "http://10.0.0.1/"}, {"max_pages": 0}, {"language": "klingon"}, {"llms_txt": "x"}, {"sitemap": "https://other.dev/s.xml"}, {"exclude_prefixes": ["/"]}, {"schedule_cron": "1-2 * * * *"}, {"nope": 1}):
        with pytest.raises(ValueError):
            configs.frame(spark, [{"name": "a", "base_url": "https://docs.a.dev/", **bad}])
    with pytest.raises(ValueError):
        configs.frame(spark, [{"name": "a", "base_url": "https://docs.a.dev/"}] * 2)
    assert configs.resolve_model()[0] == 384 and configs.models(spark).first().name == configs.DEFAULT_MODEL
    assert configs.slug_clashes(configs.models(spark)).isEmpty()
    with pytest.raises(ValueError):
        configs.resolve_model("x")


def test_targets(spark):
    s = spark.createDataFrame([("a", "active", "crawl"), ("b", "pending", "crawl"), ("c", "active", "upload")], "name string, status string, source_type string")
    assert [r.name for r in configs.resolve_targets(s).collect()] == ["a"]
    with pytest.raises(LookupError):
        configs.resolve_targets(s, ["z"])
    with pytest.raises(PermissionError):
        configs.resolve_targets(s, ["b"])


def test_store_has_one_writer(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([(1,)], "x int")
    assert store.commit({"t": one}) == 1
    assert store.commit({"u": one.withColumn("x", F.lit(2))}) == 2
    with pytest.raises(Conflict):
        store.commit({"t": one}, based_on=1)
    assert store.read("t").first().x == 1 and store.read("u").first().x == 2
    with pytest.raises(LookupError):
        store.read("u", version=1)


def test_api_round_trip(spark, tmp_path):
    from skarn import api

    store = Store(spark, f"file://{tmp_path}/api")
    texts = ["spark joins and shuffles", "windows and ranks", "shuffle partitions in spark"]
    pages = spark.createDataFrame([(i, 1, f"https://s/{i}", "h") for i in range(3)], "id long, source_id int, url string, content_hash string")
    chunks = chunk.embed_passages(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t")
    chunks = chunks.join(spark.createDataFrame(list(enumerate(texts)), "id long, content string"), "id").select(F.col("id").alias("chunk_id"), F.col("id").alias("page_id"), F.lit(1).alias("source_id"), F.concat(F.lit("https://s/"), F.col("id").cast("string")).alias("url"), "content", "embedding")
    store.commit({"sources": spark.createDataFrame([(1, "s", "active", "upload")], "id int, name string, status string, source_type string"), "pages": pages.select("id", "source_id", "url", "content_hash"), "chunks": chunks})
    hits = api.search_chunks(store, "spark shuffles", "s", 2)
    assert hits.orderBy(F.desc("rrf")).first().chunk_id == 0 and hits.count() == 2
    assert "### s" in api.format_hits(hits) and api.format_hits(hits.limit(0)).startswith("No matching")
    assert api.source_tree(store).first().page_count == 3
    assert api.upload_text(store, "s", "My Title", "# A\n\nbody").first().url == "upload://s/my-title.md"
    assert api.purge(store, 1) == 4 and store.read("chunks").isEmpty()  # the uploaded text is stored
    with pytest.raises(ValueError):
        api.search_chunks(store, "  ")
    assert search.clamp(99) == 20 and search.clamp(0) == 1


def test_stems():
    # Examples of the stemmer's paper.
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "formalize": "formal", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "roll": "roll"}
    assert {w: fts.porter(w) for w in want} == want


def test_stems_begin_their_words(spark):
    """What the scan's filter relies on, over all words of the test tables and the usual endings."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.w for r in docs.select(F.explode(F.array_distinct(fts.tokens(F.col("text")))).alias("w")).distinct().collect()}
    words |= {b + e for b in ("relat", "valid", "hop", "fil", "sens", "oper", "vietnam", "happ", "agr", "hesit") for e in ("ational", "tional", "ency", "ancy", "izer", "ably", "ally", "ently", "ely", "ously", "ization", "ation", "ator", "alism", "iveness", "fulness", "ousness", "ality", "ivity", "ibility", "icate", "ative", "alize", "icity", "ical", "ies", "ied", "ying", "eed", "ing", "ed", "y")}
    assert all(w.startswith(fts.porter(w)[: max(1, len(fts.porter(w)) - 2)]) for w in words)


def test_html_blocks():
    from skarn.operators.chunk import extract_html

    html = "<nav>menu</nav><main><h2>T</h2><p>Use <code>x = 1</code> " + "and more words " * 20 + "</p><pre><code>def f():\n    return  1\n\n# no heading</code></pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2 <b>x</b></td></tr></table></main>"
    status, markdown, _, _ = extract_html(html)
    assert status == "ok" and "menu" not in markdown
    assert markdown.startswith("## T\n\nUse `x = 1` and more") and "```\ndef f():\n    return  1\n\n# no heading\n```" in markdown
    assert "| a | b |\n| 1 | 2 x |" in markdown


def test_tokenizer_counts():
    import public_tokenizers

    count = chunk.token_counter(public_tokenizers.path("word_bpe_49k.json"))
    assert count("") >= 0 and count("one two three") >= 3 and count("x " * 50) > count("x " * 10)

def test_web_queries():
    assert fts.parse_query('a "b c" or -d') == [[(False, ["a"]), (False, ["b", "c"])], [(True, ["d"])]]
    assert fts.parse_query("  ") == []


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = f"{tmp_path}/in"
    e.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = rules.counters(stream, late="40 days").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("counted").select(F.col("window.start"), "user_id", "event_type", "n").collect()}
    assert got == {tuple(r) for r in rules.counters(e).select(F.col("window.start"), "user_id", "event_type", "n").collect()}
    ticks = stream.select(F.col("user_id").alias("source"), "ts")
    q = rules.once_a_minute(ticks, late="40 days").writeStream.format("memory").queryName("ticked").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("ticked").count() == e.select("user_id", F.date_trunc("minute", "ts")).distinct().count()


def test_health(spark):
    t = lambda h: datetime(2024, 1, 1 + h // 24, h % 24)
    rows = [("a", t(0), 5, 0, 0, 30, 0, "ok"), ("a", t(20), 0, 0, 0, 2, 0, "partial"), ("b", t(60), 0, 0, 0, 0, 0, "failed")]
    runs = spark.createDataFrame(rows, "source string, finished_at timestamp, fetched int, skipped int, not_modified int, soft_failed int, failed int, status string")
    assert [(r.source, r.total) for r in health.ratio_alert(runs, "soft_failed").orderBy("finished_at").collect()] == [("a", 35), ("a", 37)]
    assert [r.source for r in health.indexed_nothing(runs).collect()] == ["b"]
    assert [r.source for r in health.stale(runs, F.lit(datetime(2024, 1, 5))).collect()] == ["a"]


@pytest.mark.parametrize("cells", [32, 64])
def test_ivf_recall(spark, cells):
    """Every 20th vector as a query, against brute force."""
    from skarn.operators import ivf

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    centres = ivf.fit(e, cells)
    index = ivf.assign(e, centres).cache()
    assert index.count() == e.count() and index.where("cell < 0").isEmpty()
    asked = e.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    pairs = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    want = pairs(search.batch_nearest(e, asked, limit=10))
    assert len(want & pairs(ivf.batch_search(index, centres, asked, limit=10))) >= 0.9 * len(want)


def test_sync_end_to_end(spark):
    long = "word " * 60
    pages = spark.createDataFrame([(1, "u1", "old"), (1, "u2", "old"), (1, "gone", "old"), (2, "v1", "old")], "source_id int, url string, content_hash string")
    rows = [
        (1, "a", "u1", True, False, long), (1, "a", "u2", True, True, None), (1, "a", "u3", True, False, "short"), (1, "a", "u4", True, False, "other"),
        (1, "a", "u5", True, False, "third"), (1, "a", "u6", False, False, None), (2, "b", "v1", False, False, None),
    ]
    fetched = spark.createDataFrame(rows, "source_id int, source string, url string, fetch_ok boolean, not_modified boolean, markdown string")
    after, outcomes, runs = sync.sync(fetched, pages)
    assert sorted((r.url, r.content_hash == "old") for r in after.collect()) == [("u1", False), ("u2", True), ("v1", True)]
    assert {r.url: r.outcome for r in outcomes.collect()} == {"u1": "fetched", "u2": "not_modified", "u3": "soft_failed", "u4": "soft_failed", "u5": "soft_failed", "u6": "fetch_failed", "v1": "fetch_failed"}
    assert {r.source: r.status for r in runs.collect()} == {"a": "partial", "b": "failed"}
    shown = spark.createDataFrame([("u3", f"<article><p>{long}</p></article>"), ("u9", "x")], "url string, html string")
    again = sync.retry_shells(outcomes, shown)
    assert {r.url: r.outcome for r in again.collect()}["u3"] == "fetched" and again.count() == 7


def test_batch_ivf(spark):
    """Every 20th vector as a query: over all cells the exact search, over a few the single searches."""
    from skarn.operators import ivf

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = e.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    centres = ivf.fit(e, 32)
    index = ivf.assign(e, centres).cache()
    rows = lambda df: sorted((r.query_id, r.rnk, r.chunk_id) for r in df.collect())
    assert rows(ivf.batch_search(index, centres, asked, probes=32, limit=10)) == rows(search.batch_nearest(e, asked, limit=10))
    got = rows(ivf.batch_search(index, centres, asked, limit=10))
    assert {q for q, _, _ in got} == {r.query_id for r in asked.collect()}
    for r in asked.where("query_id % 100 = 0").collect():
        want = [x.chunk_id for x in ivf.search(index, centres, list(r.vector), limit=10).orderBy("distance", "chunk_id").collect()]
        assert [c for q, _, c in got if q == r.query_id] == want


def test_vector_topk_ivf_asks_every_20th_vector(spark):
    from skarn.plans.search import vector_topk_ivf

    sf = "/root/testdata/sf0.001"
    ids = {r.query_id for r in vector_topk_ivf(spark, sf).select("query_id").distinct().collect()}
    assert ids == {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").collect()}


def test_prefixes_and_slugs_of_whole_texts(spark, tmp_path):
    """What stands behind the first 200 characters reaches both operators."""
    from skarn.plans.inputs import prefix_lists
    from skarn.plans.texts import slugify

    text = "Some words, " * 40 + "the LAST one\n, end!"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    parts = {r.doc_id: r.prefixes for r in prefix_lists(spark, str(tmp_path)).collect()}
    assert parts[1] == "|".join(["Some words"] * 40 + ["the LAST one", "end!"]) and parts[3] == ""
    slugs = {r.doc_id: r.slug for r in slugify(spark, str(tmp_path)).collect()}
    assert slugs[1] == "some-words-" * 40 + "the-last-one-end" and slugs[2] is None


def test_rank_of_words_beyond_a_long_texts_first_positions(spark):
    """Distances behind position 16,383 are those of the SQL twin: the same pair of words weighs the same anywhere."""
    near, far = "by x from", "by " + "x " * 50 + "from"
    rows = [(1, near), (2, "x " * 17_000 + near), (3, far), (4, "x " * 17_000 + far), (5, "x " * 16_380 + far)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    got = {r.chunk_id: r["rank"] for r in fts.rank_all(fts.postings(chunks), ["by", "from"]).collect()}
    assert got[2] == got[1] > 0.09 and got[4] == got[5] == got[3] < 0.01


def test_batch_ivf_makes_no_row_of_each_pair(spark, monkeypatch):
    """Vectors and queries meet in blocks: a join sees blocks, a task gives its best rows; the result does not depend on the blocks."""
    from skarn.operators import ivf

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    twins = e.where("chunk_id < 40").select((F.col("chunk_id") + 10_000).alias("chunk_id"), "embedding")  # ties by id
    e = e.unionByName(twins).unionByName(spark.createDataFrame([(20_000, None), (20_001, [0.0] * 64)], "chunk_id long, embedding array<float>").select("chunk_id", F.col("embedding").cast(e.schema["embedding"].dataType)))
    asked = e.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    centres = ivf.fit(e, 8)
    index = ivf.assign(e, centres).cache()
    found = ivf.batch_search(index, centres, asked, probes=8, limit=5)
    rows = lambda df: sorted((r.query_id, r.rnk, r.chunk_id) for r in df.collect())
    want = rows(search.batch_nearest(e, asked, limit=5))
    assert rows(found) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")  # what the join makes are blocks
    whole = rows(ivf.batch_search(index, centres, asked, probes=3, limit=5))
    monkeypatch.setattr(ivf, "BLOCK", 7)
    monkeypatch.setattr(ivf, "ASKED", 3)
    monkeypatch.setattr(ivf, "HELD", 10)
    assert rows(ivf.batch_search(index, centres, asked, probes=8, limit=5, slots=3)) == want
    assert rows(ivf.batch_search(index, centres, asked, probes=3, limit=5, slots=2)) == whole
    assert ivf.batch_search(index, centres, asked.limit(0)).isEmpty() and ivf.batch_search(index.limit(0), centres, asked).isEmpty()
