"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import fts, stems, text
from skarn.operators import blocks, search
from skarn.sources.store import Store, scratch_folder

from . import fixtures as fx
from .registry import query

QUERY_VEC = 7
ANY = "the or de"
#: French and Spanish rows lose the stop words de and la, and with them the phrase.
QUERY = 'the with -from or re eau or "de la"'
_COS = "list_cosine_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_VEC = f"va AS (SELECT chunk_id, round({_COS}, 9) AS distance FROM ck c, embeddings q WHERE q.vec_id = {QUERY_VEC} AND c.embedding IS NOT NULL %s ORDER BY distance, chunk_id LIMIT 30)"
_WEIGHT = "0.1 * list_sum(list_transform(range(1, least(tf, 255) + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685::DOUBLE"
_TXT = f"ta AS (SELECT chunk_id, round(sum({_WEIGHT}) / 2, 9) AS rank FROM tok WHERE lexeme IN ('the', 'de') GROUP BY 1 ORDER BY rank DESC, chunk_id LIMIT 30)"
_RRF = """rr AS (SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + rnk)), 12) AS rrf FROM (
  SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS rnk FROM va UNION ALL
  SELECT chunk_id, row_number() OVER (ORDER BY rank DESC, chunk_id) AS rnk FROM ta) GROUP BY 1)"""
_BOTH = ",".join([_VEC % "", _TXT, _RRF])
_TF = "coalesce(0.1 * list_sum(list_transform(range(1, least(len(list_filter(a, lambda x: x = '%s')), 255) + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685::DOUBLE, 0)"
_SHORT, _LONG = (" + ".join(_TF % w for w in ws.split()) for ws in ("the with from re eau", "the with from re eau de la"))
_WEB = rf"""lx AS (SELECT chunk_id, fts_config IN ('french', 'spanish') AS short, list_filter(string_split_regex(lower(content), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS a FROM ck),
  mt AS (SELECT *, (list_contains(a, 'the') AND list_contains(a, 'with') AND NOT list_contains(a, 'from')) OR (list_contains(a, 're') AND list_contains(a, 'eau')) OR (NOT short AND list_contains(list_transform(range(1, len(a)), lambda i: a[i] = 'de' AND a[i + 1] = 'la'), true)) AS ok FROM lx),
  wa AS (SELECT chunk_id, round(CASE WHEN short THEN ({_SHORT}) / 5 ELSE ({_LONG}) / 7 END, 9) AS rank FROM mt WHERE ok),
  ta AS (SELECT * FROM wa ORDER BY rank DESC, chunk_id LIMIT 30)"""
_WEB_BOTH = ",".join([_VEC % "", _WEB, _RRF])


def _chain(views: str, more: str, body: str) -> str:
    return fx.sql(views, "").rstrip() + ",\n" + more + "\n" + body


def query_vector(spark, sf) -> list[float]:
    row = fx.table(spark, sf, "embeddings").where(F.col("vec_id") == QUERY_VEC).select("embedding").first()
    return [float(x) for x in row[0]]


@query("vector_topk", _chain("ck", _VEC % "", "SELECT chunk_id, distance FROM va"))
def vector_topk(spark, sf):
    return search.vector_candidates(fx.chunks(spark, sf), query_vector(spark, sf))


@query("vector_topk_source", _chain("ck", _VEC % "AND c.source_id = 3", "SELECT chunk_id, distance FROM va"))
def vector_topk_source(spark, sf):
    return search.vector_candidates(fx.chunks(spark, sf), query_vector(spark, sf), source_id=3)


@query("fts_topk_simple", _chain("tok", _TXT, "SELECT chunk_id, rank FROM ta"))
def fts_topk_simple(spark, sf):
    return search.text_candidates(fx.plain_chunks(spark, sf), ANY)


@query("fts_topk_postings", _chain("tok", _TXT, "SELECT chunk_id, rank FROM ta"))
def fts_topk_postings(spark, sf):
    return search.indexed_candidates(fts.stored(fx.plain_chunks(spark, sf)), ANY)


@query("fts_topk_web", _chain("ck", _WEB, "SELECT chunk_id, rank FROM ta"))
def fts_topk_web(spark, sf):
    """Phrases, minus and or, each row in its language, by a scan."""
    return search.text_candidates(fx.language_chunks(spark, sf), QUERY)


@query("fts_topk_web_stored", _chain("ck", _WEB, "SELECT chunk_id, rank FROM ta"))
def fts_topk_web_stored(spark, sf):
    """The same from postings as a store holds them."""
    return search.indexed_candidates(fts.stored(fx.language_chunks(spark, sf)), QUERY)


@query("fts_topk_blocks", _chain("ck", _WEB, "SELECT chunk_id, rank FROM ta"))
def fts_topk_blocks(spark, sf):
    """The same from blocks, of which those below the last place stay closed."""
    chunks = fx.language_texts(spark, sf)
    made = Store(spark, scratch_folder(spark)).staged(blocks.build(chunks, blocks.cells_for(chunks.count())), "postings")
    return spark.createDataFrame(blocks.top(made, None, QUERY)[0], "chunk_id long, rank double")


@query("search_after_sync", _chain("ck", _WEB, "SELECT chunk_id, rank FROM ta"))
def search_after_sync(spark, sf):
    """A store of yesterday's pages is indexed, then pages change, come and go in one commit; its postings find today's."""
    store, now = Store(spark, scratch_folder(spark)), fx.language_texts(spark, sf)
    old = F.when(F.col("chunk_id") % 5 == 0, F.concat(F.lit("the water re eau "), "content")).otherwise(F.col("content"))
    before = now.where("chunk_id % 7 <> 0").withColumn("content", old)
    # pages that are no more: each with the words of the query
    stale = now.where("chunk_id % 11 = 0").select((-F.col("chunk_id") - 1).alias("chunk_id"), (-F.col("page_id") - 1).alias("page_id"), "source_id", "url", F.lit("the with re eau de la").alias("content"), "fts_config")
    before = before.unionByName(stale)
    spread = blocks.cells_for(before.count())
    store.commit({"chunks": before, "postings": blocks.build(before, spread)}, dealt=("postings",))
    fresh = store.staged(now.where("chunk_id % 7 = 0 or chunk_id % 5 = 0"), "fresh")
    gone = store.staged(fresh.select("page_id").unionByName(stale.select("page_id")), "gone")
    store.commit(added={"chunks": fresh, "postings": blocks.build(fresh, spread)}, deleted={"chunks": gone, "postings": gone}, dealt=("postings",))
    return spark.createDataFrame(blocks.top(*store.raw("postings"), QUERY)[0], "chunk_id long, rank double")


@query("store_reads_after_changes", fx.sql("ck", "SELECT chunk_id, page_id, source_id, sha256(content) AS h FROM ck WHERE source_id <> 2"))
def store_reads_after_changes(spark, sf):
    """Live rows of a table after changed pages, new ones and a purge, each a commit of its own, and a merge of what they left."""
    store, now = Store(spark, scratch_folder(spark)), fx.chunks(spark, sf).select("chunk_id", "page_id", "source_id", "content")
    store.commit({"chunks": now.where("chunk_id % 7 <> 0").withColumn("content", F.concat(F.lit("~"), "content"))})
    for part in range(4):
        fresh = store.staged(now.where(F.col("chunk_id") % 4 == part), "fresh")
        store.commit(added={"chunks": fresh}, deleted={"chunks": fresh.select("page_id")})
    store.commit(deleted={"chunks": store.read("chunks").where("source_id = 2").select("page_id")})
    store.compact()
    return store.read("chunks").select("chunk_id", "page_id", "source_id", F.sha2("content", 256).alias("h"))


@query("rrf_fused", _chain("tok", _BOTH, "SELECT * FROM rr"))
def rrf_fused(spark, sf):
    c = fx.plain_chunks(spark, sf)
    return search.fused(search.vector_candidates(c, query_vector(spark, sf)), search.text_candidates(c, ANY))


@query("rrf_search_hits", _chain("ck", _WEB_BOTH, "SELECT c.chunk_id, s.name AS source, c.url, c.content, rr.rrf FROM rr JOIN ck c USING (chunk_id) JOIN src s ON s.id = c.source_id ORDER BY rrf DESC, c.chunk_id LIMIT 5"))
def rrf_search_hits(spark, sf):
    return search.hybrid(fx.language_chunks(spark, sf), fx.sources(spark, sf), query_vector(spark, sf), QUERY)


def batch_vectors(spark, sf):
    """Every 20th vector, as queries."""
    return fx.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("rrf_batch_queries", fx.sql("ck", """SELECT query_id, chunk_id, rnk, distance FROM (
  SELECT q.vec_id AS query_id, c.chunk_id, round(list_cosine_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), c.chunk_id) AS rnk
  FROM ck c, embeddings q WHERE q.vec_id % 20 = 0 AND c.embedding IS NOT NULL) WHERE rnk <= 5"""))
def rrf_batch_queries(spark, sf):
    return search.batch_nearest(fx.chunks(spark, sf), batch_vectors(spark, sf))


@query("search_snippet", fx.sql("pg", """SELECT id, CASE WHEN length(t) > 200 THEN t[1:197] || '...' ELSE t END AS snippet
  FROM (SELECT id, trim(replace(text, chr(10), ' '), ' ') AS t FROM pg)"""))
def search_snippet(spark, sf):
    return fx.pages(spark, sf).select("id", text.snippet(F.col("text")).alias("snippet"))


@query("hit_format", _chain("ck", _WEB_BOTH, """SELECT string_agg('### ' || s.name || chr(10) || 'Source: [' || s.name || '](' || c.url || ')' || chr(10) || chr(10) || c.content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rrf DESC, c.chunk_id) AS hits
  FROM (SELECT * FROM rr ORDER BY rrf DESC, chunk_id LIMIT 5) r JOIN ck c USING (chunk_id) JOIN src s ON s.id = c.source_id"""))
def hit_format(spark, sf):
    hits = rrf_search_hits(spark, sf).withColumn("heading", F.col("source"))
    return hits.agg(search.blocks(hits).alias("hits"))


@query("term_tf", fx.sql("tok", "SELECT chunk_id, lexeme, tf FROM tok"))
def term_tf(spark, sf):
    return fts.postings(fx.chunks(spark, sf)).select("chunk_id", "lexeme", "tf")


@query("postings_positions", fx.sql("ck", r"""SELECT lexeme, count(*) AS chunks, sum(tf)::BIGINT AS occurrences, min(first)::BIGINT AS first FROM (
  SELECT chunk_id, lexeme, count(*) AS tf, min(p) AS first FROM (
    SELECT chunk_id, unnest(a) AS lexeme, unnest(range(1, len(a) + 1)) AS p FROM (
      SELECT chunk_id, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS a FROM ck)) GROUP BY 1, 2) GROUP BY 1"""))
def postings_positions(spark, sf):
    p = fts.postings(fx.chunks(spark, sf))
    return p.groupBy("lexeme").agg(F.count("*").alias("chunks"), F.sum("tf").alias("occurrences"), F.min(F.element_at("positions", 1)).cast("long").alias("first"))


@query("fts_match_websearch", fx.sql("ck", r"""SELECT chunk_id FROM (SELECT chunk_id, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS a FROM ck)
  WHERE (list_contains(a, 'the') AND list_contains(a, 'with') AND NOT list_contains(a, 'was')) OR list_contains(list_transform(range(1, len(a)), lambda i: a[i] = 'de' AND a[i + 1] = 'la'), true)"""))
def fts_match_websearch(spark, sf):
    return fts.evaluate(fts.postings(fx.chunks(spark, sf)), fts.parse_query('the with -was or "de la"'))


@query("fts_rank_and", fx.sql("ck", r"""SELECT chunk_id, round(greatest(1 - exp(sum(ln(1 - sqrt(0.01::DOUBLE * CASE WHEN abs(p - q) > 100 THEN 1e-30 ELSE 1.0 / (1.005 + 0.05 * exp(abs(p - q) / 1.5::DOUBLE - 2)) END)))), 1e-20), 9) AS rank
  FROM (SELECT chunk_id, p, unnest(qs) AS q FROM (SELECT chunk_id, unnest(ps) AS p, qs FROM (SELECT chunk_id, list_filter(range(1, len(a) + 1), lambda i: a[i] = 'by')[1:255] AS ps, list_filter(range(1, len(a) + 1), lambda i: a[i] = 'from')[1:255] AS qs
    FROM (SELECT chunk_id, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS a FROM ck)))) GROUP BY 1"""))
def fts_rank_and(spark, sf):
    return fts.rank_all(fts.postings(fx.chunks(spark, sf)), ["by", "from"])


@query("fts_english_stems")
def fts_english_stems(spark, sf):
    return fts.postings(fx.chunks(spark, sf).where("fts_config = 'english'"), "english").groupBy("lexeme").agg(F.count("*").alias("chunks"))


#: Inflected words of four languages; an index and a scan read them by their stems.
INFLECTED = '"the nations" or enables or eaux or heiten or ciones or mentes -lying'


@query("fts_topk_inflected")
def fts_topk_inflected(spark, sf):
    """Each row in its own language: inflected words find other forms of theirs."""
    return search.text_candidates(fx.chunks(spark, sf), INFLECTED)


@query("fts_stem_families")
def fts_stem_families(spark, sf):
    """Stems of each language with the forms that share them, of all chunks."""
    c = fx.chunks(spark, sf).select(fts.known(F.col("fts_config")).alias("fts_config"), F.explode(fts.tokens(F.col("content"))).alias("form"))
    forms = c.groupBy("fts_config", "form").agg(F.count("*").alias("n"))  # a form is stemmed once, not each of its places
    by = forms.withColumn("stem", stems.stemmed("form", "fts_config")).groupBy("fts_config", "stem")
    return by.agg(F.count("*").alias("forms"), F.sum("n").alias("occurrences"), F.max_by("form", F.struct("n", "form")).alias("commonest")).where("forms > 1")


@query("recall_by_source", _chain("tok", "cs AS (SELECT b.item_id AS case_id, b.text AS snippet, 'src' || b.item_id % 20 AS expected_source FROM benchmark b)", rf"""SELECT expected_source, count(*) AS cases, count(*) FILTER (ok)::BIGINT AS passed FROM (
  SELECT cs.case_id, expected_source, coalesce(bool_or(contains(lower(c.content), lower(snippet))), false) AS ok FROM cs LEFT JOIN (
    SELECT case_id, chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY rank DESC, chunk_id) AS rnk FROM (
      SELECT case_id, chunk_id, round(sum({_WEIGHT}) / any_value(n), 9) AS rank FROM (
        SELECT case_id, len(ws) AS n, unnest(ws) AS lexeme FROM (SELECT case_id, list_distinct(list_filter(string_split_regex(lower(snippet), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS ws FROM cs)) q JOIN tok USING (lexeme) GROUP BY 1, 2)) h
    ON h.case_id = cs.case_id AND rnk <= 10 LEFT JOIN ck c ON c.chunk_id = h.chunk_id GROUP BY 1, 2) GROUP BY 1"""))
def recall_by_source(spark, sf):
    """The recall of the search itself: the best ten chunks of each case's words."""
    b = fx.table(spark, sf, "benchmark")
    cases = b.select(F.col("item_id").alias("case_id"), F.col("text").alias("snippet"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("expected_source"))
    c = fx.chunks(spark, sf)
    found = search.batch_text(c, cases.select(F.col("case_id").alias("query_id"), F.col("snippet").alias("text")), limit=10)
    hits = found.join(c.select("chunk_id", "content"), "chunk_id").select(F.col("query_id").alias("case_id"), "content")
    return search.recall(hits, cases)


@query("vector_literals", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CAST(round(x::DOUBLE, 6) AS DECIMAL(18,6))::VARCHAR), ',') || ']' AS literal FROM embeddings")
def vector_literals(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", text.vector_literal(F.col("embedding")).alias("literal"))


@query("vector_topk_ivf")
def vector_topk_ivf(spark, sf):
    from skarn.operators import ivf

    c = fx.chunks(spark, sf)
    centres = ivf.fit(c, 32)
    return ivf.batch_search(ivf.assign(c, centres), centres, batch_vectors(spark, sf))


@query("vector_topk_pq")
def vector_topk_pq(spark, sf):
    """Every 20th vector against the codes of all; vectors are read for the best of them."""
    from skarn.operators import pq

    c = fx.chunks(spark, sf)
    books = pq.fit(c)
    return pq.batch_search(pq.encode(c, books), c, books, batch_vectors(spark, sf))


@query("vector_topk_pq_exact", _chain("ck", _VEC % "", "SELECT chunk_id, distance FROM va"))
def vector_topk_pq_exact(spark, sf):
    from skarn.operators import pq

    c = fx.chunks(spark, sf)
    books = pq.fit(c)
    return pq.exact(pq.encode(c, books), c, books, query_vector(spark, sf))
