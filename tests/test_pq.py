"""Product-quantised vectors against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn import api
from skarn.operators import pq, search
from skarn.sources.store import Store


def vectors_of(spark, sf):
    return spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")


def every_20th(e):
    return e.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


def pairs(df):
    return {(r.query_id, r.chunk_id) for r in df.collect()}


@pytest.mark.parametrize(("codes", "dims"), [(256, 4), (32, 4), (256, 8)])
def test_recall_against_all_rows(spark, codes, dims):
    """Coarse codes as well: what a large table has against a bounded sample."""
    e = vectors_of(spark, "0.1")
    books = pq.fit(e, dims, codes)
    coded = pq.encode(e, books).drop("embedding").cache()
    assert coded.where("code is null").isEmpty() and coded.select(F.length("code")).first()[0] == 64 // dims
    want = pairs(search.batch_nearest(e, every_20th(e), limit=10))
    assert len(want & pairs(pq.batch_search(coded, e, books, every_20th(e), limit=10))) >= 0.9 * len(want)


def test_batch_equals_single_and_blocks_do_not_matter(spark, monkeypatch):
    e = vectors_of(spark, "0.001")
    books = pq.fit(e, codes=32)
    coded = pq.encode(e, books).drop("embedding").cache()
    rows = lambda df: sorted((r.query_id, r.rnk, r.chunk_id, r.distance) for r in df.collect())
    whole = rows(pq.batch_search(coded, e, books, every_20th(e), limit=5))
    monkeypatch.setattr(pq, "BLOCK", 37)
    monkeypatch.setattr(pq, "ASKED", 4)
    assert rows(pq.batch_search(coded, e, books, every_20th(e), limit=5, slots=3)) == whole
    for r in every_20th(e).where("query_id % 100 = 0").collect():
        one = pq.search(coded, e, books, list(r.vector), limit=5).orderBy("distance", "chunk_id").collect()
        assert [c for q, _, c, _ in whole if q == r.query_id] == [x.chunk_id for x in one]


@pytest.mark.parametrize("codes", [2, 256])
def test_exact_is_the_scan(spark, codes):
    """Even two codes a part, where the scores say little."""
    e = vectors_of(spark, "0.001")
    books = pq.fit(e, codes=codes)
    coded = pq.encode(e, books).drop("embedding").cache()
    for r in every_20th(e).limit(4).collect():
        want = search.vector_candidates(e, list(r.vector), limit=3).collect()
        assert sorted(pq.exact(coded, e, books, list(r.vector), 3).collect()) == sorted(want)


def test_nulls_ties_odd_widths_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0, 2.0]), (2, [1.0, 0.0, 0.0, 0.0, 2.0]), (3, None), (4, [-1.0, 0.0, 3.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0, 0.5, 0.0])]
    e = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("vector", F.lit(1))
    books = pq.fit(e)
    assert books.shape == (2, 4, 4)
    coded = pq.encode(e, books)
    held = {r.chunk_id: (r.code, r.err) for r in coded.collect()}
    assert held[3] == (None, None) and held[1] == held[2] and held[1][1] < 1e-6
    q = [1.0, 0.0, 0.0, 0.0, 2.0]
    assert [r.chunk_id for r in pq.search(coded, e, books, q, 2).collect()] == [1, 2] == [r.chunk_id for r in pq.exact(coded, e, books, q, 2).collect()]
    assert [r.chunk_id for r in pq.exact(coded, e, books, q, 9).orderBy("distance", "chunk_id").collect()] == [1, 2, 5, 4]  # fewer rows than asked for
    asked = spark.createDataFrame([(7, q), (8, None)], "query_id long, vector array<double>")
    assert [(r.query_id, r.rnk, r.chunk_id) for r in pq.batch_search(coded, e, books, asked, 2).orderBy("rnk").collect()] == [(7, 1, 1), (7, 2, 2)]
    for none in (pq.batch_search(coded.limit(0), e, books, asked, 2), pq.batch_search(coded, e, books, asked.limit(0), 2), pq.exact(coded.limit(0), e, books, q, 2)):
        assert none.isEmpty()


def test_a_store_keeps_codes_and_no_second_copy_of_the_vectors(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    chunks = spark.createDataFrame([(i, i, 1, f"u{i}", "", 0, f"text {i}", [float(y) for y in v], "simple") for i, v in enumerate(x)], api.CHUNKS)
    sources = spark.createDataFrame([(1, "a", "https://a.dev/", "active", "crawl")], "id int, name string, base_url string, status string, source_type string")
    s.commit({"chunks": chunks, "sources": sources})
    plain = {q: [r.chunk_id for r in api.search_chunks(s, "zzz", embedder=lambda _: [x[q].tolist()]).collect()] for q in (5, 400)}
    api.index(s, cells=3)
    cells = s.read("cells")
    assert "embedding" not in cells.columns and cells.where("length(code) = 4 and err >= 0").count() == 600
    for q, want in plain.items():
        assert [r.chunk_id for r in api.search_chunks(s, "zzz", embedder=lambda _: [x[q].tolist()]).collect()] == want


@pytest.mark.parametrize("held", [1, 10**9])
def test_pairs_of_blocks_keep_the_best(monkeypatch, held):
    """Many small blocks in one task, with and without early output."""
    monkeypatch.setattr(pq, "HELD", held)
    monkeypatch.setattr(pq, "BLOCK", 7)
    rng = np.random.default_rng(2)
    books, codes, q = rng.normal(size=(2, 8, 4)), rng.integers(0, 8, (60, 2)).astype(np.uint8), rng.normal(size=(3, 8))
    dealt = list(pq._dealt(3)([pa.record_batch({"chunk_id": np.arange(60), "code": [c.tobytes() for c in codes]})]))
    assert sorted(i for b in dealt for i in np.frombuffer(b.column("ids")[0].as_py(), np.int64)) == list(range(60)) and len(dealt) > 8
    asked = list(pq._asked([pa.record_batch({"query_id": np.arange(3), "vector": q.tolist()})]))[0]
    pairs = [pa.record_batch({c: pa.concat_arrays([b.column(c) if c in b.schema.names else asked.column(c) for b in dealt]) for c in ("ids", "codes", "query_ids", "vectors")})]
    got = pa.Table.from_batches(list(pq._best_of_pairs(books, 5)(pairs))).to_pylist()
    score = pq._parts(q, 4).reshape(3, -1) @ pq._decoded(codes, books).T
    assert (len(got) == 15) == (held > 1)
    for k in range(3):
        mine = sorted((-r["score"] for r in got if r["query_id"] == k))[:5]
        assert np.allclose(mine, np.sort(-score[k])[:5])
