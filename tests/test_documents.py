"""Chunks, vectors and page text."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.operators import documents as D
from siftwell.operators import pages as X
from siftwell.operators import vectors as Q


def brute_chunks(text, size=500, overlap=50):
    words, out, start = text.split(), [], 0
    while start < len(words):
        out.append(" ".join(words[start:start + size]))
        if start + size >= len(words):
            break
        start += max(1, size - overlap)
    return out


@pytest.mark.parametrize("size, overlap", [(500, 50), (7, 3), (5, 0), (4, 9)])
def test_chunks_like_brute_force(spark, size, overlap):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 3, 4, 5, 7, 8, 11, 499, 500, 501, 950, 951, 1400)] + ["  a\n b\t c "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in D.chunk_documents(df, "id", "text", size, overlap).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.content)
    assert got == {i: c for i, t in enumerate(texts) if (c := brute_chunks(t, size, overlap))}


def test_ingest_status(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " "), (4, "c")], "id long, text string")
    stored = spark.createDataFrame([("c", 99)], "t string, document long").select(F.sha2("t", 256).alias("content_hash"), "document")
    got = {r.id: (r.status, r.document) for r in D.ingest_documents(docs, stored, "id", "text").collect()}
    assert got == {1: ("ingested", 1), 2: ("already_exists", 1), 3: ("empty", 3), 4: ("already_exists", 99)}


def test_embedder_and_checks(spark):
    df = spark.createDataFrame([(1, "a bb"), (2, "ccc")], "id int, text string")
    vectors = D.embed(df, "text", lambda texts: pd.Series([[float(len(t)), 1.0] for t in texts]))
    assert [list(r.embedding) for r in vectors.orderBy("id").collect()] == [[4.0, 1.0], [3.0, 1.0]]
    assert D.check_vectors(vectors, 3).filter("problem = 'dimension mismatch'").count() == 2


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    corpus, queries = rng.normal(size=(300, 8)), rng.normal(size=(11, 8))
    corpus[5] = 0
    as_df = lambda m, name: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<double>")
    return corpus, queries, as_df(corpus, "vec_id").repartition(4), as_df(queries, "query_id")


@pytest.mark.parametrize("block", [2048, 3])
def test_exact_search(vectors, block):
    corpus, queries, c, q = vectors
    with np.errstate(invalid="ignore"):
        cosine = queries @ corpus.T / np.linalg.norm(queries, axis=1)[:, None] / np.linalg.norm(corpus, axis=1)[None, :]
    expected = {i: list(np.argsort(-np.nan_to_num(row, nan=-9))[:5]) for i, row in enumerate(cosine)}
    got = {}
    for r in Q.cosine_top_k(q, c, 5, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == expected


def test_zero_vector_comes_last(spark, vectors):
    _, queries, c, q = vectors
    few = c.filter("vec_id in (4, 5, 6)")
    rows = Q.cosine_top_k(q.filter("query_id = 0"), few, 3).orderBy("rank").collect()
    assert rows[-1].vec_id == 5 and rows[-1].score is None


def test_approximate_recall(vectors):
    _, _, c, q = vectors
    exact = {(r.query_id, r.vec_id) for r in Q.cosine_top_k(q, c, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in Q.approximate_top_k(q, c, 10).collect()}
    assert len(exact & near) >= 0.8 * len(exact)


def test_recall_and_share_of_the_index(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    queries = table.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in Q.cosine_top_k(queries, table, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in Q.approximate_top_k(queries, table, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    every = Q.approximate_top_k(queries, table, 10_000).count()
    assert every <= 0.6 * queries.count() * table.count()


@pytest.mark.parametrize("kind", ["clusters", "none"])
def test_recall_of_the_index(spark, tmp_path, kind, monkeypatch):
    """Recall of 0.9 with a fifth of the codes where there are clusters; without any, with all codes but few exact scores."""
    import numpy as np

    from siftwell.operators import vector_index as I

    monkeypatch.setattr(I, "PART_ROWS", 500)
    monkeypatch.setattr(I, "QUERY_BLOCK", 40)
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(12, 24)) * (2 if kind == "clusters" else 0)
    points = centres[pick.integers(0, 12, 3000)] + pick.normal(size=(3000, 24))
    corpus = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(9001, [0.0] * 24), (9002, [1.0]), (9003, None)], "vec_id long, embedding array<float>")
    queries = corpus.filter("vec_id % 30 = 0").withColumnRenamed("vec_id", "query_id")
    quantiser = I.train(corpus, cells=20, pieces=12, sample=2000)
    I.build(corpus, f"{tmp_path}/index", quantiser)
    probes = 4 if kind == "clusters" else 20
    near = I.search(queries, f"{tmp_path}/index", 10, probes)
    exact = {(r.query_id, r.vec_id): r.score for r in Q.cosine_top_k(queries, corpus, 10).collect()}
    rows = near.collect()
    assert len(rows) == 1000 and sum((r.query_id, r.vec_id) in exact for r in rows) >= 900
    assert all(abs(exact.get((r.query_id, r.vec_id), r.score) - r.score) < 1e-6 for r in rows)
    assert I.candidates(queries, f"{tmp_path}/index", probes, 80).count() == 8000  # of 300,000 pairs
    assert spark.read.parquet(f"{tmp_path}/index/lists").count() == 3000


def test_vectors_of_other_dimensions(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 1.0, 1.0]), (3, [])], "query_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in Q.cosine_top_k(queries, corpus, 50).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 2), (2, 3)]


def test_top_k_is_clamped():
    assert [Q.clamp_k(k) for k in (-1, 5, 99)] == [1, 5, 20]


PAGE = """<html><body><nav><a href='/x'>menu</a></nav><main><h1>Acme</h1><div class="card sponsored-box"><div>ad <b>one</b></div><div>ad two</div></div>
<aside><a href="tel:2125550100">call</a></aside><p>Text &amp; more</p><p>Text &amp; more</p><footer>foot</footer></main></body></html>"""


def test_nested_blocks_are_removed(spark):
    plain = PAGE.replace('<a href="tel:2125550100">call</a>', "noise")
    df = spark.createDataFrame([(1, PAGE), (2, plain), (3, "<body><p>a</p><script>x<y</script><p>b</p></body>")], "id int, html string")
    got = {r.id: r.l for r in df.select("id", X.unique_lines(X.main_text(F.col("html"))).alias("l")).collect()}
    assert got == {1: ["Acme", "call", "Text & more"], 2: ["Acme", "Text & more"], 3: ["a", "b"]}


def test_section_records(spark):
    html = "<h3>Locations</h3><ul><li>Main<br>1 Main St</li><li>Branch</li></ul><h3>Contacts</h3><p>Jane</p>"
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(X.section_records(F.col("html"), "Locations").alias("x")).collect()[0].x == [["Main", "1 Main St"], ["Branch"]]
