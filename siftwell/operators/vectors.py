"""Exact and approximate cosine search.

Scoring many vectors against a block of query vectors is a matrix product, which numpy does
far faster than expression trees. Spark partitions the corpus, every task keeps only the
``k`` best rows per query, and the small rest is ranked with a window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import top_rows

QUERY_BLOCK = 2048
CELLS = 1 << 19  # scores that a task holds at once, 4 MB


def clamp_k(k: int, most: int = 20) -> int:
    """``k`` between 1 and what the calling service allows."""
    return max(1, min(int(k), most))


def _cosine(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores, minus infinity where a vector has no length."""
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (queries @ vectors.T) / np.linalg.norm(queries, axis=1)[:, None] / np.linalg.norm(vectors, axis=1)[None, :]
    return np.where(np.isfinite(score), score, -np.inf)


def _best(score: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` best columns of every row, ties by id; a partition first cuts what has to be sorted."""
    if score.shape[1] > 4 * k:
        limit = -np.partition(-score, k - 1, axis=1)[:, k - 1:k]
        width = int((score >= limit).sum(axis=1).max())
        place = np.argsort(score < limit, axis=1, kind="stable")[:, :width]
        score, ids = np.take_along_axis(np.where(score >= limit, score, -np.inf), place, 1), np.take_along_axis(ids, place, 1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


_NAMES = ["query_id", "vec_id", "score"]
_RESULT = "query_id bigint, vec_id bigint, score double"


def _scan_top(blocks: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Function over the Arrow batches of a task: the ``k`` best corpus rows for every query of their dimension."""

    def run(batches):
        best = {}
        for batch in batches:
            lists = batch.column(1)
            sizes, ids = np.diff(lists.offsets.to_numpy()), batch.column(0).to_numpy(zero_copy_only=False)
            for size, (query_ids, matrix) in blocks.items():
                rows = np.flatnonzero(sizes == size)
                tile = max(64, CELLS // len(matrix))
                for at in range(0, len(rows), tile):
                    some = rows[at:at + tile]
                    fresh = _cosine(matrix, lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), size))
                    own = np.broadcast_to(ids[some], fresh.shape)
                    if size in best:
                        fresh, own = np.hstack([best[size][0], fresh]), np.hstack([best[size][1], own])
                    best[size] = _best(fresh, own, k)
        for size, (score, ids) in best.items():
            flat = score.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(blocks[size][0], score.shape[1])), pa.array(ids.ravel()), pa.array(flat, mask=~np.isfinite(flat))], names=_NAMES)

    return run


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the ``k`` nearest corpus vectors of every query vector.

    Queries are dealt to blocks of about ``block`` by a hash of their ids. One block at a time is
    shipped to the tasks that scan the corpus, so there is no shuffle but that of ``k`` rows per query
    and task, and the corpus is read once per block. Vectors meet those of their own dimension only; a
    zero vector has no score and comes last.
    """
    k = max(1, int(k))
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    stored = corpus.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding"))
    parts = max(1, -(-asked.count() // block))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    result = None
    for part in range(parts):
        by_size: dict[int, tuple[list, list]] = {}
        for r in dealt.filter(F.col("part") == part).collect():
            ids, rows = by_size.setdefault(len(r.embedding), ([], []))
            ids.append(r.query_id)
            rows.append(r.embedding)
        blocks = {n: (np.array(ids, dtype=np.int64), np.array(rows)) for n, (ids, rows) in by_size.items() if n}
        found = stored.mapInArrow(_scan_top(blocks, k), _RESULT)
        result = found if result is None else result.unionByName(found)
    return top_rows(result, ["query_id"], [F.col("score").desc_nulls_last(), F.col("vec_id")], k)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group, combined per position before it is put together."""
    parts = vectors.select(group, F.posexplode("embedding").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return whole.select(F.col(group).cast("bigint").alias("query_id"), F.transform("p", lambda p: p["x"]).alias("embedding"))


def cell_centres(vectors: DataFrame, cells: int, sample: int = 8192, rounds: int = 12) -> np.ndarray:
    """Directions of ``cells`` groups, by spherical k-means on at most ``sample`` vectors first in the order of a hash of their id."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    points = np.array([r.v for r in rows if r.v and any(r.v)])
    points /= np.linalg.norm(points, axis=1)[:, None]
    centres = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        length = np.linalg.norm(sums, axis=1)[:, None]
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def approximate_top_k(queries: DataFrame, corpus: DataFrame, k: int, cells: int = 64, probes: int = 36, salts: int = 8) -> DataFrame:
    """The ``k`` nearest vectors among those in the ``probes`` cells nearest to the query, ranked by exact cosine.

    Every corpus vector is in one cell, so about ``probes / cells`` of the corpus are candidates of a
    query. The default is set for vectors without clusters, which need more than half of the cells for a
    recall of 0.9; clustered ones need few. Cells meet by an equi-join on cell and salt, so that a cell which holds a large part of the
    corpus is dealt to ``salts`` tasks; each pair of a query and a vector meets once.
    """
    centres = cell_centres(corpus, cells)

    def near(count: int):
        def run(values: pd.Series) -> pd.Series:
            scores = np.array(values.tolist(), dtype=np.float64) @ centres.T
            return pd.Series(np.argsort(-scores, axis=1, kind="stable")[:, :count].tolist())

        return F.pandas_udf(run, "array<int>")

    size = centres.shape[1]
    left = queries.filter(F.size("embedding") == size).select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("a"))
    left = left.withColumn("cell", F.explode(near(probes)("a"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = corpus.filter(F.size("embedding") == size).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("b"))
    right = right.withColumns({"cell": F.get(near(1)("b"), F.lit(0)), "salt": F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")})

    def product(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    right = right.withColumn("b_length", F.sqrt(product("b", "b"))).filter("b_length > 0")
    left = left.withColumn("a_length", F.sqrt(product("a", "a"))).filter("a_length > 0")
    scored = right.join(left, ["cell", "salt"]).select("query_id", "vec_id", (product("a", "b") / F.col("a_length") / F.col("b_length")).alias("score"))
    return top_rows(scored, ["query_id"], [F.col("score").desc(), F.col("vec_id")], max(1, int(k)))


def semantic_search(queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int, where: Column | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """The nearest chunks with their text and the title of their document.

    ``chunks(chunk_id, document_id, content, embedding)``, ``documents(document_id, title, ...)``; ``where``
    is a condition on the documents, which restricts the search before it ranks.
    """
    chosen = documents if where is None else documents.filter(where)
    searched = chunks if where is None else chunks.join(chosen.select("document_id"), "document_id", "left_semi")
    top = cosine_top_k(queries, searched.select(F.col("chunk_id").alias("vec_id"), "embedding"), k, block).withColumnRenamed("vec_id", "chunk_id")
    found = searched.select("chunk_id", "document_id", "content").join(top, "chunk_id")
    return found.join(chosen.select("document_id", "title"), "document_id").select("query_id", "rank", "chunk_id", "document_id", "title", "content", "score")
