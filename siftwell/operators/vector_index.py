"""A vector index: inverted lists with residual product quantisation and exact re-ranking.

A coarse quantiser gives every vector a cell; what is left of it after its cell's centre is cut into
pieces, and each piece is named by the nearest of at most 256 learned ones: one byte a piece. The index
is written once, partitioned by cell, with the code and the vector of every row. A query reads the codes
of its nearest cells only. Its scores come from tables (one product per piece and learned piece, then
additions), the best ``rerank`` rows of each query are read again and ranked by exact cosine.

The quantisers are fitted on at most ``sample`` vectors, first in the order of a hash of their id; every
vector is indexed. Vectors of another dimension and vectors without length are left out.
"""

from __future__ import annotations

import dataclasses
import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import top_rows

PART_ROWS = 100_000  # codes that one task holds
QUERY_BLOCK = 2048  # queries that one task scores together
CODES = 256


@dataclasses.dataclass
class Quantiser:
    """``centres`` of the cells, and per piece of the dimensions the learned pieces."""

    centres: np.ndarray
    pieces: list[np.ndarray]

    @property
    def edges(self) -> list[int]:
        return np.cumsum([0] + [p.shape[1] for p in self.pieces]).tolist()

    def cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each unit vector, nearest first."""
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :n]

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest, out = x - self.centres[cell], np.empty((len(x), len(self.pieces)), dtype=np.uint8)
        for m, (piece, low, high) in enumerate(zip(self.pieces, self.edges, self.edges[1:])):
            out[:, m] = _nearest(rest[:, low:high], piece)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """``(query, piece, code)``: the product of a query's part with a learned piece."""
        out = np.zeros((len(queries), len(self.pieces), CODES), dtype=np.float32)
        for m, (piece, low, high) in enumerate(zip(self.pieces, self.edges, self.edges[1:])):
            out[:, m, :len(piece)] = queries[:, low:high] @ piece.T
        return out

    def to_json(self) -> str:
        return json.dumps({"centres": self.centres.tolist(), "pieces": [p.tolist() for p in self.pieces]})

    @classmethod
    def from_json(cls, text: str) -> Quantiser:
        read = json.loads(text)
        return cls(np.array(read["centres"]), [np.array(p) for p in read["pieces"]])


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)


def _k_means(points: np.ndarray, k: int, rounds: int, unit: bool) -> np.ndarray:
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        near = (points @ centres.T).argmax(axis=1) if unit else _nearest(points, centres)
        sums, count = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, points)
        sums = sums / np.linalg.norm(sums, axis=1).clip(1e-12)[:, None] if unit else sums / count.clip(1)[:, None]
        centres = np.where((count > 0)[:, None], sums, centres)
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def train(vectors: DataFrame, cells: int = 64, pieces: int = 32, sample: int = 16_384, rounds: int = 10) -> Quantiser:
    """Fit the quantisers on a bounded sample; the dimension is that of its first vector with length."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("exists(v, x -> x <> 0)")
    rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    if not rows:
        raise ValueError("no vector to learn from")
    x = _unit(np.array([r.v for r in rows if len(r.v) == len(rows[0].v)]))
    centres = _k_means(x, cells, rounds, unit=True)
    rest = x - centres[(x @ centres.T).argmax(axis=1)]
    return Quantiser(centres, [_k_means(part, CODES, rounds, unit=False) for part in np.array_split(rest, min(pieces, x.shape[1]), axis=1)])


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _usable(embedding: str, size: int) -> Column:
    return (F.size(embedding) == size) & F.exists(embedding, lambda x: x != 0)


def build(vectors: DataFrame, folder: str, quantiser: Quantiser) -> None:
    """Write the index of ``(vec_id, embedding)`` below ``folder``; a cell of many vectors is cut into parts of bounded size."""
    spark, size = vectors.sparkSession, quantiser.centres.shape[1]
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter(_usable("embedding", size))

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                x = _unit(_matrix(part.column(1), part.num_rows))
                cell = quantiser.cells(x, 1)[:, 0]
                codes = [c.tobytes() for c in quantiser.codes(x, cell)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(codes, pa.binary())],
                                                 names=["vec_id", "embedding", "cell", "code"])

    coded = rows.mapInArrow(encode, "vec_id long, embedding array<float>, cell int, code binary")
    parts = 1 + F.floor(F.count("*") / PART_ROWS)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(16))  # several files a cell, so that a large one is written by several tasks
    coded.repartition("cell", spread).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/lists")
    spark.read.parquet(f"{folder}/lists").groupBy("cell").agg(parts.cast("int").alias("parts"), F.count("*").alias("vectors")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
    spark.createDataFrame([(quantiser.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/quantiser")


def load_quantiser(spark: SparkSession, folder: str) -> Quantiser:
    return Quantiser.from_json(spark.read.text(f"{folder}/quantiser").first()["value"])


def _best_codes(quantiser: Quantiser, keep: int, key: tuple, codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The ``keep`` best rows of one part of a cell for every query that asks for the cell, by table look-ups."""
    out = pd.DataFrame({"query_id": [], "vec_id": [], "near": []}).astype({"query_id": "int64", "vec_id": "int64", "near": "float64"})
    if not len(codes) or not len(queries):
        return out
    cell = int(key[0])
    code = np.frombuffer(b"".join(codes["code"]), dtype=np.uint8).reshape(len(codes), -1)
    ids, asked = codes["vec_id"].to_numpy(), np.array(queries["q"].tolist(), dtype=np.float64)
    found = []
    step = max(1, (1 << 22) // len(codes))
    for at in range(0, len(asked), step):
        some = asked[at:at + step]
        table = quantiser.tables(some)
        score = np.repeat((some @ quantiser.centres[cell]).astype(np.float32)[:, None], len(codes), axis=1)
        for m in range(code.shape[1]):
            score += table[:, m, code[:, m]]
        top = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if len(codes) > keep else np.tile(np.arange(len(codes)), (len(some), 1))
        found.append(pd.DataFrame({"query_id": np.repeat(queries["query_id"].to_numpy()[at:at + step], top.shape[1]), "vec_id": ids[top.ravel()],
                                   "near": np.take_along_axis(score, top, 1).ravel().astype(np.float64)}))
    return pd.concat(found, ignore_index=True)


def probed(queries: DataFrame, quantiser: Quantiser, probes: int) -> DataFrame:
    """``(query_id, q, cell)``: every usable query at unit length with each of its nearest cells."""
    size = quantiser.centres.shape[1]
    rows = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter(_usable("embedding", size))

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                x = _unit(_matrix(part.column(1), part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(quantiser.cells(x, probes).tolist(), pa.list_(pa.int32()))],
                                                 names=["query_id", "q", "cells"])

    return rows.mapInArrow(near, "query_id long, q array<double>, cells array<int>").select("query_id", "q", F.explode("cells").alias("cell"))


def candidates(queries: DataFrame, folder: str, probes: int, rerank: int) -> DataFrame:
    """``(query_id, vec_id, cell, near)``: the ``rerank`` best rows of each query by their codes."""
    spark = queries.sparkSession
    quantiser = load_quantiser(spark, folder)
    cells = spark.read.parquet(f"{folder}/cells")
    asked = probed(queries, quantiser, probes)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = asked.join(F.broadcast(cells), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "query_id", "q")
    lists = spark.read.parquet(f"{folder}/lists").select("cell", "vec_id", "code").join(F.broadcast(cells), "cell")
    lists = lists.select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "code")
    key = ["cell", "part", "block"]
    scan = functools.partial(_best_codes, quantiser, rerank)

    def search(key, codes, queries):
        return scan(key, codes, queries).assign(cell=int(key[0]))

    near = lists.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, near double, cell int")
    return top_rows(near, ["query_id"], [F.col("near").desc(), F.col("vec_id")], rerank).drop("rank")


def search(queries: DataFrame, folder: str, k: int, probes: int = 40, rerank: int | None = None) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the ``k`` best of the candidates by exact cosine.

    ``rerank`` candidates are scored exactly for each query (by default eight for each of the ``k``). The
    default of ``probes`` is for 64 cells and vectors without clusters; where there are clusters a few do.
    """
    k = max(1, int(k))
    found = candidates(queries, folder, probes, max(rerank or 8 * k, k)).select("query_id", "vec_id", "cell")
    lists = queries.sparkSession.read.parquet(f"{folder}/lists").select("cell", "vec_id", F.col("embedding").cast("array<double>").alias("b"))
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("a"))

    def product(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    pairs = lists.join(found, ["cell", "vec_id"]).join(asked, "query_id")
    scored = pairs.select("query_id", "vec_id", (product("a", "b") / F.sqrt(product("a", "a")) / F.sqrt(product("b", "b"))).alias("score"))
    return top_rows(scored, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
