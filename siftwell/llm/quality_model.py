"""Quality of documents by attention-based multiple-instance learning (gated attention, Ilse et al., 2018).

A document is a bag of passages of ``PASSAGE`` words, all of them. Every passage is encoded from its
own text, gated attention weighs the encodings, and the weighted sum is scored. Labels belong to
documents only; what makes a passage weigh is learned. Training uses at most ``most_labelled``
documents, those first in the order of a hash of their id; scores are computed in one pass over all.

Results for odd input: null and empty texts are one passage without words and get its score; labels
that are null or of unknown documents are passed over, of repeated labels the largest holds; repeated
rows are all scored; an empty table gives an empty result. Without labels of both kinds training
stops with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
MOST_LABELLED = 4_000
FEATURES = 20
# Byte classes: white space, upper case, lower case, digits, sentence marks, quotes and brackets, loud marks, symbols, line breaks, other.
CLASSES = {0: b" \t\r\f\v", 1: bytes(range(65, 91)), 2: bytes(range(97, 123)), 3: b"0123456789", 4: b".,;:-", 5: b"'\"()[]{}", 6: b"!?",
           7: b"#*$%&|<>@=+~^_/\\`", 8: b"\n"}
CLASS_OF = np.full(256, 9, dtype=np.uint8)
for _k, _b in CLASSES.items():
    CLASS_OF[list(_b)] = _k


def passage_features(text: str) -> np.ndarray:
    """One row per passage."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    kind = CLASS_OF[raw]
    blank = (kind == 0) | (kind == 8)
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(raw) else np.empty(0, dtype=np.int64)
    if not len(starts):
        return np.zeros((1, FEATURES), dtype=np.float32)
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    first = np.arange(0, len(starts), PASSAGE)
    at = starts[first]
    at[0] = 0
    lengths = ends - starts
    n_words = np.diff(np.append(first, len(starts))).astype(np.float32)
    n_bytes = np.diff(np.append(at, len(raw))).astype(np.float32)

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float32), first) / n_words

    split = text.split()  # may differ from the words above at rare white space, which is no matter here
    distinct = [len(set(split[k:k + PASSAGE])) / max(1, len(split[k:k + PASSAGE])) for k in first.tolist()]
    columns = [np.add.reduceat((kind == k).astype(np.float32), at) / n_bytes for k in range(1, 10)]
    columns += [
        by_word(lengths) / 10, by_word((lengths / 10.0) ** 2), by_word(lengths <= 3), by_word(lengths == 1), by_word(kind[starts] == 1),
        by_word(kind[ends - 1] == 4), by_word((kind[ends - 1] == 7) | (kind[ends - 1] == 6)), by_word(kind[ends - 1] == 1),
        np.array(distinct, dtype=np.float32), np.log1p(n_words) / 5, by_word(np.concatenate([lengths[1:] == lengths[:-1], [False]]))]
    return np.stack(columns, axis=1).astype(np.float32)


class Model(NamedTuple):
    """Scaling of features, the encoder, both arms of the gate, its weights, and the scoring layer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    t, g = np.tanh(h @ w["tanh_arm"]), _sigmoid(h @ w["gate_arm"])
    e = (t * g) @ w["attend"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["score"] + w["score_bias"])}


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the log loss, both labels with equal weight."""
    if len(set(labels.tolist())) < 2:
        raise ValueError("training needs labelled documents of both kinds")
    x = np.concatenate(bags).astype(np.float64)
    sizes = np.array([len(b) for b in bags])
    starts, bag = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(bags)), sizes)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    w = {"encode": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "encode_bias": np.zeros(hidden),
         "tanh_arm": rng.normal(0, 0.3, (hidden, gate)), "gate_arm": rng.normal(0, 0.3, (hidden, gate)), "attend": rng.normal(0, 0.3, gate),
         "score": rng.normal(0, 0.3, hidden), "score_bias": np.zeros(1)}
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
    for step in range(1, steps + 1):
        f = _forward(w, x, starts, bag)
        dp = (f["p"] - labels) * weight
        dz = dp[:, None] * w["score"]
        dh = f["a"][:, None] * dz[bag]
        da = (f["h"] * dz[bag]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[bag])
        gated = de[:, None] * w["attend"]
        dt, dg = gated * f["g"] * (1 - f["t"] ** 2), gated * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ w["tanh_arm"].T + dg @ w["gate_arm"].T
        pre = dh * (1 - f["h"] ** 2)
        grads = {"encode": x.T @ pre, "encode_bias": pre.sum(0), "tanh_arm": f["h"].T @ dt, "gate_arm": f["h"].T @ dg,
                 "attend": (f["t"] * f["g"]).T @ de, "score": f["z"].T @ dp, "score_bias": dp.sum(keepdims=True)}
        for k, grad in grads.items():
            grad = grad + decay * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def predict(model: Model, bags: list[np.ndarray]) -> np.ndarray:
    if not bags:
        return np.empty(0)
    sizes = np.array([len(b) for b in bags])
    starts, bag = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(bags)), sizes)
    return _forward(model.weights, (np.concatenate(bags) - model.mean) / model.scale, starts, bag)["p"]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = MOST_LABELLED) -> Model:
    """A model from at most ``most_labelled`` labelled documents outside the held-out quarter."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(chosen, "doc_id")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bags = [passage_features(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])

    rows = sample.select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(encode, "doc_id long, label int, bag binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["bag"])))
    return train([np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["label"] for r in rows]))


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                some = part.slice(at, 500)
                p = predict(model, [passage_features(t) for t in some.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
