"""SimHash near-duplicates, joined through a vantage-point tree over Hamming distance.

The upper levels of the tree are Spark's: every distinct fingerprint goes to the shard named by its
distances to a few vantage points. Two fingerprints at most ``radius`` bits apart differ by at most
``radius`` in each of these distances (triangle bound), so a fingerprint also visits the shards
within that bound, each pair of shards in one direction only. The lower levels are built inside a
shard, where shells by distance to a point of the shard are pruned by the same bound.

Results for odd input: a null or empty text has fingerprint zero and is linked like any other; rows
with the same id are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, components, shingles, stored, words

BLOCK = 1 << 18
SHARD_ROWS = 200_000
SHELLS = 14  # how many shells a vantage point divides evenly spread fingerprints into, in effect


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def majority_bits(hashes: pa.ListArray) -> np.ndarray:
    """One fingerprint per list: a bit is set if more than half of the list's hashes have it."""
    lengths = np.diff(hashes.offsets.to_numpy())
    values = hashes.flatten().to_numpy().view(np.uint64)
    result, full = np.zeros(len(lengths), dtype=np.uint64), np.flatnonzero(lengths)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        for bit in range(64):
            ones = np.add.reduceat(((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
            result[full] |= (2 * ones > lengths[full]).astype(np.uint64) << np.uint64(bit)
    return result


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``(doc_id, key_text, bits)``: 64-bit SimHash of the word shingles, repeats counted, as a signed long."""
    tokens = words(F.translate(F.col(text), UPPER, LOWER))
    hashed = shingles(tokens, size, lambda *run: F.xxhash64(F.concat_ws(" ", *run)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("key_text"), hashed.alias("hashes"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bits = majority_bits(part.column("hashes")).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bits)], names=["doc_id", "key_text", "bits"])

    return rows.mapInArrow(batches, "doc_id long, key_text long, bits long")


def _close_pairs(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, same: bool, radius: int) -> Iterator[tuple]:
    """Index pairs at most ``radius`` bits apart; ``same``: both sides are one set, each pair once."""
    if len(a) * len(b) > BLOCK:
        point = a[len(a) // 2]
        da, db = np.bitwise_count(a ^ point), np.bitwise_count(b ^ point)
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        ea, eb = np.searchsorted(da[oa], np.arange(66)), np.searchsorted(db[ob], np.arange(66))
        if max(np.diff(ea).max() / len(a), np.diff(eb).max() / len(b)) < 0.9:
            for d in range(65):
                if ea[d] == ea[d + 1]:
                    continue
                pa_ = oa[ea[d]:ea[d + 1]]
                for e in range(d if same else max(0, d - radius), min(64, d + radius) + 1):
                    if eb[e] < eb[e + 1]:
                        pb = ob[eb[e]:eb[e + 1]]
                        yield from _close_pairs(a[pa_], b[pb], ia[pa_], ib[pb], same and d == e, radius)
            return
    step = max(1, BLOCK // max(1, len(b)))
    for start in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[start:start + step, None] ^ b[None, :]) <= radius)
        i, j = ia[i + start], ib[j]
        keep = i < j if same else i != j
        if keep.any():
            yield i[keep], j[keep]


def spanning_links(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within ``radius`` connect: at most one per fingerprint."""
    values = np.concatenate([home, visitors])
    parent = np.arange(len(values))
    links: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    ih, iv = np.arange(len(home)), np.arange(len(home), len(values))
    for pairs in (_close_pairs(home, home, ih, ih, True, radius), _close_pairs(home, visitors, ih, iv, False, radius)):
        for i, j in pairs:
            apart = parent[i] != parent[j]
            for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                tx, ty = top(x), top(y)
                if tx != ty:
                    parent[max(tx, ty)] = min(tx, ty)
                    links.append((x, y))
    found = np.array(links, dtype=np.int64).reshape(-1, 2)
    return values[found[:, 0]], values[found[:, 1]]


def close_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``(a, b)``: links that span all groups of fingerprints connected within ``radius`` bits.

    ``distinct`` has one row per fingerprint in ``bits``. The depth of the upper tree follows the
    logarithm of their number, so that a shard stays at some ``SHARD_ROWS`` fingerprints; the
    vantage points are a bounded sample of one fingerprint per level.
    """
    depth, left = 2, distinct.count() / SHARD_ROWS
    while left > SHELLS**depth:
        depth += 1
    points = [r.bits for r in distinct.orderBy(F.xxhash64("bits"), "bits").limit(depth).collect()]
    if not points:
        return distinct.select(F.col("bits").alias("a"), F.col("bits").alias("b"))

    def distance(point: int) -> Column:
        return F.bit_count(F.col("bits").bitwiseXOR(F.lit(point)))

    offsets: list[tuple[int, ...]] = [()]
    for _ in points:
        offsets = [o + (k,) for o in offsets for k in range(-radius, radius + 1)]
    offsets = [o for o in offsets if o >= (0,) * len(points)]
    visits = F.explode(F.array(*[
        F.struct(F.concat_ws("/", *[distance(p) + k for p, k in zip(points, o)]).alias("shard"), F.lit(any(o)).alias("visitor"))
        for o in offsets]))
    dealt = distinct.select("bits", visits.alias("v")).select("v.shard", "v.visitor", "bits")

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        bits, visitor = shard["bits"].to_numpy().view(np.uint64), shard["visitor"].to_numpy()
        a, b = spanning_links(bits[~visitor], bits[visitor], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def grouped_prints(docs: DataFrame, doc_id: str, text: str, size: int, radius: int) -> DataFrame:
    """``(doc_id, key_text, bits, component_id)`` for every row."""
    prints = stored(fingerprints(docs, doc_id, text, size), "fingerprints")
    distinct = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("low")), "distinct")
    roots = stored(components(close_links(distinct, radius)), "roots")
    linked = roots.join(distinct, roots.node == distinct.bits).select("bits", "root", "low")
    lowest = linked.groupBy("root").agg(F.min("low").alias("group_low"))
    named = distinct.join(linked.join(lowest, "root").select("bits", "root", "group_low"), "bits", "left").select(
        "bits", F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("group_low")).alias("component_id"))
    return prints.join(named, "bits")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` bits; rows whose
    id is null belong to groups as well but never name one.
    """
    return grouped_prints(docs, doc_id, text, size, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
