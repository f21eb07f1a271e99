"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``seed`` tokens: the runs of all documents are joined with those of the benchmark,
which yields the pairs of document and item to look at. Each pair is tiled: the longest common runs
of tokens not yet covered are found by Karp-Rabin hashing and marked, again and again down to
``seed`` tokens, so moved sentences of an item still count. An item is in a document if its tiles
cover at least ``coverage`` of its tokens.

Tokens are runs of letters and digits in lower case. Results for odd input: null and empty texts
match nothing, nor do items with fewer than ``seed`` tokens; repeated rows are each judged; an empty
table on either side gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, row_key, shingles

BASE = np.uint64(0x9E3779B97F4A7C15)
MARK = "decontaminate_row_mark"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _window_hashes(prefix: np.ndarray, power: np.uint64, size: int) -> np.ndarray:
    return prefix[size:] - prefix[:-size] * power


def _prefix(ids: np.ndarray) -> np.ndarray:
    """Rolling polynomial hashes, modulo 2^64, of all prefixes."""
    out = np.zeros(len(ids) + 1, dtype=np.uint64)
    value, base, mask = 0, int(BASE), (1 << 64) - 1
    for i, x in enumerate(ids.tolist()):
        value = (value * base + x + 1) & mask
        out[i + 1] = value
    return out


def _longest(free_a: np.ndarray, free_b: np.ndarray, a: np.ndarray, b: np.ndarray, i: int, j: int, size: int) -> int:
    while i + size < len(a) and j + size < len(b) and free_a[i + size] and free_b[j + size] and a[i + size] == b[j + size]:
        size += 1
    return size


def tile(item: list[str], document: list[str], shortest: int) -> list[tuple[int, int, int]]:
    """Tiles ``(item start, document start, tokens)``: no token of either side is in two tiles."""
    names: dict[str, int] = {}
    a = np.array([names.setdefault(w, len(names)) for w in item], dtype=np.int64)
    b = np.array([names.setdefault(w, len(names)) for w in document], dtype=np.int64)
    free_a, free_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
    hash_a, hash_b = _prefix(a), _prefix(b)
    found: list[tuple[int, int, int]] = []
    size = max(shortest, min(len(a), len(b)) // 2)
    while size >= shortest:
        power = np.uint64(pow(int(BASE), size, 1 << 64))
        matches = []
        if len(a) >= size and len(b) >= size:
            wa, wb = _window_hashes(hash_a, power, size), _window_hashes(hash_b, power, size)
            whole_a = np.convolve(free_a, np.ones(size, dtype=int), "valid") == size
            whole_b = np.convolve(free_b, np.ones(size, dtype=int), "valid") == size
            places = np.flatnonzero(whole_b & np.isin(wb, wa[whole_a]))
            by_hash: dict[int, list[int]] = {}
            for j in places.tolist():
                by_hash.setdefault(int(wb[j]), []).append(j)
            for i in np.flatnonzero(whole_a).tolist():
                for j in by_hash.get(int(wa[i]), ()):
                    if np.array_equal(a[i:i + size], b[j:j + size]):
                        matches.append((_longest(free_a, free_b, a, b, i, j, size), i, j))
        for length, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if free_a[i:i + length].all() and free_b[j:j + length].all():
                free_a[i:i + length] = free_b[j:j + length] = False
                found.append((i, j, length))
        size = size // 2 if size // 2 > shortest or size == shortest else shortest
    return found


def seed_pairs(docs: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """``(key, item_id)`` for every document and item that share a run of ``seed`` tokens."""
    wanted = items.filter(F.size("item_tokens") >= seed).select(
        "item_id", F.explode(F.array_distinct(shingles(F.col("item_tokens"), seed))).alias("run")).distinct()
    runs = docs.select(*KEY, F.explode(shingles(tokens(F.col("text")), seed)).alias("run"))
    return runs.join(wanted, "run").select(*KEY, "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.6,
                 doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_tiles, tiled_tokens, item_tokens, coverage)`` for every pair at or above the threshold."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("item_tokens"))
    pairs = seed_pairs(docs, items, seed)
    found = docs.join(pairs, KEY).withColumnRenamed("item_id", "found_id")
    rows = found.join(items, F.col("found_id").eqNullSafe(F.col("item_id"))).select("doc_id", "item_id", "item_tokens", tokens(F.col("text")).alias("doc_tokens"))

    def tiled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [tile(list(i), list(d), seed) for i, d in zip(part["item_tokens"], part["doc_tokens"])]
            yield pd.DataFrame({"doc_id": part["doc_id"], "item_id": part["item_id"], "n_tiles": [len(f) for f in found],
                                "tiled_tokens": [sum(t[2] for t in f) for f in found], "item_tokens": part["item_tokens"].map(len)})

    types = rows.schema
    counted = rows.mapInPandas(tiled, f"doc_id {types['doc_id'].dataType.simpleString()}, item_id {types['item_id'].dataType.simpleString()}, "
                                      "n_tiles long, tiled_tokens long, item_tokens long")
    share = F.col("tiled_tokens") / F.col("item_tokens")
    return counted.withColumn("coverage", share).filter(F.col("coverage") >= coverage)


def keep_clean(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.6) -> DataFrame:
    """The documents that hold no benchmark item, all columns unchanged."""
    rows = docs.withColumn(MARK, F.concat_ws("/", *row_key()))
    found = contaminated(rows.select(MARK, "text"), benchmark, seed, coverage, doc_id=MARK)
    return rows.join(found.select(F.col("doc_id").alias(MARK)).distinct(), MARK, "left_anti").select(docs.columns)
