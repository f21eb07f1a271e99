"""Duplicate clusters: records that share any of several keys, directly or through others, and quality flags."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present
from ..session import cut_lineage


def connected_groups(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(id, cluster_id)`` for every end of ``(a, b)``; a cluster is named by its smallest id.

    Each round links every id with the smallest id it is linked with (large star), then the smaller
    neighbours of an id with their smallest (small star); both are aggregations and joins without
    collecting a group. The links are checkpointed, so a lost executor doesn't start over.
    """
    state = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen = mark
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.inline(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))))
        state = cut_lineage(small.filter("a <> b").distinct())
    else:
        raise RuntimeError(f"clusters did not settle in {most_rounds} rounds")
    return state.select(F.col("a").alias("id"), F.col("b").alias("cluster_id")).unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("cluster_id")).distinct())


def duplicate_clusters(records: DataFrame, key: str, shared: Sequence[str]) -> DataFrame:
    """``(key, cluster_id, cluster_size)`` for every record: records with an equal value in any of ``shared`` are one cluster.

    NULL and blank values link nothing. A value that very many records have gives one link a record, to
    the smallest of them.
    """
    def star(column: str) -> DataFrame:
        value = F.col(column).cast("string")
        told = records.filter(present(value)).select(F.col(key).alias("a"), value.alias("_value"))
        first = told.groupBy("_value").agg(F.min("a").alias("b"))
        return told.join(first, "_value").select("a", "b")

    groups = connected_groups(functools.reduce(DataFrame.union, [star(c) for c in shared]))
    named = records.select(key).join(groups.withColumnRenamed("id", key), key, "left").withColumn("cluster_id", F.coalesce("cluster_id", key))
    sizes = named.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return named.join(sizes, "cluster_id").select(key, "cluster_id", "cluster_size")


def quality_flags(records: DataFrame, clusters: DataFrame, key: str, verified: Column) -> DataFrame:
    """Records with ``is_duplicate`` (not the first of its cluster), ``has_duplicates`` and ``unverified``."""
    return records.join(clusters, key).withColumns({
        "is_duplicate": F.col("cluster_id") != F.col(key), "has_duplicates": F.col("cluster_size") > 1, "unverified": ~F.coalesce(verified, F.lit(False))})
