"""Ordered computations inside groups that may be very large.

A plain window sends a whole group to one task. Here every group is cut into buckets of its
leading order column (a day, a block of ordinals). The window runs inside ``(keys, bucket)``,
one small row per bucket is aggregated with map-side combine, a window over those rows gives
what the earlier buckets contribute, and an equi-join on ``(keys, bucket)`` adds it. The
result is the same as the plain window; the largest sort is one bucket, not one group.

Keys and bucket must not be NULL. ``order`` must be a total order inside a bucket, and
buckets must be increasing in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BUCKET = "_bucket"


def day_bucket(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def block_bucket(ordinal: Column, size: int = 65536) -> Column:
    return F.floor(ordinal / F.lit(size)).cast("bigint")


def _windows(keys: Sequence[str], order: Sequence[Column]):
    inside = W.partitionBy(*keys, _BUCKET).orderBy(*order)
    buckets = W.partitionBy(*keys).orderBy(_BUCKET)
    return inside, buckets.rowsBetween(W.unboundedPreceding, -1)


def _join_tails(local: DataFrame, tails: DataFrame, keys: Sequence[str]) -> DataFrame:
    return local.join(tails, [*keys, _BUCKET], "left")


def number_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of every row in its group."""
    base = df.withColumn(_BUCKET, bucket)
    inside, before = _windows(keys, order)
    tails = base.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    tails = tails.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = _join_tails(base.withColumn("_local", F.row_number().over(inside)), tails, keys)
    return out.withColumn(name, (F.col("_local") + F.col("_offset")).cast("bigint")).drop("_local", "_offset", _BUCKET)


def running_sum(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                sums: dict[str, Column]) -> DataFrame:
    """Running totals up to and including the row, one per entry of ``sums``."""
    base = df.withColumn(_BUCKET, bucket)
    inside, before = _windows(keys, order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    tails = base.groupBy(*keys, _BUCKET).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    tails = tails.select(*keys, _BUCKET, *[F.sum(f"_t_{n}").over(before).alias(f"_b_{n}") for n in sums])
    local = base.withColumns({f"_l_{n}": F.sum(v).over(upto) for n, v in sums.items()})
    out = _join_tails(local, tails, keys)
    total = {n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n in sums}
    return out.withColumns(total).drop(*[f"_l_{n}" for n in sums], *[f"_b_{n}" for n in sums], _BUCKET)


def carry_forward(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                  columns: dict[str, Column], before: str | None = None) -> DataFrame:
    """Latest non-NULL value up to and including the row, for every entry of ``columns``.

    ``before`` names an extra column: a struct of the same values as they were on the row
    before, NULL on the first row of a group.
    """
    base = df.withColumn(_BUCKET, bucket)
    inside, earlier = _windows(keys, order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    position = F.struct(*order)
    tails = base.groupBy(*keys, _BUCKET).agg(
        *[F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_t_{n}") for n, v in columns.items()])
    tails = tails.select(*keys, _BUCKET, F.lag(F.lit(True)).over(earlier_order(keys)).alias("_earlier"),
                         *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in columns])
    local = base.withColumns({f"_l_{n}": F.last(v, ignorenulls=True).over(upto) for n, v in columns.items()})
    if before:
        local = local.withColumn("_prev", F.lag(F.struct(*[F.col(f"_l_{n}") for n in columns])).over(inside))
    out = _join_tails(local, tails, keys)
    value = {n: F.coalesce(f"_l_{n}", f"_b_{n}") for n in columns}
    if before:
        carried = F.struct(*[F.coalesce(F.col("_prev")[f"_l_{n}"], F.col(f"_b_{n}")).alias(n) for n in columns])
        value[before] = F.when(F.col("_prev").isNotNull() | F.col("_earlier"), carried)
        out = out.withColumn(before, value.pop(before))
    return out.withColumns(value).drop(*[f"_l_{n}" for n in columns], *[f"_b_{n}" for n in columns], "_earlier", "_prev", _BUCKET)


def earlier_order(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy(_BUCKET)


def previous_values(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                    columns: dict[str, Column]) -> DataFrame:
    """Values of the row before, NULL on the first row of a group."""
    base = df.withColumn(_BUCKET, bucket)
    inside, before = _windows(keys, order)
    row = F.struct(*[v.alias(n) for n, v in columns.items()])
    tails = base.groupBy(*keys, _BUCKET).agg(F.max_by(row, F.struct(*order)).alias("_t"))
    tails = tails.select(*keys, _BUCKET, F.last("_t", ignorenulls=True).over(before).alias("_b"))
    out = _join_tails(base.withColumn("_l", F.lag(row).over(inside)), tails, keys)
    prev = F.coalesce("_l", "_b")
    return out.withColumns({n: prev[n] for n in columns}).drop("_l", "_b", _BUCKET)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group. With a constant ``k`` Spark keeps only ``k`` rows per group in
    every map task before it shuffles, so a large group costs no more than a small one."""
    numbered = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(name) <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of every group, as an aggregation with map-side combine."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """The last row of every group, as an aggregation with map-side combine."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])
