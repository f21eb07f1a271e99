"""Helpers that several operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text between ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), lambda w: w != "")


def shingles(tokens: Column, size: int, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """Hashes of all runs of ``size`` tokens in order; fewer tokens give one run of all, none give none."""

    def all_runs(t: Column) -> Column:
        last = F.greatest(F.size(t) - size, F.lit(0))
        return F.when(F.size(t) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: hashed(*[F.get(t, i + k) for k in range(size)])))

    return let(tokens, all_runs)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that name a row by its id and its text, so that ids that repeat or are null stay apart."""
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("key_id"),
            F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("key_text")]


KEY = ["key_id", "key_text"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place named by ``spark.checkpoint.dir``; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not shared:
        shared = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, and kept if executors are lost."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``(a, b)`` links as ``(node, root)``, the root being the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each an aggregation and a
    join, and stores the links after every round. Self links and repeats don't matter; no links
    give an empty table.
    """
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
        both = links.union(links.select("v", "u")).toDF("n", "m")
        least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.filter("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("low").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.inline(F.array(
            F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))))
        links = stored(small.filter("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())


def with_bitmap(rows: DataFrame, wanted: DataFrame, key: str, flag: str = "there") -> DataFrame:
    """``rows`` with a flag: whether their key is set in a bitmap of the wanted keys, as it is for all of these and a few others.

    The bitmap has 2^23 bits whatever the corpus, one megabyte to broadcast; it spares most texts the
    shuffle of the exact join that follows.
    """
    bucket, bitmap = f"{flag}_bucket", f"{flag}_bitmap"
    slot = F.pmod(F.col(key), F.lit(1 << 23)) + 1
    place = F.bitmap_bit_position(slot)
    bits = wanted.groupBy(F.bitmap_bucket_number(slot).alias(bucket)).agg(F.bitmap_construct_agg(place).alias(bitmap))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn(bucket, F.bitmap_bucket_number(slot)).join(F.broadcast(bits), bucket, "left").withColumn(flag, there).drop(bucket, bitmap)
