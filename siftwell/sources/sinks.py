"""Sinks: versioned tables, append-only snapshots, CSV exports and log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deliver import delivery_ranks, new_deliveries


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, so that the same code runs on any shared storage."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def versions(spark: SparkSession, table: str) -> list[int]:
    """Complete versions of a table, oldest first. Spark marks a finished write with ``_SUCCESS``."""
    fs, root, jvm = _files(spark, table)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


def current_version(spark: SparkSession, table: str, below: int | None = None) -> str | None:
    done = [v for v in versions(spark, table) if below is None or v < below]
    return f"{table}/v={done[-1]:08d}" if done else None


def write_version(df: DataFrame, table: str, version: int, unique: Sequence[str] = (), partition_by: Sequence[str] = ()) -> str:
    """Write the table as one new version beside the old ones.

    Readers keep the version they opened. The version appears as a whole when the write is
    finished; a failed or repeated write of the same version replaces it. ``unique`` keys are
    checked on what was written.
    """
    path = f"{table}/v={version:08d}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if unique:
        written = df.sparkSession.read.schema(df.schema).parquet(path)
        double = written.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        if double:
            raise ValueError(f"{path}: {list(unique)} is not unique")
    return path


def record_delivery(requests: DataFrame, records: DataFrame, position: Column, served_at: Column, path: str) -> DataFrame:
    """Freeze displayed values and order once, appended by delivery date.

    Requests that were served before, or whose rows are already stored below ``path``, are left alone,
    so a second call or a retry adds nothing. ``records`` brings ``request_id, lead_id`` and the
    displayed columns, which become the JSON snapshot.
    """
    ranked = delivery_ranks(records, "request_id", "lead_id", position, _bucket)
    fresh = new_deliveries(requests, ranked, "request_id")
    spark = records.sparkSession
    fs, target, _ = _files(spark, path)
    if fs.exists(target):
        there = spark.read.option("mergeSchema", False).parquet(path).select("request_id").distinct()
        fresh = fresh.join(there, "request_id", "left_anti")
    shown = [c for c in ranked.columns if c not in ("request_id", "rank")]
    rows = fresh.select("request_id", "lead_id", "rank", F.to_json(F.struct(*shown)).alias("snapshot"), served_at.alias("served_at"),
                        served_at.cast("date").alias("delivery_date"))
    rows.write.mode("append").partitionBy("delivery_date").parquet(path)
    return rows


def _bucket(position: Column) -> Column:
    return F.floor(position.cast("bigint") / 65536)


def write_csv(df: DataFrame, path: str, order: Sequence[Column] = ()) -> None:
    """CSV with header; ordered exports are range-partitioned, so no single task sorts everything."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_log_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("append").text(path)


def upsert_field_maps(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Field maps per source; a changed map replaces the stored one and has to be reviewed again."""
    kept = stored.join(changed.select("source_code"), "source_code", "left_anti")
    return kept.unionByName(changed.withColumn("reviewed", F.lit(False)))


def merge_into(target_table: str, source: DataFrame, key: str) -> None:
    """Keyed upsert in place, for catalogs whose tables support row-level changes."""
    on = F.col(f"target.{key}") == F.col(f"source.{key}")
    source.alias("source").mergeInto(target_table, on).whenMatched().updateAll().whenNotMatched().insertAll().merge()


__all__ = ["current_version", "merge_into", "record_delivery", "upsert_field_maps", "versions", "write_csv",
           "write_log_lines", "write_version"]
