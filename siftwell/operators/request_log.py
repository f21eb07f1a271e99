"""The request log: filtered pages at any depth with their total, timelines per user, and request details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import number_rows
from .search import day_range

BUCKETS = 1024  # buckets whose counts are added up in one task


def shown_requests(requests: DataFrame) -> DataFrame:
    """Requests that are not cancelled collections and not receipts of a reset."""
    return requests.filter(~F.coalesce("cancelled", F.lit(False)) & ~F.col("kind").eqNullSafe(F.lit("reset_receipt")))


def request_log(requests: DataFrame, jobs: DataFrame, user: object = None, decision: str | None = None, source: str | None = None,
                first: str | None = None, last: str | None = None) -> DataFrame:
    """The rows of the log by user, decision, source (of the request or of its job) and inclusive days."""
    rows = shown_requests(requests).filter(day_range(F.col("created_at"), first, last))
    if user is not None:
        rows = rows.filter(F.col("user_id") == user)
    if decision is not None:
        rows = rows.filter(F.col("decision") == decision)
    if source is None:
        return rows
    of_source = jobs.filter(F.col("script_id") == source).select("job_id").distinct().withColumn("_of_source", F.lit(True))
    return rows.join(of_source, "job_id", "left").filter(F.col("_of_source").isNotNull() | (F.col("source_id") == source)).select(requests.columns)


def deep_page(rows: DataFrame, bucket: Column, order: Sequence[Column], page: int, size: int = 20, most: int = 100) -> DataFrame:
    """One page of an ordered table with ``position`` and ``total``; a late page costs what the first one costs.

    Rows are counted per ``bucket``, a whole number which must grow with the order. The running count says which
    buckets the page lies in; only these are sorted. It runs inside blocks of buckets, and over the counts of the
    blocks, which are one row, so no task holds all buckets. The counts give the total as well.
    """
    page, size = max(1, page), min(max(1, size), most)
    low, high = (page - 1) * size, page * size
    counts = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_block", F.floor(F.col("_bucket") / BUCKETS))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_n")).agg(F.array_sort(F.collect_list(F.struct("_block", "_n"))).alias("_blocks"))
    earlier = F.transform("_blocks", lambda b, i: F.struct(b["_block"].alias("_block"), F.aggregate(
        F.slice("_blocks", F.lit(1), i), F.lit(0).cast("bigint"), lambda n, c: n + c["_n"]).alias("_earlier")))
    inside_block = F.coalesce(F.sum("_n").over(W.partitionBy("_block").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.withColumn("_before", inside_block).join(blocks.select(F.inline(earlier)), "_block").withColumn("_before", F.col("_before") + F.col("_earlier"))
    chosen = before.drop("_block", "_earlier").filter((F.col("_before") < high) & (F.col("_before") + F.col("_n") > low)).drop("_n")
    inside = rows.withColumn("_bucket", bucket).join(chosen, "_bucket")
    local = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    placed = inside.withColumn("position", (F.col("_before") + local).cast("bigint")).filter((F.col("position") > low) & (F.col("position") <= high))
    return placed.drop("_bucket", "_before").withColumn("total", counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint")).scalar())


def page_after(rows: DataFrame, at: str, tie: str, last: tuple | None, size: int = 20) -> DataFrame:
    """The page after the row ``(at, tie)`` in the order newest first, ties by rising ``tie``; None asks for the first page.

    Every task keeps ``size`` rows at most, so walking on costs the same on every page.
    """
    if last is not None:
        value = F.lit(last[0]).cast(rows.schema[at].dataType)
        rows = rows.filter((F.col(at) < value) | (F.col(at) == value) & (F.col(tie) > F.lit(last[1])))
    return rows.orderBy(F.col(at).desc(), F.col(tie)).limit(size)


def user_timelines(requests: DataFrame, users: DataFrame, bucket: Column, page: int = 1, size: int = 20) -> DataFrame:
    """One page of every user's requests, newest first, with the user's name and total. ``bucket`` must grow with age."""
    shown = shown_requests(requests)
    totals = shown.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    numbered = number_rows(shown.withColumn("_back", -F.unix_micros(F.col("created_at").cast("timestamp"))), ["user_id"], bucket,
                           [F.col("_back"), F.col("request_id")], "position")
    part = numbered.filter((F.col("position") > (page - 1) * size) & (F.col("position") <= page * size)).drop("_back")
    return part.join(totals, "user_id").join(users.select("user_id", "user_name"), "user_id", "left")


def request_details(requests: DataFrame, jobs: DataFrame, messages: DataFrame, served: DataFrame) -> DataFrame:
    """Each request with its job, its transcript in order of time and the rows it was served by rank, as arrays of structs.

    ``messages(request_id, at, message_id, role, text)``, ``served(request_id, rank, lead_id, snapshot)``;
    both are arrays of one request, which bounds them.
    """
    talk = messages.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("at", "message_id", "role", "text"))).alias("transcript"))
    rows = served.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "lead_id", "snapshot"))).alias("rows_served"))
    of_job = jobs.select("job_id", F.struct(*[F.col(c) for c in jobs.columns]).alias("job"))
    joined = requests.filter(~F.coalesce("cancelled", F.lit(False))).join(of_job, "job_id", "left").join(talk, "request_id", "left").join(rows, "request_id", "left")
    return joined.withColumns({"transcript": F.coalesce("transcript", F.array().cast(talk.schema["transcript"].dataType)),
                               "rows_served": F.coalesce("rows_served", F.array().cast(rows.schema["rows_served"].dataType))})
