"""Collection jobs: reuse, queue, watchdog, state changes and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import hms, seconds_between
from .ordered import number_rows, previous_values, running_sum

ACTIVE = ["Queued", "Running", "WaitingForUser"]
# Allowed state changes of a job.
TRANSITIONS = {"Queued": ["Running", "Cancelled"], "Running": ["WaitingForUser", "Completed", "Partial", "Failed", "Cancelled"],
               "WaitingForUser": ["Running", "Failed", "Cancelled"]}


def job_view(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Displayed job: zero for missing counters and a live duration while running."""
    started = (F.col("status") == "Running") & F.col("started_at").isNotNull()
    live = F.when(started, hms(seconds_between(F.col("started_at"), as_of)))
    stored = F.col("duration") if "duration" in jobs.columns else F.lit(None).cast("string")
    return jobs.withColumn("view_duration", F.coalesce(stored, live))


def reuse_jobs(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """The job that answers every asked job: a stored one with the same idempotency key, else an
    active stored one for the same source and parameters, else the first asked one.

    Rows asked under one idempotency key are one request and share the result of the first.
    """
    age = F.struct("created_at", "job_id")
    by_key = stored.filter(F.col("idempotency_key").isNotNull()).groupBy("idempotency_key").agg(
        F.min_by("job_id", age).alias("_key_job"))
    active = stored.filter(F.col("status").isin(ACTIVE)).groupBy("script_id", "params_hash").agg(
        F.min_by("job_id", age).alias("_active_job"))
    leaders = asked.withColumn("_request", F.coalesce("idempotency_key", F.concat(F.lit("job:"), "job_id"))).groupBy("_request").agg(
        F.min_by(F.struct("job_id", "created_at", "script_id", "params_hash", "idempotency_key"), age).alias("l")).select("_request", "l.*")
    matched = leaders.join(by_key, "idempotency_key", "left").join(active, ["script_id", "params_hash"], "left")
    known = F.coalesce("_key_job", "_active_job")
    first_new = matched.filter(known.isNull()).groupBy("script_id", "params_hash").agg(F.min_by("job_id", age).alias("_first_new"))
    decided = matched.join(first_new, ["script_id", "params_hash"], "left").select(
        "_request", F.coalesce(known, F.col("_first_new")).alias("survivor"))
    keyed = asked.withColumn("_request", F.coalesce("idempotency_key", F.concat(F.lit("job:"), "job_id")))
    return keyed.join(decided, "_request").drop("_request").withColumn("created", F.col("survivor") == F.col("job_id"))


def queue_positions(jobs: DataFrame, bucket: Column) -> DataFrame:
    """Position of every queued job by creation time and id, and whether anything is running."""
    queued = number_rows(jobs.filter(F.col("status") == "Queued"), [], bucket, [F.col("created_at"), F.col("job_id")], "position")
    running = jobs.agg(F.count_if(F.col("status").isin("Running", "WaitingForUser")).alias("running"))
    return queued.withColumn("running", running.scalar())


def stale_jobs(jobs: DataFrame, as_of: Column, stale_seconds: int) -> DataFrame:
    """Running or waiting jobs without a sign of life; queued jobs are never among them."""
    beat = F.coalesce("heartbeat_at", "started_at", "updated_at", "created_at")
    cutoff = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stale_seconds))
    return jobs.filter(F.col("status").isin("Running", "WaitingForUser") & (beat < cutoff))


def gap_sessions(events: DataFrame, key: str, ts: str, tie: str, bucket: Column, gap_seconds: int,
                 values: dict[str, Column] | None = None) -> DataFrame:
    """Runs of events without a gap of ``gap_seconds`` or more: start, last record and count per run."""
    order = [F.col(ts), F.col(tie)]
    known = previous_values(events, [key], bucket, order, {"_before": F.col(ts)})
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))
    starts = F.when(F.col("_before").isNull() | (gap >= gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = running_sum(known.withColumn("_starts", starts), [key], bucket, order, {"run_no": F.col("_starts")})
    extra = [v.alias(n) for n, v in (values or {}).items()]
    return numbered.groupBy(key, "run_no").agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("last_record_at"), F.count(F.lit(1)).alias("records"), *extra)


def state_changes(events: DataFrame, key: str, state: str, bucket: Column, order: Sequence[Column]) -> DataFrame:
    """Rows whose state differs from the row before, with the state before and whether the change is allowed."""
    known = previous_values(events, [key], bucket, order, {"before": F.col(state)})
    rule = F.lit(False)
    for before, after in TRANSITIONS.items():
        rule = rule | ((F.col("before") == before) & F.col(state).isin(after))
    return known.filter(F.col("before").isNotNull() & (F.col("before") != F.col(state))).withColumn("allowed", rule)


def cancellable(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Unfinished jobs for which no request of another user waits."""
    waiting = requests.groupBy("job_id").agg(F.min("user_id").alias("_low"), F.max("user_id").alias("_high"))
    own = jobs.filter(F.col("status").isin(ACTIVE)).join(waiting, "job_id", "left")
    alone = (F.col("_low") == F.col("created_by")) & (F.col("_high") == F.col("created_by"))
    return own.filter(F.col("_low").isNull() | alone).drop("_low", "_high")


def one_active_session(sessions: DataFrame, as_of: Column, ttl_hours: int) -> DataFrame:
    """Newest session per user stays active unless idle beyond the limit; all others are archived."""
    newest = sessions.groupBy("user_id").agg(F.max(F.struct("created_at", "session_id")).alias("_newest"))
    cutoff = as_of - F.make_dt_interval(F.lit(0), F.lit(ttl_hours))
    status = (F.when(F.col("_newest.session_id") != F.col("session_id"), F.lit("archived"))
              .when(F.col("updated_at") < cutoff, F.lit("closed")).otherwise(F.lit("active")))
    return sessions.join(newest, "user_id").withColumn("status", status).drop("_newest")
