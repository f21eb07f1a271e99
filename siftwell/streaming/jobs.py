"""The continuous behaviours as Structured Streaming jobs. Each has a batch twin in ``operators``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.keys import joined_hash
from ..functions.scoring import FINISHED
from ..operators.govern import root_ancestors
from ..operators.jobs import state_changes
from ..operators.ordered import last_rows
from ..operators.standardize import ingest_fields
from ..sources import store
from ..sources.sinks import current_version, write_version


def ingest_stream(records: DataFrame, folder: str, as_of: Column, checkpoint: str, buckets: int = 64):
    """Upsert every micro-batch into the bucketed store below ``folder`` (see ``sources.store``).

    The version number is the batch id plus one. A batch reads and writes the buckets of its own keys
    only. One that is replayed before its commit writes the same version again from the state before
    it; one that is replayed after its commit changes nothing.
    """

    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        rows = ingest_fields(batch).persist()  # read by every table
        store.upsert_records(rows, folder, batch_id + 1, as_of, buckets=buckets)
        rows.unpersist()

    return drain(records, upsert_batch, checkpoint)


def running_counters(events: DataFrame, key: str, ts: str, sums: dict[str, Column], delay: str = "1 hour") -> DataFrame:
    """Counters per job as they advance (update mode)."""
    return events.withWatermark(ts, delay).groupBy(key).agg(F.count(F.lit(1)).alias("records"), *[F.sum(c).alias(n) for n, c in sums.items()])


def record_runs(events: DataFrame, key: str, ts: str, gap_seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Watchdog: a run ends when no record arrives for ``gap_seconds``; earlier records are kept."""
    session = F.session_window(ts, f"{gap_seconds} seconds")
    runs = events.withWatermark(ts, delay).groupBy(key, session.alias("w")).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("last_record_at"), F.count(F.lit(1)).alias("records"))
    return runs.select(key, "started_at", "last_record_at", "records")


def idle_sessions(messages: DataFrame, key: str, ts: str, ttl_hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """Sessions closed after ``ttl_hours`` without a message."""
    return record_runs(messages, key, ts, ttl_hours * 3600, delay)


def first_deliveries(deliveries: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Each (user, record, version) once; repeats within the delay are suppressed."""
    return deliveries.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def completion_log(jobs: DataFrame, requests: DataFrame, folder: str, checkpoint: str, delay: str = "1 hour", horizon: str = "30 days"):
    """Finished jobs joined with the requests that wait for them, as both arrive, appended below ``folder/events``.

    ``jobs(job_id, finished_at, status)`` and ``requests(request_id, job_id, asked_at)``. The event
    id is a hash of job and request, so a rerun produces the same event. What later rows may still meet is
    kept as a versioned table and joined with the next batch, so a batch of any size is a join that spills, and
    one that is replayed writes the same events again. ``horizon`` bounds what is kept: requests asked longer
    before or after the end of their job are served by the batch twin ``operators.deliver.completion_events``,
    which takes the events that are there already.
    """
    none = {"id": F.lit(None).cast("bigint"), "status": F.lit(None).cast("string")}
    done = jobs.filter(F.col("status").isin(*FINISHED)).select("job_id", none["id"].alias("request_id"), "status", F.col("finished_at").alias("at"))
    asked = requests.select("job_id", "request_id", none["status"].alias("status"), F.col("asked_at").alias("at"))
    span, late = F.expr(f"INTERVAL {horizon}"), F.expr(f"INTERVAL {delay}")

    def join_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = current_version(spark, f"{folder}/kept", below=batch_id + 1)
        rows = batch.filter(F.col("job_id").isNotNull() & F.col("at").isNotNull()).withColumn("_new", F.lit(True))
        if path:
            rows = rows.unionByName(spark.read.parquet(path).withColumn("_new", F.lit(False)))
        ended = rows.filter(F.col("status").isNotNull()).select("job_id", "status", F.col("at").alias("_ended"), F.col("_new").alias("_job_new"))
        waiting = rows.filter(F.col("status").isNull()).drop("status")
        near = F.col("at").between(F.col("_ended") - span, F.col("_ended") + span)
        met = ended.join(waiting, "job_id").filter(near & (F.col("_new") | F.col("_job_new"))).select("request_id", "job_id", "status")
        met.withColumn("event_id", joined_hash(F.col("job_id"), F.col("request_id"))).write.mode("overwrite").parquet(f"{folder}/events/batch={batch_id}")
        # The last row of either side is never older than the mark, so the next mark can be told from what is kept.
        micros, of_job = F.unix_micros("at"), F.col("status").isNotNull()
        last = rows.agg(F.max(F.when(of_job, micros)), F.max(F.when(~of_job, micros))).first()
        if None not in last:
            rows = rows.filter(F.col("at") >= F.timestamp_micros(F.lit(min(last))) - late - span)
        write_version(rows.drop("_new"), f"{folder}/kept", batch_id + 1)

    return drain(done.unionByName(asked), join_batch, checkpoint)


def resolved_completion_log(jobs: DataFrame, requests: DataFrame, folder: str, checkpoint: str, delay: str = "1 hour", horizon: str = "30 days"):
    """Completions of finished jobs for the originals behind their follow-ups, appended below ``folder/events``.

    ``jobs(job_id, finished_at, status)`` and ``requests(session_id, request_id, parent_id, follow_up, job_id,
    asked_at)``, as for ``stateful.resolved_completions``, which keeps the same in the state of a session. Here
    requests, jobs and what was sent are a versioned table as in ``completion_log``, and chains are resolved for all
    sessions at once that a batch touches, so neither a row nor a session costs calls of Python or of a state store, and no
    session has to fit one task. Requests are kept until their session, jobs until they have been quiet for ``horizon``.
    """
    columns = ["session_id", "request_id", "parent_id", "follow_up", "job_id", "status", "at", "sent"]
    missing = {c: F.lit(None).cast("bigint") for c in ("session_id", "request_id", "parent_id")} | {
        "follow_up": F.lit(None).cast("boolean"), "status": F.lit(None).cast("string"), "sent": F.lit(False)}

    def filled(df: DataFrame) -> DataFrame:
        return df.select(*[c if c in df.columns else missing[c].alias(c) for c in columns])

    done = filled(jobs.filter(F.col("job_id").isNotNull() & F.col("status").isin(*FINISHED)).select("job_id", "status", F.col("finished_at").alias("at")))
    told = requests.filter(F.col("session_id").isNotNull() & F.col("request_id").isNotNull())
    asked = filled(told.select("session_id", "request_id", "parent_id", F.coalesce("follow_up", F.lit(False)).alias("follow_up"), "job_id", F.col("asked_at").alias("at")))
    span, late = F.expr(f"INTERVAL {horizon}"), F.expr(f"INTERVAL {delay}")
    is_request, is_job = F.col("session_id").isNotNull(), F.col("status").isNotNull() & ~F.col("sent")

    def resolve_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = current_version(spark, f"{folder}/kept", below=batch_id + 1)
        rows = batch.withColumn("_new", F.lit(True))
        if path:
            rows = rows.unionByName(spark.read.parquet(path).withColumn("_new", F.lit(False)))
        ended = rows.filter(is_job).select("job_id", "status", F.col("at").alias("_ended"), F.col("_new").alias("_job_new"))
        waiting = rows.filter(is_request).drop("status", "sent")
        if path:  # sessions with a new request or a new end only
            by_end = waiting.join(ended.filter("_job_new").select("job_id"), "job_id", "left_semi").select("session_id")
            touched = waiting.filter("_new").select("session_id").unionByName(by_end).distinct()
            waiting = waiting.join(touched, "session_id", "left_semi")
        order = F.coalesce(F.unix_micros("at"), F.lit(-(1 << 63)))
        nodes = waiting.groupBy("request_id").agg(F.max_by(F.struct("parent_id", "follow_up"), F.struct("_new", order.alias("at"))).alias("_last"))
        roots = root_ancestors(nodes.select("request_id", "_last.parent_id", (~F.col("_last.follow_up")).alias("_original")), "request_id", "parent_id", "_original")
        near = F.coalesce(F.col("at").between(F.col("_ended") - span, F.col("_ended") + span), F.lit(True))
        met = waiting.join(ended, "job_id").filter(near).select("request_id", "job_id", "status", F.greatest("at", "_ended").alias("at"))
        found = met.join(roots.filter(F.col("root_id").isNotNull()), "request_id").groupBy(F.col("root_id").alias("request_id"), "job_id", "status").agg(F.max("at").alias("at"))
        if path:
            before = rows.filter("sent").select(F.col("request_id").alias("_request"), F.col("job_id").alias("_job"))
            found = found.join(before, (F.col("request_id") == F.col("_request")) & (F.col("job_id") == F.col("_job")), "left_anti")
        target = f"{folder}/events/batch={batch_id}"
        found.withColumn("event_id", joined_hash(F.col("job_id"), F.col("request_id"))).write.mode("overwrite").parquet(target)
        sent = spark.read.schema(found.schema).parquet(target).withColumn("sent", F.lit(True))
        rows = rows.drop("_new").unionByName(filled(sent))
        # The last row of either side is never older than the mark, so the next mark can be told from what is kept.
        micros = F.unix_micros("at")
        ends, asks, first = rows.agg(F.max(F.when(is_job, micros)), F.max(F.when(is_request, micros)), F.min(micros)).first()
        if ends is not None and asks is not None:
            mark = F.timestamp_micros(F.lit(min(ends, asks))) - late - span
            if rows.select((F.timestamp_micros(F.lit(first)) < mark).alias("old")).limit(1).first().old:
                alive = rows.filter(is_request & (F.col("at") >= mark)).select("session_id").distinct()
                rows = rows.filter(is_request).join(alive, "session_id", "left_semi").unionByName(rows.filter(~is_request & (F.col("at") >= mark)))
        write_version(rows.select(*columns), f"{folder}/kept", batch_id + 1)

    return drain(done.unionByName(asked), resolve_batch, checkpoint)


class HeartbeatReaper(StatefulProcessor):
    """Reports a running job as failed when its heartbeat stays away; a later heartbeat resets the timer."""

    def __init__(self, stale_seconds: int):
        self.stale_ms = stale_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, state = self.beat.get()[0] if self.beat.exists() else 0, None
        for batch in rows:
            row = batch.sort_values("at").iloc[-1]
            if row["at"] >= last:
                last, state = int(row["at"]), row["status"]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.beat.update((last,))
        if state in ("Running", "WaitingForUser"):
            self.handle.registerTimer(last + self.stale_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.beat.get()[0]
        self.beat.clear()
        yield pd.DataFrame({"job_id": [key[0]], "last_beat": [last]})

    def close(self) -> None:
        pass


def stale_jobs(beats: DataFrame, stale_seconds: int, delay: str = "1 minute") -> DataFrame:
    """``beats(job_id, status, ts)`` to one row per job whose heartbeat stopped.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = beats.withWatermark("ts", delay).select("job_id", "status", "ts", F.unix_millis("ts").alias("at"))
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=HeartbeatReaper(stale_seconds), outputStructType="job_id bigint, last_beat bigint",
        outputMode="Append", timeMode="EventTime")


def status_log(events: DataFrame, folder: str, bucket: Column, checkpoint: str):
    """Change rows of ``events(id, status, at, tie)`` appended below ``folder/changes``.

    The last status per id is kept as a versioned table and enters the next batch as its
    earliest row, so changes across batches are found and a batch is never gathered per id.
    """

    def log_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = current_version(spark, f"{folder}/last", below=batch_id + 1)
        rows = batch.withColumn("_new", F.lit(1))
        if path:
            rows = rows.unionByName(spark.read.parquet(path).withColumn("_new", F.lit(0)))
        changes = state_changes(rows, "id", "status", bucket, [F.col("at"), F.col("tie")])
        changes.select("id", "before", "status", "at").write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")
        write_version(last_rows(rows.drop("_new"), ["id"], [F.col("at"), F.col("tie")]).select(*batch.columns), f"{folder}/last", batch_id + 1, ["id"])

    return drain(events, log_batch, checkpoint)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Run a stream over what is available and stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
