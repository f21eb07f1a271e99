"""Streams whose state is more than an aggregate: the life of a job, and completions of follow-up requests.

Both keep their state per key and drop it by event-time timers. The life of a job needs the
RocksDB state store (``use_rocksdb``). The log rows of one key in one micro-batch are held at once; limit
the micro-batch (``maxFilesPerTrigger``) where a single job may log very much.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.keys import joined_hash
from ..functions.scoring import FINISHED

STALLED = "stalled: heartbeat timeout"
REAPED_STATES = ("Running", "WaitingForUser")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- the life of a job -----------------------------------------------------------------------
LIFE = "started bigint, last bigint, records bigint, entries bigint, errors bigint, status string, run_id string, dataset_id string"
LIFE_END = ("job_id bigint, run_id string, dataset_id string, started_us bigint, completed_us bigint, status string, records bigint, "
            "entries bigint, errors bigint, error_message string")


class JobLife(StatefulProcessor):
    """One row when a job ends, by its own status or because its log stays away for too long; then nothing is kept of it."""

    def __init__(self, stale_seconds: int, shown_errors: int = 5):
        self.stale, self.shown = stale_seconds * 1_000_000, shown_errors

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE)
        self.messages = handle.getListState("messages", "text string")

    def _end(self, key, life: list, texts: list[str], status: str, at: int, message: str | None) -> tuple:
        text = message or ("; ".join(texts)[:2000] if texts else None)
        return (key[0], life[6], life[7], life[0], at, status, life[2], life[3], life[4], text)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        life = list(self.life.get()) if self.life.exists() else None
        texts = [m[0] for m in self.messages.get()] if self.messages.exists() else []
        log, ends = pd.concat(list(rows)).sort_values(["at", "tie"]), []
        for at, status, records, error, run_id, dataset_id in log[["at", "status", "records", "error", "run_id", "dataset_id"]].itertuples(index=False):
            if life and life[5] in REAPED_STATES and at - life[1] > self.stale:
                ends.append(self._end(key, life, texts, "Failed", life[1] + self.stale, STALLED))
                life = None
            if life is None:
                life, texts = [at, at, 0, 0, 0, status, None, None], []
            life[1], life[5] = max(life[1], at), status
            life[2], life[3] = life[2] + int(records or 0), life[3] + 1
            life[6], life[7] = run_id or life[6], dataset_id or life[7]
            if error:
                life[4] += 1
                texts = texts + [error] if len(texts) < self.shown else texts
            if status in FINISHED:
                ends.append(self._end(key, life, texts, status, life[1], None))
                life = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if life is None:
            self.life.clear()
            self.messages.clear()
        else:
            self.life.update(tuple(life))
            self.messages.put([(t,) for t in texts]) if texts else self.messages.clear()  # an empty list can't be stored
            if life[5] in REAPED_STATES:
                self.handle.registerTimer((life[1] + self.stale) // 1000)
        if ends:
            yield pd.DataFrame(ends, columns=[c.split()[0] for c in LIFE_END.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.life.exists():
            return
        life = list(self.life.get())
        texts = [m[0] for m in self.messages.get()] if self.messages.exists() else []
        self.life.clear()
        self.messages.clear()
        yield pd.DataFrame([self._end(key, life, texts, "Failed", life[1] + self.stale, STALLED)], columns=[c.split()[0] for c in LIFE_END.split(", ")])

    def close(self) -> None:
        pass


def job_lives(log: DataFrame, stale_seconds: int, delay: str = "1 hour", shown_errors: int = 5) -> DataFrame:
    """Ends of jobs from ``log(job_id, ts, tie, status, records, error, run_id, dataset_id)``.

    A row of the log is a heartbeat, a status change or a batch of records; ``tie`` orders rows of one
    time. A running or waiting job without rows for more than ``stale_seconds`` has failed at that moment;
    queued jobs are never given up. A row after the end begins a new life. The first ``shown_errors``
    errors make the message. Columns: counts, ``started_at``, ``completed_at``, ``duration_seconds``.
    """
    rows = log.withWatermark("ts", delay).select(
        "job_id", "ts", F.unix_micros("ts").alias("at"), "tie", "status", "records", "error", "run_id", "dataset_id")
    ends = rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobLife(stale_seconds, shown_errors), outputStructType=LIFE_END, outputMode="Append", timeMode="EventTime")
    return ends.select(
        "job_id", "run_id", "dataset_id", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("completed_us").alias("completed_at"),
        "status", "records", "entries", "errors", "error_message", ((F.col("completed_us") - F.col("started_us")) / 1_000_000).alias("duration_seconds"))


def end_cascade(ends: DataFrame) -> DataFrame:
    """The states that the end of a job sets: ``(entity, id, status, completed_at, error_message)`` for job, run and dataset."""
    states = F.array(*[F.struct(F.lit(n).alias("entity"), F.col(c).cast("string").alias("id")) for n, c in (("job", "job_id"), ("run", "run_id"), ("dataset", "dataset_id"))])
    return ends.select(F.explode(states).alias("s"), "status", "completed_at", "error_message").filter("s.id IS NOT NULL").select("s.entity", "s.id", "status", "completed_at", "error_message")


# --- completions of follow-up requests -------------------------------------------------------
NOBODY = -(1 << 63)
ROOTS = ("requests array<bigint>, parents array<bigint>, originals array<boolean>, waiting_requests array<bigint>, waiting_jobs array<bigint>, "
         "waiting_states array<string>, sent_jobs array<bigint>, sent_roots array<bigint>, last bigint")


def _root(pointers: dict, request: int) -> tuple[str, int | None]:
    """``(found, root)``, ``(none, None)`` or ``(open, None)`` while a pointer is missing. ``pointers`` names parent and whether it is an original."""
    path, seen, at = [], set(), request
    while True:
        if at in seen:
            return "none", None
        if at not in pointers:
            return "open", None
        parent, original = pointers[at]
        if original:
            break
        path.append(at)
        seen.add(at)
        if parent is None:
            return "none", None
        at = parent
    for passed in path:
        pointers[passed] = (at, False)
    return "found", at


def request_roots(horizon_seconds: int):
    """Per session the pointers from follow-ups to what they follow, and finished jobs that wait for a pointer.

    A row with a job is a subscription whose job has finished, a row without is a request. Chains are
    shortened when they are walked. Circles and chains without an original request give nothing. The state
    of a session is one row, which travels with its input, so a session costs no calls to the state store.
    """
    horizon = horizon_seconds * 1000

    def resolve(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get if state.exists else ((),) * 8 + (0,)
        requests, parents, originals, open_requests, open_jobs, open_states, sent_jobs, sent_roots, last = kept
        pointers = {r: (p, o) for r, p, o in zip(requests, parents, originals)}
        asked, sent = list(zip(open_requests, open_jobs, open_states)), dict.fromkeys(zip(sent_jobs, sent_roots))
        for batch in rows:
            last = max(last, int(batch["at"].max()))
            columns = [batch[c].tolist() for c in ("request_id", "parent_id", "follow_up", "job_id", "status")]
            for request, parent, follow_up, job, status in zip(*columns):
                if status is None:
                    pointers[request] = (parent if follow_up and parent != NOBODY else None, not follow_up)
                else:
                    asked.append((request, job, status))
        open_, out = [], []
        for request, job, status in asked:
            found, root = _root(pointers, request)
            if found == "open":
                open_.append((request, job, status))
            elif found == "found" and (job, root) not in sent:
                sent[job, root] = None
                out.append((root, job, status))
        state.update((list(pointers), [p for p, _ in pointers.values()], [o for _, o in pointers.values()], [r for r, _, _ in open_], [j for _, j, _ in open_],
                      [s for _, _, s in open_], [j for j, _ in sent], [r for _, r in sent], last))
        state.setTimeoutTimestamp(max(last + horizon, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["request_id", "job_id", "status"])

    return resolve


def resolved_completions(jobs: DataFrame, requests: DataFrame, delay: str = "1 hour", horizon_seconds: int = 30 * 86400) -> DataFrame:
    """One completion per finished job and original request, as jobs and requests arrive.

    ``jobs(job_id, finished_at, status)``, ``requests(session_id, request_id, parent_id, follow_up, job_id,
    asked_at)``: a follow-up that subscribes to a job speaks for the request at the root of its chain,
    which lies in one session. Pointers and waiting jobs are kept until a session has been quiet for the
    horizon. The batch twin is ``operators.deliver.resolved_completions``.
    """
    done = jobs.withWatermark("finished_at", delay).filter(F.col("status").isin(*FINISHED))
    asked = requests.withWatermark("asked_at", delay).filter(F.col("session_id").isNotNull())
    span = F.expr(f"INTERVAL {horizon_seconds} SECONDS")
    near = (F.col("_job") == F.col("job_id")) & F.col("asked_at").between(F.col("finished_at") - span, F.col("finished_at") + span)
    met = asked.withColumnRenamed("job_id", "_job").join(done, near).select(
        "session_id", "request_id", "parent_id", "follow_up", "job_id", "status", "asked_at")
    rows = met.unionByName(asked.select("session_id", "request_id", "parent_id", "follow_up", F.lit(None).cast("bigint").alias("job_id"),
                                        F.lit(None).cast("string").alias("status"), "asked_at"))
    told = rows.filter(F.col("request_id").isNotNull()).select(  # without NULL, which would turn ids into floats
        "session_id", "request_id", F.coalesce("parent_id", F.lit(NOBODY)).alias("parent_id"), F.coalesce("follow_up", F.lit(False)).alias("follow_up"),
        F.coalesce("job_id", F.lit(NOBODY)).alias("job_id"), "status", "asked_at", F.coalesce(F.unix_millis("asked_at"), F.lit(0)).alias("at"))
    found = told.groupBy("session_id").applyInPandasWithState(
        request_roots(horizon_seconds), "request_id bigint, job_id bigint, status string", ROOTS, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("event_id", joined_hash(F.col("job_id"), F.col("request_id")))
