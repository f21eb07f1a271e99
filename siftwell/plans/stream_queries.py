"""Streaming jobs over the given tables, drained and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import deliver as D
from ..schemas import RAW_SCHEMA
from ..session import scratch_folder
from ..sources.adapter import CollectedRecords
from ..sources.store import read_store
from ..streaming import jobs as T
from ..streaming import stateful as S
from .bindings import Entities, as_of
from .registry import plan


def stream(e: Entities, table: str) -> DataFrame:
    """A table as a file stream."""
    return e.spark.readStream.schema(e.table(table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(e.folder)


def drained(e: Entities, rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Result of a stream after everything available was processed."""
    folder = scratch_folder(e.spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    T.drain(rows, write, f"{folder}/checkpoint", mode)
    return e.spark.read.schema(rows.schema).parquet(f"{folder}/out").select(*rows.columns)


@plan("stream_counters", sql="""SELECT user_id, count(*) AS records, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1""")
def stream_counters(e: Entities) -> DataFrame:
    """Counters per job after the stream has been drained."""
    events = stream(e, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = T.running_counters(events, "user_id", "ts", {"cents": F.round(F.col("value") * 100).cast("bigint")})
    return drained(e, counted, "counters", "complete")


@plan("stream_runs", sql="""
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM g)
SELECT user_id, min(ts) AS started_at, max(ts) AS last_record_at, count(*) AS records FROM n GROUP BY user_id, run_no""")
def stream_runs(e: Entities) -> DataFrame:
    """Runs closed by a gap, as session windows; same result as the batch twin."""
    events = stream(e, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    runs = drained(e, T.record_runs(events, "user_id", "ts", 6 * 3600), "runs", "complete")
    return runs.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "last_record_at")], "records")


@plan("stream_first_deliveries", sql="""SELECT DISTINCT l_suppkey AS user_id, l_orderkey AS lead_id, l_linenumber % 3 + 1 AS record_version FROM lineitem""")
def stream_first_deliveries(e: Entities) -> DataFrame:
    """Each user, record and version once."""
    rows = stream(e, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("lead_id"),
                                        (F.col("l_linenumber") % 3 + 1).alias("record_version"), F.col("l_shipdate").cast("timestamp").alias("served_at"))
    once = T.first_deliveries(rows, ["user_id", "lead_id", "record_version"], "served_at", "4000 days")
    return drained(e, once.drop("served_at"), "deliveries")


@plan("stream_completions", sql="""
WITH j AS (SELECT o_orderkey AS job_id, o_orderdate AS finished_at, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Partial' ELSE 'Running' END AS status FROM orders),
r AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey AS job_id, l_shipdate AS asked_at FROM lineitem)
SELECT DISTINCT request_id, job_id, status, sha256(job_id || ':' || request_id) AS event_id FROM j JOIN r USING (job_id) WHERE status <> 'Running'""")
def stream_completions(e: Entities) -> DataFrame:
    """Completions from two streams that arrive independently, and those beyond their horizon from the batch twin."""
    status = F.when(F.col("o_orderstatus") == "F", F.lit("Completed")).when(F.col("o_orderstatus") == "P", F.lit("Partial")).otherwise(F.lit("Running"))

    def jobs(orders: DataFrame) -> DataFrame:
        return orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("finished_at"), status.alias("status"))

    def requests(lines: DataFrame) -> DataFrame:
        return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_orderkey").alias("job_id"),
                            F.col("l_shipdate").cast("timestamp").alias("asked_at"))

    folder = scratch_folder(e.spark, "completions")
    T.completion_log(jobs(stream(e, "orders")), requests(stream(e, "lineitem")), folder, f"{folder}/checkpoint")
    written = e.spark.read.schema("request_id bigint, job_id bigint, status string, event_id string").parquet(f"{folder}/events")
    met = written.select("request_id", "job_id", "status", "event_id").distinct()
    waiting = requests(e.lineitem).select("request_id", "job_id", F.lit("request").alias("kind")).distinct()
    late = D.completion_events(jobs(e.orders), waiting, met)
    return met.unionByName(late.select("request_id", "job_id", F.col("job_status").alias("status"), "event_id"))


@plan("stream_status_changes", sql="""
WITH p AS (SELECT user_id AS id, event_type AS status, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT id, before, status, epoch_us(ts) AS at FROM p WHERE before <> status""")
def stream_status_changes(e: Entities) -> DataFrame:
    """Change log of a status over arriving batches."""
    events = stream(e, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
                                        F.col("event_id").alias("tie"))
    folder = scratch_folder(e.spark, "status")
    T.status_log(events, folder, F.floor(F.col("at") / 86_400_000_000), f"{folder}/checkpoint")
    return e.spark.read.schema("id bigint, before string, status string, at bigint").parquet(f"{folder}/changes").select("id", "before", "status", "at")


@plan("stream_ingest", sql="""
SELECT 'src:' || event_type || ':' || user_id AS identity_key, 'Event ' || arg_max(event_id, event_id) AS title, count(*) AS version, 'user ' || user_id || '@firm.com' AS contact_name FROM events GROUP BY event_type, user_id""")
def stream_ingest(e: Entities) -> DataFrame:
    """Arriving records standardised and upserted into the canonical tables, then the leads read back."""
    k = F.col("event_id")
    records = stream(e, "events").select(
        k.alias("ordinal"), F.lit("opportunity").alias("record_kind"), F.col("event_type").alias("source_code"), F.col("user_id").alias("external_id"),
        F.concat(F.lit("Event "), k).alias("title"), F.concat(F.lit("user "), "user_id", F.lit("@firm.com")).alias("contact_name"),
        F.concat(F.lit("Org "), F.col("user_id") % 20).alias("organization_name"), F.lit("NY").alias("us_state"))
    folder = scratch_folder(e.spark, "store")
    T.ingest_stream(records, f"{folder}/tables", as_of(), f"{folder}/checkpoint", buckets=16)
    return read_store(e.spark, f"{folder}/tables").leads.select("identity_key", "title", "version", "contact_name")


@plan("stream_collected", sql="""
SELECT CAST(event_id AS VARCHAR) AS external_id, event_type AS source_code, 'Event ' || event_id AS title, CAST(event_id % 2 AS INTEGER) AS arrival, true AS in_order FROM events""")
def stream_collected(e: Entities) -> DataFrame:
    """Record files read as they arrive: the second half comes after the first was read, and its ordinals come after."""
    e.spark.dataSource.register(CollectedRecords)
    folder, k = scratch_folder(e.spark, "collected"), F.col("event_id")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("arrival", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    for half in (0, 1):
        records = e.events.filter(k % 2 == half).select(k.cast("string").alias("external_id"), F.col("event_type").alias("source_code"), F.concat(F.lit("Event "), k).alias("title"))
        records.write.mode("append").json(f"{folder}/in")
        files = e.spark.readStream.format("collected").option("suffix", ".json").option("log", f"{folder}/log").load(f"{folder}/in")
        T.drain(files, write, f"{folder}/checkpoint")
    rows = e.spark.read.schema(f"{RAW_SCHEMA}, arrival INT").parquet(f"{folder}/out")
    last_of_first = rows.filter("arrival = 0").agg(F.max("ordinal")).scalar()
    return rows.select(F.col("raw")["external_id"].alias("external_id"), "source_code", F.col("raw")["title"].alias("title"), "arrival",
                       ((F.col("arrival") == 0) | (F.col("ordinal") > last_of_first)).alias("in_order"))


JOB_LOG_STALE = 12 * 3600


@plan("stream_job_lives", sql=f"""
WITH o AS (SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CASE WHEN before IS NULL OR kind_before = 'purchase' OR kind_before <> 'signup' AND ts - before > INTERVAL {JOB_LOG_STALE} SECOND THEN 1 ELSE 0 END AS begins FROM o),
n AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM s),
l AS (SELECT user_id AS job_id, life, min(ts) AS started_at, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS kind, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS records,
  count(*) AS entries, count(*) FILTER (event_type = 'error') AS errors, list('error ' || event_id ORDER BY ts, event_id) FILTER (event_type = 'error') AS texts FROM n GROUP BY 1, 2),
e AS (SELECT *, CASE WHEN kind = 'purchase' THEN last ELSE last + INTERVAL {JOB_LOG_STALE} SECOND END AS completed_at FROM l
  WHERE kind = 'purchase' OR kind <> 'signup' AND (life < (SELECT max(life) FROM l x WHERE x.job_id = l.job_id) OR last + INTERVAL {JOB_LOG_STALE} SECOND < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)),
t AS (SELECT job_id, completed_at, CASE WHEN kind = 'purchase' THEN 'Completed' ELSE 'Failed' END AS status, started_at, records, entries, errors,
  CASE WHEN kind = 'purchase' THEN coalesce(array_to_string(texts[1:5], '; '), '') ELSE 'stalled: heartbeat timeout' END AS error_message FROM e)
SELECT entity, entity || ' ' || job_id AS id, status, completed_at, error_message, started_at, records, entries, errors, epoch_us(completed_at) - epoch_us(started_at) AS duration_us
FROM t, (SELECT unnest(['job', 'run', 'dataset']) AS entity)""")
def stream_job_lives(e: Entities) -> DataFrame:
    """Logs of jobs folded into their ends, by status or by silence, and what each end sets for job, run and dataset."""
    S.use_rocksdb(e.spark)
    kind, user = F.col("event_type"), F.col("user_id")
    status = F.when(kind == "purchase", F.lit("Completed")).when(kind == "signup", F.lit("Queued")).when(kind == "view", F.lit("WaitingForUser")).otherwise(F.lit("Running"))
    log = stream(e, "events").select(
        user.alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), status.alias("status"), F.floor("value").alias("records"),
        F.when(kind == "error", F.concat(F.lit("error "), "event_id")).alias("error"), F.concat(F.lit("run "), user).alias("run_id"), F.concat(F.lit("dataset "), user).alias("dataset_id"))
    ends = drained(e, S.job_lives(log, JOB_LOG_STALE), "lives")
    told = S.end_cascade(ends).withColumn("job_id", F.substring_index("id", " ", -1).cast("bigint"))
    facts = ends.select("job_id", F.col("completed_at").alias("_at"), "started_at", "records", "entries", "errors")
    whole = told.join(facts, (told.job_id == facts.job_id) & (F.col("completed_at") == F.col("_at")))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("completed_at", "started_at")}
    duration = F.unix_micros("completed_at") - F.unix_micros("started_at")
    return whole.select("entity", F.concat_ws(" ", "entity", told.job_id).alias("id"), "status", times["completed_at"].alias("completed_at"), F.coalesce("error_message", F.lit("")).alias("error_message"),
                        times["started_at"].alias("started_at"), "records", "entries", "errors", duration.alias("duration_us"))


FOLLOW_UPS = """
r AS (SELECT l_orderkey AS session_id, l_orderkey * 10 + l_linenumber AS request_id, l_linenumber > 1 OR l_orderkey % 5 = 0 AS follow_up, l_orderkey AS job_id, min(l_shipdate) AS asked_at,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 10 = 0 THEN l_orderkey * 10 + 2 WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 3 AND l_orderkey % 7 = 0 THEN l_orderkey * 10 + 9 ELSE l_orderkey * 10 + l_linenumber - 1 END AS parent_id
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
j AS (SELECT o_orderkey AS job_id, o_orderdate AS finished_at, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Partial' ELSE 'Running' END AS status FROM orders)"""


def follow_up_requests(lines: DataFrame) -> DataFrame:
    """Lines of an order as requests that follow up each other; some chains break, some run in a circle, some have no original."""
    key, n = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    parent = F.when((n == 1) & (key % 10 == 0), key * 10 + 2).when((n == 3) & (key % 7 == 0), key * 10 + 9).when(n != 1, key * 10 + n - 1)
    return lines.select(key.alias("session_id"), (key * 10 + n).alias("request_id"), parent.alias("parent_id"), ((n > 1) | (key % 5 == 0)).alias("follow_up"),
                        key.alias("job_id"), F.col("l_shipdate").cast("timestamp").alias("asked_at"))


def finished_orders(orders: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", F.lit("Completed")).when(F.col("o_orderstatus") == "P", F.lit("Partial")).otherwise(F.lit("Running"))
    return orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("finished_at"), status.alias("status"))


_ROOTS = """
w AS (SELECT request_id, request_id AS cur, 0 AS d FROM r UNION ALL SELECT w.request_id, r.parent_id, d + 1 FROM w JOIN r ON r.request_id = w.cur WHERE r.follow_up AND r.parent_id IS NOT NULL AND d < 20),
a AS (SELECT w.request_id, r.request_id AS root FROM w JOIN r ON r.request_id = w.cur WHERE NOT r.follow_up)"""


@plan("stream_resolved_completions", sql=f"""
WITH RECURSIVE {FOLLOW_UPS}, {_ROOTS}
SELECT DISTINCT a.root AS request_id, j.job_id, j.status, sha256(j.job_id || ':' || a.root) AS event_id FROM j JOIN r USING (job_id) JOIN a ON a.request_id = r.request_id WHERE j.status <> 'Running'""")
def stream_resolved_completions(e: Entities) -> DataFrame:
    """Completions of finished jobs for the originals behind their follow-ups, from two streams."""
    folder = scratch_folder(e.spark, "resolved")
    T.resolved_completion_log(finished_orders(stream(e, "orders")), follow_up_requests(stream(e, "lineitem")), folder, f"{folder}/checkpoint", horizon="4000 days")
    return e.spark.read.schema("request_id bigint, job_id bigint, status string, event_id string").parquet(f"{folder}/events").select("request_id", "job_id", "status", "event_id")


@plan("resolved_completions", sql=f"""
WITH RECURSIVE {FOLLOW_UPS}, {_ROOTS},
e AS (SELECT DISTINCT a.root AS request_id, j.job_id, j.status FROM j JOIN r USING (job_id) JOIN a ON a.request_id = r.request_id WHERE j.status <> 'Running'),
q AS (SELECT request_id, job_id, status, request_id % 6 + 1 AS quantity, request_id % 3 <> 0 AS new_only, request_id % 4 <> 0 AS served, request_id % 3 AS returned FROM e),
t AS (SELECT *, greatest(0, quantity - CASE WHEN new_only AND served THEN returned ELSE 0 END) AS target FROM q),
m AS (SELECT t.request_id, l_partkey AS lead_id, min(l_linenumber) AS place, any_value(target) AS target, any_value(new_only) AS new_only FROM t JOIN lineitem ON l_orderkey = job_id GROUP BY 1, 2),
f AS (SELECT request_id, lead_id, target, row_number() OVER (PARTITION BY request_id ORDER BY place, lead_id) AS position FROM m WHERE NOT (new_only AND lead_id % 4 = 0))
SELECT t.request_id, t.job_id, t.status, f.lead_id, f.position FROM t JOIN f USING (request_id) WHERE f.position <= f.target""")
def resolved_completions(e: Entities) -> DataFrame:
    """The batch twin, with the rows each completion delivers: those served before are left out where only new ones are wanted."""
    events = D.resolved_completions(finished_orders(e.orders), follow_up_requests(e.lineitem).dropDuplicates(["request_id"]))
    k = F.col("request_id")
    asked = events.select("request_id", "job_id", "status", (k % 6 + 1).alias("quantity"), (k % 3 != 0).alias("new_only"),
                          F.when(k % 4 != 0, as_of()).alias("served_at"), (k % 3).alias("records_returned"))
    matches = asked.join(e.lineitem, asked.job_id == F.col("l_orderkey")).groupBy("request_id", F.col("l_partkey").alias("lead_id")).agg(F.min("l_linenumber").alias("place"))
    rows = D.completion_rows(asked, matches, matches.filter("lead_id % 4 = 0"), F.lit(0))
    return rows.join(asked.select("request_id", "job_id", "status"), "request_id").select("request_id", "job_id", "status", "lead_id", "position")
