"""Deliveries, jobs, sessions, conversations and their streaming twins in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import completion_percentage, job_outcome, job_progress
from ..operators import conversation as C
from ..operators import deliver as D
from ..operators import jobs as J
from ..operators import search as S
from ..operators.ordered import day_bucket, last_rows, running_sum
from .bindings import Entities
from .registry import plan

JOBS_AS_OF = "2024-01-31 00:00:00"


def jobs_as_of():
    return F.lit(JOBS_AS_OF).cast("timestamp_ntz")


@plan("delivery_rank", sql="""
WITH u AS (SELECT l_suppkey AS request_id, l_orderkey AS lead_id, min((l_shipdate, l_linenumber, l_partkey)) AS first,
    arg_max(l_quantity, (l_shipdate, l_linenumber, l_partkey)) AS quantity FROM lineitem GROUP BY ALL)
SELECT request_id, lead_id, row_number() OVER (PARTITION BY request_id ORDER BY first, lead_id) - 1 AS rank, quantity FROM u""")
def delivery_rank(e: Entities) -> DataFrame:
    """Zero-based rank per delivery after removing repeats."""
    rows = e.lineitem.select(
        F.col("l_suppkey").alias("request_id"), F.col("l_orderkey").alias("lead_id"), F.col("l_quantity").alias("quantity"),
        "l_shipdate", "l_linenumber", "l_partkey")
    position = F.struct("l_shipdate", "l_linenumber", "l_partkey")
    ranked = D.delivery_ranks(rows, "request_id", "lead_id", position, lambda first: day_bucket(first["l_shipdate"]))
    return ranked.select("request_id", "lead_id", "rank", "quantity")


@plan("delivery_snapshot", uses="requests", sql="""
SELECT d.l_suppkey AS request_id, count(*) AS rows_to_add FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) d
WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.request_id = d.l_suppkey AND served_at IS NOT NULL) GROUP BY 1""")
def delivery_snapshot(e: Entities) -> DataFrame:
    """Rows to freeze: only for requests that were not served before."""
    ranked = e.lineitem.select(F.col("l_suppkey").alias("request_id"), F.col("l_orderkey").alias("lead_id")).distinct()
    return D.new_deliveries(e.requests, ranked, "request_id").groupBy("request_id").agg(F.count(F.lit(1)).alias("rows_to_add"))


@plan("stale_delivery_rows", sql="""
SELECT l_suppkey AS request_id, l_orderkey AS lead_id FROM lineitem WHERE l_linestatus = 'F'
EXCEPT SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_linestatus <> 'F'""")
def stale_delivery_rows(e: Entities) -> DataFrame:
    """Rows of the earlier attempt that the new attempt no longer has."""
    rows = e.lineitem.select(F.col("l_suppkey").alias("request_id"), F.col("l_orderkey").alias("lead_id"), "l_linestatus")
    before = rows.filter("l_linestatus = 'F'").drop("l_linestatus").distinct()
    return D.stale_rows(before, rows.filter("l_linestatus <> 'F'"), ["request_id", "lead_id"])


@plan("fulfilment", uses="requests", sql="""
WITH m AS (SELECT l_suppkey AS request_id, count(DISTINCT l_orderkey) AS matching FROM lineitem GROUP BY 1),
t AS (SELECT request_id, coalesce(matching, 0) AS matching, coalesce(cancelled, FALSE) AS off,
  greatest(0, 100 + request_id % 900 - CASE WHEN request_id % 2 = 0 AND served_at IS NOT NULL THEN records_returned ELSE 0 END) AS target FROM requests LEFT JOIN m USING (request_id))
SELECT request_id, matching, CAST(target AS BIGINT) AS target, CAST(greatest(0, target - matching) AS BIGINT) AS remaining, NOT off AND matching >= target AS fulfilled,
  CAST(least(100, floor(matching * 100 / greatest(target, 1))) AS INTEGER) AS percent FROM t""")
def fulfilment(e: Entities) -> DataFrame:
    """Matches against the target of every request, new-only targets reduced by what was served."""
    requests = e.requests.withColumns({"quantity": F.col("request_id") % 900 + 100, "new_only": F.col("request_id") % 2 == 0})
    matches = e.lineitem.select(F.col("l_suppkey").alias("request_id"), F.col("l_orderkey").alias("lead_id"))
    return D.fulfilment(requests, matches, "request_id").select(
        "request_id", "matching", "target", "remaining", "fulfilled", completion_percentage(F.col("matching"), F.col("target")).alias("percent"))


@plan("deliveries_per_user", uses="requests", sql="""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY served_at DESC, request_id) AS position, count(*) OVER (PARTITION BY user_id) AS total
  FROM requests WHERE served_at IS NOT NULL AND cancelled IS NOT TRUE AND (records_returned > 0 OR kind = 'event'))
SELECT user_id, total, position, request_id, served_at FROM d WHERE position BETWEEN 21 AND 40""")
def deliveries_per_user(e: Entities) -> DataFrame:
    """Second page of every user's deliveries, newest first."""
    page = D.user_deliveries(e.requests, -day_bucket(F.col("served_at")), page=2, page_size=20)
    return page.select("user_id", "total", "position", "request_id", "served_at")


@plan("snapshot_available", sql="""
SELECT l_suppkey AS request_id, bool_and(l_discount > 0.0) AS snapshot_available, count(*) AS n FROM lineitem GROUP BY 1""")
def snapshot_available(e: Entities) -> DataFrame:
    """Whether every row of a delivery has its snapshot."""
    return e.lineitem.groupBy(F.col("l_suppkey").alias("request_id")).agg(
        F.bool_and(F.col("l_discount") > 0.0).alias("snapshot_available"), F.count(F.lit(1)).alias("n"))


@plan("completion_events", uses="jobs requests", sql="""
SELECT r.request_id, r.job_id, sha256(r.job_id || ':' || r.request_id) AS event_id, j.status AS job_status FROM requests r JOIN jobs j USING (job_id)
WHERE j.status IN ('Completed', 'Partial', 'Failed', 'Cancelled') AND coalesce(kind, '') NOT IN ('event', 'confirmation') AND r.created_at >= TIMESTAMP '2024-01-10'""")
def completion_events(e: Entities) -> DataFrame:
    """One completion per finished job and subscribed request; those already recorded are not repeated."""
    recorded = D.completion_events(e.jobs, e.requests.filter(F.col("created_at") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")))
    return D.completion_events(e.jobs, e.requests, recorded).select("request_id", "job_id", "event_id", "job_status")


@plan("exports", uses="requests", sql="""
SELECT CAST(request_id AS VARCHAR) AS "ID", CASE WHEN request_id % 3 = 0 THEN '''=cmd' || request_id WHEN request_id % 3 = 1 THEN '' ELSE 'text' END AS "Request",
  decision AS "Decision", coalesce(CAST(job_id AS VARCHAR), '') AS "Job ID", coalesce(strftime(served_at, '%Y-%m-%d'), '') AS "Served At" FROM requests""")
def exports(e: Entities) -> DataFrame:
    """Export columns as text with the spreadsheet guard."""
    k = F.col("request_id")
    note = F.when(k % 3 == 0, F.concat(F.lit("=cmd"), k)).when(k % 3 == 2, F.lit("text"))
    return D.export_columns(e.requests, {"ID": k, "Request": note, "Decision": F.col("decision"), "Job ID": F.col("job_id"),
                                         "Served At": F.date_format("served_at", "yyyy-MM-dd")}, safe=True)


@plan("request_log_page", uses="requests jobs", sql="""
SELECT r.request_id, r.user_id, r.decision, r.created_at FROM requests r LEFT JOIN jobs j USING (job_id)
WHERE r.cancelled IS NOT TRUE AND r.kind IS DISTINCT FROM 'reset_receipt' AND (j.script_id = 'view' OR r.source_id = 'view')
  AND r.created_at >= TIMESTAMP '2024-01-05' AND r.created_at < TIMESTAMP '2024-01-21' ORDER BY r.created_at DESC, r.request_id LIMIT 20 OFFSET 20""")
def request_log_page(e: Entities) -> DataFrame:
    """A page of the request log by source and inclusive day range."""
    jobs = e.jobs.select("job_id", "script_id")
    shown = (~F.coalesce("cancelled", F.lit(False))) & ~F.col("kind").eqNullSafe(F.lit("reset_receipt"))
    rows = e.requests.filter(shown & S.day_range(F.col("created_at"), "2024-01-05", "2024-01-20")).join(jobs, "job_id", "left")
    rows = rows.filter(F.coalesce(F.col("script_id") == "view", F.lit(False)) | (F.col("source_id") == "view"))
    return S.page(rows, [F.col("created_at").desc(), F.col("request_id")], limit=20, offset=20).select("request_id", "user_id", "decision", "created_at")


@plan("json_flag_filter", sql="""
SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IS DISTINCT FROM 5
  AND (CAST(json_extract_string(props, '$.k') AS BIGINT) > 90) IS NOT TRUE GROUP BY 1""")
def json_flag_filter(e: Entities) -> DataFrame:
    """Null-safe negation of values inside JSON."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.events.filter(~k.eqNullSafe(F.lit(5)) & ~F.coalesce(k > 90, F.lit(False))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@plan("quality_flags", sql="""
SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value >= 1 GROUP BY 1""")
def quality_flags(e: Entities) -> DataFrame:
    """Completed runs with at least one record, per user."""
    return S.equality_filter(e.events, {"event_type": "purchase"}).filter("value >= 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@plan("job_view", uses="jobs", sql=f"""
WITH s AS (SELECT *, CAST(floor(epoch(TIMESTAMP '{JOBS_AS_OF}' - started_at)) AS BIGINT) AS secs FROM jobs)
SELECT job_id, status, found, CASE WHEN status = 'Running' AND started_at IS NOT NULL THEN
  lpad(CAST(secs // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(secs // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(secs % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(secs % 60 AS VARCHAR), 2, '0') END AS duration,
  CAST(least(99, found * 100 // target) AS INTEGER) AS progress FROM s""")
def job_view(e: Entities) -> DataFrame:
    """Displayed jobs with live duration and progress."""
    return J.job_view(e.jobs, jobs_as_of()).select("job_id", "status", "found", F.col("view_duration").alias("duration"),
                                                   job_progress(F.col("found"), F.col("target")).alias("progress"))


@plan("job_outcomes", uses="jobs", sql="""
SELECT job_id, CASE WHEN job_id % 11 = 0 THEN 'Cancelled' WHEN job_id % 13 = 0 THEN 'Failed' WHEN s = 0 THEN 'Failed' WHEN s < target AND job_id % 5 <> 0 THEN 'Partial'
  WHEN failed > 0 OR skipped > 0 OR job_id % 5 = 0 THEN 'Partial' ELSE 'Completed' END AS outcome FROM (SELECT *, inserted + updated + unchanged AS s FROM jobs)""")
def job_outcomes(e: Entities) -> DataFrame:
    """Final state of every job by the precedence of the rules."""
    k = F.col("job_id")
    return e.jobs.select(k, job_outcome(
        cancelled=k % 11 == 0, captcha_timeout=k % 13 == 0, saved=F.col("inserted") + F.col("updated") + F.col("unchanged"), target=F.col("target"),
        source_error=k % 5 == 0, failed=F.col("failed"), skipped=F.col("skipped")).alias("outcome"))


@plan("job_dedup", uses="jobs", sql="""
WITH stored AS (SELECT * FROM jobs WHERE created_at < TIMESTAMP '2024-01-16'), asked AS (SELECT *, coalesce(idempotency_key, 'job:' || job_id) AS req FROM jobs WHERE created_at >= TIMESTAMP '2024-01-16'),
lead_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req ORDER BY created_at, job_id) AS rn FROM asked) WHERE rn = 1),
m AS (SELECT l.*, coalesce((SELECT min(s.job_id) FROM stored s WHERE s.idempotency_key = l.idempotency_key),
  a.job_id) AS known FROM lead_rows l LEFT JOIN (SELECT script_id, params_hash, arg_min(job_id, (created_at, job_id)) AS job_id FROM stored WHERE status IN ('Queued', 'Running', 'WaitingForUser') GROUP BY 1, 2) a USING (script_id, params_hash)),
d AS (SELECT req, coalesce(known, first_value(job_id) OVER (PARTITION BY script_id, params_hash, known IS NULL ORDER BY created_at, job_id)) AS survivor FROM m)
SELECT job_id, survivor, survivor = job_id AS created FROM asked JOIN d USING (req)""")
def job_dedup(e: Entities) -> DataFrame:
    """Asked jobs answered by stored, active or earlier asked ones."""
    late = F.col("created_at") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return J.reuse_jobs(e.jobs.filter(~late), e.jobs.filter(late)).select("job_id", "survivor", "created")


@plan("queue_position", uses="jobs", sql="""
SELECT job_id, row_number() OVER (ORDER BY created_at, job_id) AS position, (SELECT count(*) FROM jobs WHERE status IN ('Running', 'WaitingForUser')) AS running
FROM jobs WHERE status = 'Queued'""")
def queue_position(e: Entities) -> DataFrame:
    """Place in the queue, counted day by day, and how many jobs run."""
    return J.queue_positions(e.jobs, day_bucket(F.col("created_at"))).select("job_id", "position", "running")


@plan("stale_jobs", uses="jobs", sql=f"""
SELECT job_id, status FROM jobs WHERE status IN ('Running', 'WaitingForUser') AND coalesce(heartbeat_at, started_at, created_at) < TIMESTAMP '{JOBS_AS_OF}' - INTERVAL 500000 SECOND""")
def stale_jobs(e: Entities) -> DataFrame:
    """Running jobs whose last sign of life is too old."""
    rows = e.jobs.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return J.stale_jobs(rows, jobs_as_of(), 500_000).select("job_id", "status")


@plan("watchdog_gaps", sql="""
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run_no FROM g)
SELECT user_id, run_no, min(ts) AS started_at, max(ts) AS last_record_at, count(*) AS records FROM n GROUP BY 1, 2""")
def watchdog_gaps(e: Entities) -> DataFrame:
    """Runs closed by a gap without records; batch twin of the streaming watchdog."""
    return J.gap_sessions(e.events, "user_id", "ts", "event_id", day_bucket(F.col("ts")), 6 * 3600)


@plan("status_transitions", uses="jobs", sql="""
WITH p AS (SELECT created_by, job_id, status, lag(status) OVER (PARTITION BY created_by ORDER BY created_at, job_id) AS before FROM jobs)
SELECT before, status, count(*) AS n, bool_and((before = 'Queued' AND status IN ('Running', 'Cancelled')) OR (before = 'Running' AND status IN ('WaitingForUser', 'Completed', 'Partial', 'Failed', 'Cancelled'))
  OR (before = 'WaitingForUser' AND status IN ('Running', 'Failed', 'Cancelled'))) AS allowed FROM p WHERE before <> status GROUP BY 1, 2""")
def status_transitions(e: Entities) -> DataFrame:
    """State changes with before and after, and whether they are allowed."""
    changes = J.state_changes(e.jobs, "created_by", "status", day_bucket(F.col("created_at")), [F.col("created_at"), F.col("job_id")])
    return changes.groupBy("before", "status").agg(F.count(F.lit(1)).alias("n"), F.bool_and("allowed").alias("allowed"))


@plan("cancellable_jobs", uses="jobs requests", sql="""
SELECT job_id, created_by, status FROM jobs j WHERE status IN ('Queued', 'Running', 'WaitingForUser')
  AND NOT EXISTS (SELECT 1 FROM requests r WHERE r.job_id = j.job_id AND r.user_id <> j.created_by)""")
def cancellable_jobs(e: Entities) -> DataFrame:
    """Jobs their creators may cancel because nobody else waits for them."""
    return J.cancellable(e.jobs, e.requests).select("job_id", "created_by", "status")


@plan("running_counters", uses="jobs", sql="""
SELECT job_id, created_by, sum(found) OVER w::BIGINT AS found_so_far, sum(inserted + updated + unchanged) OVER w::BIGINT AS verified_so_far FROM jobs
WINDOW w AS (PARTITION BY created_by ORDER BY created_at, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""".replace("sum(found) OVER w::BIGINT", "CAST(sum(found) OVER w AS BIGINT)").replace(
    "sum(inserted + updated + unchanged) OVER w::BIGINT", "CAST(sum(inserted + updated + unchanged) OVER w AS BIGINT)"))
def running_counters(e: Entities) -> DataFrame:
    """Counters as they advance, per creator."""
    sums = {"found_so_far": F.col("found"), "verified_so_far": F.col("inserted") + F.col("updated") + F.col("unchanged")}
    return running_sum(e.jobs, ["created_by"], day_bucket(F.col("created_at")), [F.col("created_at"), F.col("job_id")], sums).select(
        "job_id", "created_by", *sums)


@plan("one_active_session", sql=f"""
SELECT event_id AS session_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 1 THEN 'archived'
  WHEN ts < TIMESTAMP '{JOBS_AS_OF}' - INTERVAL 24 HOUR THEN 'closed' ELSE 'active' END AS status FROM events WHERE event_type = 'signup'""")
def one_active_session(e: Entities) -> DataFrame:
    """Newest session per user stays active, idle ones are closed."""
    sessions = e.events.filter("event_type = 'signup'").select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return J.one_active_session(sessions, jobs_as_of(), 24).select("session_id", "user_id", "status")


@plan("latest_per_key", sql="""
SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(e: Entities) -> DataFrame:
    """Latest run per user and source."""
    return last_rows(e.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@plan("bounded_history", sql="""
WITH m AS (SELECT *, greatest(1, length(text) // 3) AS size FROM conversations WHERE role <> 'system'),
u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM m), f AS (SELECT * FROM u WHERE used <= 300),
s AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS start FROM f GROUP BY 1),
k AS (SELECT conv_id, turn, role, text FROM f JOIN s USING (conv_id) WHERE turn >= start),
l AS (SELECT conv_id, turn, role, right(text, 900) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM m WHERE role = 'user')
  WHERE rn = 1 AND conv_id NOT IN (SELECT conv_id FROM s WHERE start IS NOT NULL))
SELECT conv_id, turn, role, md5(text) AS text FROM k UNION ALL SELECT conv_id, turn, role, md5(text) FROM l""")
def bounded_history(e: Entities) -> DataFrame:
    """Newest turns that fit a budget, starting on a user turn."""
    kept = C.bounded_history(e.conversations, "conv_id", "turn", "role", "text", 300)
    return kept.select("conv_id", "turn", "role", F.md5("text").alias("text"))


@plan("summary_window", sql="""
WITH m AS (SELECT *, greatest(1, length(text) // 3) AS size FROM conversations WHERE role <> 'system'),
u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM m), f AS (SELECT * FROM u WHERE used <= 300),
s AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS start FROM f GROUP BY 1),
b AS (SELECT conv_id, coalesce((SELECT start FROM s WHERE s.conv_id = m.conv_id), max(turn) FILTER (role = 'user')) AS start FROM m GROUP BY conv_id)
SELECT conv_id, turn, text FROM (SELECT c.conv_id, c.turn, md5(left(c.text, 1000)) AS text, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS back
  FROM conversations c JOIN b ON c.conv_id = b.conv_id AND c.turn < b.start
  WHERE c.conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 3)) WHERE back <= 30""")
def summary_window(e: Entities) -> DataFrame:
    """Older turns to summarise in long conversations."""
    kept = C.bounded_history(e.conversations, "conv_id", "turn", "role", "text", 300)
    older = C.summary_candidates(e.conversations, kept, "conv_id", "turn", "text", 3)
    return older.select("conv_id", "turn", F.md5("text").alias("text"))


@plan("orphan_turns", sql="""
WITH x AS (SELECT conv_id, turn, unnest(CASE WHEN role = 'assistant' AND (conv_id + turn) % 2 = 0 THEN range(0, CASE WHEN conv_id % 4 = 0 THEN 2 ELSE 3 END) ELSE [CAST(0 AS BIGINT)] END) AS part,
  role = 'assistant' AND (conv_id + turn) % 2 = 0 AS calling, role FROM conversations)
SELECT conv_id, turn, part FROM x WHERE NOT calling OR conv_id % 4 <> 0""")
def orphan_turns(e: Entities) -> DataFrame:
    """Tool results are kept only together with their complete call."""
    calling = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 2 == 0)
    parts = F.when(calling, F.sequence(F.lit(0), F.when(F.col("conv_id") % 4 == 0, 1).otherwise(2))).otherwise(F.array(F.lit(0)))
    rows = e.conversations.select("conv_id", "turn", calling.alias("calling"), F.explode(parts).alias("part"))
    rows = rows.withColumn("position", F.col("turn") * 10 + F.col("part"))
    result = F.col("calling") & (F.col("part") > 0)
    calls = F.when(F.col("calling") & (F.col("part") == 0), F.array(F.lit("1"), F.lit("2"))).otherwise(F.array().cast("array<string>"))
    kept = C.complete_exchanges(rows, "conv_id", "position", result, calls, F.col("part").cast("string"))
    return kept.select("conv_id", "turn", F.col("part").cast("bigint").alias("part"))


@plan("criteria_carry", uses="requests", sql="""
WITH t AS (SELECT request_id, user_id, created_at, CASE WHEN request_id % 5 = 0 THEN source_id END AS category, CASE WHEN request_id % 17 = 0 THEN 'opportunity' WHEN request_id % 7 = 0 THEN 'company' END AS kind,
  CASE WHEN request_id % 4 = 0 THEN 'NY' WHEN request_id % 9 = 0 THEN 'any' END AS us_state FROM requests),
c AS (SELECT *, last_value(category IGNORE NULLS) OVER w AS pc, last_value(kind IGNORE NULLS) OVER w AS pk FROM t
  WINDOW w AS (PARTITION BY user_id ORDER BY created_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CAST(sum(CASE WHEN category <> pc OR kind <> pk THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, request_id) AS BIGINT) AS segment FROM c)
SELECT request_id, segment, last_value(category IGNORE NULLS) OVER w AS category, last_value(kind IGNORE NULLS) OVER w AS kind, nullif(last_value(us_state IGNORE NULLS) OVER w, 'any') AS us_state FROM s
WINDOW w AS (PARTITION BY user_id, segment ORDER BY created_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def criteria_carry(e: Entities) -> DataFrame:
    """Criteria carried over follow-up turns, starting anew on a switch."""
    k = F.col("request_id")
    turns = e.requests.select(
        k, "user_id", "created_at", F.struct("created_at", "request_id").alias("at"), F.when(k % 5 == 0, F.col("source_id")).alias("category"),
        F.when(k % 17 == 0, F.lit("opportunity")).when(k % 7 == 0, F.lit("company")).alias("kind"),
        F.when(k % 4 == 0, F.lit("NY")).when(k % 9 == 0, F.lit("any")).alias("us_state"))
    carried = C.carry_criteria(turns, "user_id", F.col("at"), day_bucket(F.col("created_at")), "category", "kind", ["us_state"])
    return carried.select("request_id", "segment", "category", "kind", "us_state")


@plan("label_carry", sql=r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT *, CASE WHEN length(line) BETWEEN 1 AND 40 THEN line END AS heading FROM l)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS label FROM h""")
def label_carry(e: Entities) -> DataFrame:
    """Latest short line (a heading) at or above every line of every document."""
    lines = e.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heading = F.when(F.length("line").between(1, 40), F.col("line"))
    marked = lines.select("doc_id", "pos", heading.alias("heading"))
    return C.carry_label(marked, "doc_id", "pos", F.col("heading"), "label").select("doc_id", "pos", F.md5("label").alias("label"))


@plan("request_detail", uses="requests jobs", sql="""
SELECT r.request_id, r.decision, j.status AS job_status, count(c.turn) AS transcript_turns, CAST(coalesce(sum(length(c.text)), 0) AS BIGINT) AS transcript_chars
FROM requests r LEFT JOIN jobs j USING (job_id) LEFT JOIN conversations c ON c.conv_id = r.request_id GROUP BY ALL""")
def request_detail(e: Entities) -> DataFrame:
    """Request with its job and the size of its transcript."""
    talk = e.conversations.groupBy(F.col("conv_id").alias("request_id")).agg(F.count("turn").alias("t"), F.sum(F.length("text")).alias("c"))
    jobs = e.jobs.select("job_id", F.col("status").alias("job_status"))
    zero = F.lit(0).cast("bigint")
    return e.requests.join(jobs, "job_id", "left").join(talk, "request_id", "left").select(
        "request_id", "decision", "job_status", F.coalesce("t", zero).alias("transcript_turns"), F.coalesce("c", zero).alias("transcript_chars"))


