"""Request log at depth, timelines, details, and duplicate clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import request_log as L
from .bindings import Entities
from .registry import plan

_SHOWN = "r.cancelled IS NOT TRUE AND r.kind IS DISTINCT FROM 'reset_receipt'"


@plan("request_log_deep", uses="requests jobs", sql=f"""
WITH f AS (SELECT r.* FROM requests r LEFT JOIN jobs j USING (job_id) WHERE {_SHOWN} AND (j.script_id = 'view' OR r.source_id = 'view') AND r.decision <> 'KB'
  AND r.created_at >= TIMESTAMP '2024-01-02' AND r.created_at < TIMESTAMP '2024-01-29'),
p AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, request_id) AS position, count(*) OVER () AS total FROM f)
SELECT 'page' AS kind, request_id, user_id, decision, created_at, position, total FROM p WHERE position > 140 AND position <= 160
UNION ALL SELECT 'after', request_id, user_id, decision, created_at, position, total FROM p WHERE position > 160 AND position <= 180
UNION ALL SELECT 'user', request_id, user_id, decision, created_at, row_number() OVER (ORDER BY created_at DESC, request_id), count(*) OVER ()
  FROM (SELECT r.* FROM requests r WHERE {_SHOWN} AND r.user_id = 7 AND r.decision = 'DB') r""")
def request_log_deep(e: Entities) -> DataFrame:
    """Page 8 of the filtered log with its total, the page after its last row, and the log of one user and decision."""
    newest_first = [F.col("created_at").desc(), F.col("request_id")]
    hour = -F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / 3600)
    shown = ["request_id", "user_id", "decision", "created_at", "position", "total"]
    rows = L.request_log(e.requests, e.jobs, source="view", first="2024-01-02", last="2024-01-28").filter("decision <> 'KB'")
    page = L.deep_page(rows, hour, newest_first, 8)
    last = page.orderBy(F.col("position").desc()).select("created_at", "request_id").first()
    after = L.page_after(rows, "created_at", "request_id", tuple(last) if last else None)
    after = L.deep_page(rows, hour, newest_first, 9).join(after.select("request_id"), "request_id")
    one = L.deep_page(L.request_log(e.requests, e.jobs, user=7, decision="DB"), hour, newest_first, 1, 100)
    named = [df.select(F.lit(kind).alias("kind"), *shown) for kind, df in (("page", page), ("after", after), ("user", one))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@plan("user_timelines", uses="requests", sql=f"""
WITH p AS (SELECT r.*, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, request_id) AS position, count(*) OVER (PARTITION BY user_id) AS total FROM requests r WHERE {_SHOWN})
SELECT user_id, c_name AS user_name, position, total, request_id, decision, status, job_id, records_returned, created_at FROM p LEFT JOIN customer ON c_custkey = user_id WHERE position > 10 AND position <= 20""")
def user_timelines(e: Entities) -> DataFrame:
    """The second page of ten of every user's requests, newest first."""
    users = e.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    bucket = -F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / 86400)
    rows = L.user_timelines(e.requests, users, bucket, 2, 10)
    return rows.select("user_id", "user_name", "position", "total", "request_id", "decision", "status", "job_id", "records_returned", "created_at")


@plan("request_details", uses="requests jobs", sql="""
WITH t AS (SELECT conv_id AS request_id, string_agg(turn || ' ' || role || ' ' || md5(coalesce(text, '')), '; ' ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY 1),
s AS (SELECT l_orderkey AS request_id, string_agg(l_linenumber || ' ' || l_partkey || ' part ' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey) AS rows_served FROM lineitem GROUP BY 1)
SELECT r.request_id, r.decision, j.status AS job_status, j.found AS job_found, coalesce(transcript, '') AS transcript, coalesce(rows_served, '') AS rows_served
FROM requests r LEFT JOIN jobs j USING (job_id) LEFT JOIN t ON t.request_id = r.request_id LEFT JOIN s ON s.request_id = r.request_id WHERE r.cancelled IS NOT TRUE""")
def request_details(e: Entities) -> DataFrame:
    """Every request with its job, its whole transcript and the rows served, in order."""
    messages = e.conversations.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("at"), F.col("role").alias("message_id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    served = e.lineitem.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("lead_id"),
                               F.concat(F.lit("part "), "l_partkey").alias("snapshot"))
    found = L.request_details(e.requests, e.jobs.select("job_id", "status", "found"), messages, served)
    talk = F.transform("transcript", lambda m: F.concat_ws(" ", m["at"], m["role"], F.md5(m["text"])))
    rows = F.transform("rows_served", lambda r: F.concat_ws(" ", r["rank"], r["lead_id"], r["snapshot"]))
    return found.select("request_id", "decision", F.col("job.status").alias("job_status"), F.col("job.found").alias("job_found"),
                        F.array_join(talk, "; ").alias("transcript"), F.array_join(rows, "; ").alias("rows_served"))


@plan("duplicate_clusters", sql="""
WITH RECURSIVE k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 < 3 THEN 'org ' || c_custkey // 4 END AS org_key, CASE WHEN c_custkey % 3 = 0 THEN 'tel ' || c_custkey * 7 % 601 ELSE '' END AS phone,
  CASE WHEN c_custkey % 7 = 0 THEN 'd' || c_nationkey || c_mktsegment END AS domain, c_acctbal > 0 AS verified FROM customer),
v AS (SELECT id, 'o' || org_key AS value FROM k WHERE org_key IS NOT NULL UNION ALL SELECT id, 'p' || phone FROM k WHERE phone <> '' UNION ALL SELECT id, 'd' || domain FROM k WHERE domain IS NOT NULL),
s AS (SELECT id, min(id) OVER (PARTITION BY value) AS first FROM v), b AS (SELECT id, first FROM s UNION SELECT first, id FROM s),
w AS (SELECT id, id AS reached FROM k UNION SELECT w.id, b.first FROM w JOIN b ON b.id = w.reached),
c AS (SELECT id, min(reached) AS cluster_id, count(*) AS cluster_size FROM w GROUP BY 1)
SELECT id AS record_id, cluster_id, cluster_size, cluster_id <> id AS is_duplicate, cluster_size > 1 AS has_duplicates, NOT verified AS unverified FROM k JOIN c USING (id)""")
def duplicate_clusters(e: Entities) -> DataFrame:
    """Records that share an organisation key, a phone or a domain, with flags for duplicates and unverified ones."""
    k = F.col("c_custkey")
    records = e.customer.select(k.alias("record_id"), F.when(k % 5 < 3, F.concat(F.lit("org "), F.floor(k / 4))).alias("org_key"),
                                F.when(k % 3 == 0, F.concat(F.lit("tel "), k * 7 % 601)).otherwise(F.lit("")).alias("phone"),
                                F.when(k % 7 == 0, F.concat(F.lit("d"), "c_nationkey", "c_mktsegment")).alias("domain"), (F.col("c_acctbal") > 0).alias("verified"))
    groups = C.duplicate_clusters(records, "record_id", ["org_key", "phone", "domain"])
    return C.quality_flags(records, groups, "record_id", F.col("verified")).select("record_id", "cluster_id", "cluster_size", "is_duplicate", "has_duplicates", "unverified")
