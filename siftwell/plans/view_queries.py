"""Exports and displayed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import planning as P
from ..operators import standardize as Z
from ..operators import views as V
from ..operators.ordered import day_bucket
from .bindings import Entities
from .registry import plan
from .report_queries import source_table


def shown_leads(e: Entities) -> DataFrame:
    orgs = e.organizations.select("org_id", F.col("org_name").alias("company"), "email", "phone", "website")
    return e.leads.drop("industry").join(orgs, "org_id", "left").withColumns({
        "location": F.when(F.col("city").isNotNull(), F.concat_ws(", ", "city", "us_state")), "state": F.col("us_state"),
        "name": F.when(F.col("lead_id") % 4 == 0, F.lit("Jane Doe"))})


@plan("lead_export", uses="leads organizations", sql="""
SELECT CAST(lead_id AS VARCHAR) AS "ID", CASE WHEN lead_id % 4 = 0 THEN 'Jane Doe' ELSE '' END AS "Name", coalesce(org_name, '') AS "Company", '' AS "Title", coalesce(email, '') AS "Email", coalesce(phone, '') AS "Phone",
  CASE WHEN city IS NULL THEN '' ELSE concat_ws(', ', city, us_state) END AS "Location", coalesce(city, '') AS "City", coalesce(us_state, '') AS "State", source_code AS "Source Code",
  coalesce(strftime(due_at, '%Y-%m-%dT%H:%M:%S'), '') AS "Due At", status AS "Status", coalesce(website, '') AS "Website", '' AS "Industry", strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS "Created At" FROM leads LEFT JOIN organizations USING (org_id)""")
def lead_export(e: Entities) -> DataFrame:
    """Fifteen export columns of every lead, missing values empty."""
    return V.laid_out(shown_leads(e), V.LEAD_EXPORT)


@plan("request_export", uses="requests", sql="""
SELECT CAST(request_id AS VARCHAR) AS "ID", CAST(user_id AS VARCHAR) AS "User ID", '' AS "User Name", decision AS "Decision", status AS "Status", coalesce(CAST(job_id AS VARCHAR), '') AS "Job ID", CAST(records_returned AS VARCHAR) AS "Records Returned",
  '' AS "Records New", '' AS "Records Updated", coalesce(strftime(served_at, '%Y-%m-%dT%H:%M:%S'), '') AS "Served At", strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS "Created At" FROM requests WHERE cancelled IS NOT TRUE""")
def request_export(e: Entities) -> DataFrame:
    """Eleven export columns of the request log."""
    return V.laid_out(e.requests.filter(~F.coalesce("cancelled", F.lit(False))), V.REQUEST_EXPORT)


@plan("delivery_export", uses="deliveries leads organizations", sql="""
SELECT CAST(d.user_id AS VARCHAR) AS "User", '' AS "Query ID", '''=show ' || d.user_id AS "Request", strftime(d.served_at, '%Y-%m-%dT%H:%M:%S') AS "Served At", CAST(d.lead_id AS VARCHAR) AS "Record ID", coalesce(org_name, '') AS "Company", '' AS "Title", '' AS "Category",
  coalesce(city, '') AS "City", coalesce(us_state, '') AS "State", coalesce(email, '') AS "Email", coalesce(phone, '') AS "Phone", coalesce(l.source_code, '') AS "Source", '' AS "Source URL", CAST(d.record_version AS VARCHAR) AS "Record Version", 'true' AS "Historical Snapshot", '' AS "Request Fulfilled",
  '''-' AS "Delivery Kind", '' AS "Matching Records", '' AS "Requested Records", '{}' AS "Understood Request" FROM deliveries d LEFT JOIN leads l USING (lead_id) LEFT JOIN organizations USING (org_id)""")
def delivery_export(e: Entities) -> DataFrame:
    """Twenty-one export columns per delivered record, guarded against spreadsheet formulas."""
    rows = e.deliveries.join(shown_leads(e), "lead_id", "left").withColumns({
        "user": F.col("user_id"), "request": F.concat(F.lit("=show "), "user_id"), "has_snapshot": F.lit(True), "delivery_kind": F.lit("-"), "criteria": F.lit("{}")})
    return V.laid_out(rows, V.DELIVERY_EXPORT, safe=True)


@plan("sheet_export", uses="leads organizations", sql="""
SELECT CAST(row_number() OVER (ORDER BY created_at, lead_id) AS VARCHAR) AS "#", CASE WHEN lead_id % 4 = 0 THEN 'Jane Doe' ELSE coalesce(org_name, '') END AS "Contact Name", coalesce(org_name, '') AS "Company", '' AS "Title", coalesce(email, '') AS "Email", coalesce(phone, '') AS "Phone",
  coalesce(nullif(concat_ws(', ', city, us_state), ''), '') AS "Location", status AS "Status", coalesce(website, '') AS "Website", '' AS "Industry", source_code AS "Source", '' AS "Source URL", '' AS "Notes" FROM leads LEFT JOIN organizations USING (org_id)""")
def sheet_export(e: Entities) -> DataFrame:
    """Numbered sheet rows in order of creation, counted day by day."""
    return V.sheet_rows(shown_leads(e), day_bucket(F.col("created_at")), [F.col("created_at"), F.col("lead_id")])


@plan("dataset_views", sql="""
SELECT p_brand AS dataset_id, CASE WHEN count(*) % 2 = 0 THEN count(*) ELSE 0 END AS records_count, CAST(0 AS INTEGER) AS tags, CASE WHEN min(p_size) % 2 = 0 THEN 'Completed' END AS status, CASE WHEN count(*) % 3 = 0 THEN p_brand ELSE 'Untitled Session' END AS title,
  '{"brand":"' || p_brand || '","at":"2024-01-01T00:00:00"}' AS payload FROM part GROUP BY p_brand""")
def dataset_views(e: Entities) -> DataFrame:
    """Null and default rules of dataset and session views, and JSON with ISO times."""
    n = F.count(F.lit(1))
    rows = e.part.groupBy(F.col("p_brand").alias("dataset_id")).agg(
        F.when(n % 2 == 0, n).alias("records_count"), F.when(F.min("p_size") % 2 == 0, F.lit("Completed")).otherwise(F.lit("")).alias("status"), F.when(n % 3 == 0, F.first("p_brand")).alias("title"))
    none = F.lit(None)
    full = rows.withColumns({"verified_count": none.cast("bigint"), "duplicates_count": none.cast("bigint"), "description": none.cast("string"), "created_by": F.lit(""), "tags": none.cast("array<string>"),
                             "brand": F.col("dataset_id"), "at": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")})
    return V.session_view(V.dataset_view(full)).select("dataset_id", F.col("records_count"), F.size("tags").alias("tags"), "status", "title", V.json_safe("brand", "at").alias("payload"))


@plan("message_views", sql="""
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'bot' ELSE role END AS role, CAST(0 AS INTEGER) AS suggestions FROM conversations""")
def message_views(e: Entities) -> DataFrame:
    """Null rules of message views."""
    rows = e.conversations.select("conv_id", "turn", F.lit("bot").alias("sender"), F.when(F.col("turn") % 3 != 0, F.col("role")).alias("role"), F.lit(None).cast("array<string>").alias("suggestions"))
    return V.message_view(rows).select("conv_id", "turn", "role", F.size("suggestions").alias("suggestions"))


@plan("source_catalog", sql="""
SELECT 'src' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS source_id, n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0 AS ready, CASE WHEN n_nationkey % 4 = 0 THEN 'unknown source' WHEN n_nationkey % 3 = 0 THEN 'missing login' END AS reason FROM nation""")
def source_catalog(e: Entities) -> DataFrame:
    """Sources with readiness and the reason why one cannot be used."""
    k = F.col("n_nationkey")
    state = e.nation.filter(k % 4 != 0).select(F.concat(F.lit("src"), F.lpad(k.cast("string"), 2, "0")).alias("source_id"), (k % 3 != 0).alias("ready"), F.when(k % 3 == 0, F.lit("missing login")).alias("reason"))
    return P.source_catalog(source_table(e).drop("ready"), state).select("source_id", "ready", "reason")


@plan("stored_field_maps", sql="""
SELECT event_type AS source_code, count(*) AS records, count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN 'Event ' || event_id END) AS titled FROM events GROUP BY 1""")
def stored_field_maps(e: Entities) -> DataFrame:
    """Records projected with the map stored for their source."""
    kinds = e.events.select(F.col("event_type").alias("source_code")).distinct()
    maps = kinds.filter(F.col("source_code").isin("view", "click")).withColumn("field_map", F.create_map(F.lit("title"), F.lit("label"), F.lit("source_code"), F.lit("kind")))
    records = e.events.select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("source_code"), F.create_map(
        F.lit("label"), F.concat(F.lit("Event "), "event_id"), F.lit("kind"), F.col("event_type"), F.lit("source_code"), F.col("event_type")).alias("raw"))
    mapped = Z.project_with_map(Z.attach_field_maps(records, maps))
    return mapped.groupBy("source_code").agg(F.count(F.lit(1)).alias("records"), F.count("title").alias("titled"))


@plan("trade_defaults", uses="organizations", sql="""
SELECT org_id, CASE WHEN org_id % 2 = 0 THEN 'Roofing Contractor' ELSE industry END AS category, CASE org_state WHEN 'NY' THEN 'New York City' WHEN 'CA' THEN 'Los Angeles' END AS city FROM organizations""")
def trade_defaults(e: Entities) -> DataFrame:
    """Canonical category of a trade alias and the default city of a state."""
    alias = F.when(F.col("org_id") % 2 == 0, F.lit("ROOFERS")).otherwise(F.col("industry"))
    return e.organizations.select("org_id", P.canonical_trade(alias, {"roofer": "Roofing Contractor", "roofing": "Roofing Contractor"}).alias("category"),
                                  P.default_city(F.lower("org_state"), {"NY": "New York City", "CA": "Los Angeles"}).alias("city"))
