"""The record entities expressed over the given tables, once as DataFrames and once as SQL."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import constant_map, string_array

AS_OF = "1998-06-01 00:00:00"
NATION_STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS NY".split()
CITIES = ["Albany", "Buffalo", "New York", "Austin", "Miami"]
STATUSES = {"1-URGENT": "New", "2-HIGH": "Called", "3-MEDIUM": "Emailed", "4-NOT SPECIFIED": "Interested",
            "5-LOW": "Pending"}
SOURCES = {"P": "municipal", "F": "directory", "O": "social"}


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def days(n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(n.cast("int"))


def choose(c: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(constant_map(values), c)


ROWS_PER_TASK = 2_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to tasks of bounded size by a hash of ``key``.

    Patterns over rendered pages cost about a millisecond a row, so their tasks must follow the rows: a
    table of a million short rows may lie in one file and one row group.
    """
    return df.repartition(max(2, -(-df.count() // ROWS_PER_TASK)), key)


def rendered(df: DataFrame, key: str, *columns) -> DataFrame:
    """Computed columns of rows spread by ``key``, held as values, so that later expressions read them instead of computing them again."""
    return spread(df, key).select(F.inline(F.array(F.struct(*columns))))


class Entities:
    """Lazy DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @functools.cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @functools.cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @functools.cached_property
    def organizations(self) -> DataFrame:
        k = F.col("c_custkey")
        state = F.element_at(string_array(NATION_STATES), F.col("c_nationkey") + 1)
        city = F.element_at(string_array(CITIES), (k % 5 + 1).cast("int"))
        digits = F.concat((k % 700 + 200).cast("string"), (k % 799 + 200).cast("string"),
                          F.lpad((k % 10000).cast("string"), 4, "0"))
        return self.table("customer").select(
            k.alias("org_id"), F.col("c_name").alias("org_name"), F.col("c_mktsegment").alias("industry"),
            city.alias("org_city"), state.alias("org_state"),
            F.when(k % 4 != 0, F.concat(F.lit("https://www.shop"), k % 100, F.lit(".example.com/about"))).alias("website"),
            F.when(k % 3 != 0, F.concat(F.lit("Info"), k, F.lit("@firm"), k % 50, F.lit(".com"))).alias("email"),
            F.when(k % 4 != 1, F.concat(F.lit("("), digits.substr(1, 3), F.lit(") "), digits.substr(4, 3), F.lit("-"),
                                        digits.substr(7, 4))).alias("phone"),
            (F.col("c_acctbal") * 100).cast("bigint").alias("balance_cents"))

    @functools.cached_property
    def leads(self) -> DataFrame:
        k, created = F.col("o_orderkey"), F.col("o_orderdate")
        kind = F.when(k % 3 == 0, F.lit("opportunity")).otherwise(F.lit("company"))
        return (
            self.table("orders")
            .join(self.organizations.select("org_id", "org_city", "org_state", "industry"),
                  F.col("o_custkey") == F.col("org_id"), "left")
            .select(
                k.alias("lead_id"), F.col("o_custkey").alias("org_id"), kind.alias("record_kind"),
                choose(F.col("o_orderpriority"), STATUSES).alias("status"),
                choose(F.col("o_orderstatus"), SOURCES).alias("source_code"),
                created.alias("created_at"),
                F.when((k % 3 == 0) & (k % 5 != 0), created + days(30)).alias("due_at"),
                (created + days(k % 60)).alias("last_seen_at"),
                (k % 3 + 1).cast("int").alias("content_version"),
                F.when(k % 7 != 0, F.col("org_city")).alias("city"),
                F.when(k % 11 != 0, F.col("org_state")).alias("us_state"),
                F.col("org_city"), F.col("org_state"), F.col("industry")))

    @functools.cached_property
    def lead_titles(self) -> DataFrame:
        """Title and category of a lead: name and type of the part on its first line."""
        first = self.table("lineitem").groupBy(F.col("l_orderkey").alias("lead_id")).agg(
            F.min(F.struct("l_linenumber", "l_partkey")).alias("f"))
        parts = self.table("part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("category"))
        worded = F.concat("title", F.when(F.col("lead_id") % 4 == 0, F.lit(" contractor")).otherwise(F.lit("")))
        return first.join(parts, F.col("f.l_partkey") == F.col("p_partkey"), "left").select(
            "lead_id", worded.alias("title"), "category")

    @functools.cached_property
    def titled_leads(self) -> DataFrame:
        return self.leads.join(self.lead_titles, "lead_id", "left")

    @functools.cached_property
    def lead_sources(self) -> DataFrame:
        return self.table("lineitem").select(
            F.lower("l_returnflag").alias("source_code"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_id"),
            F.col("l_orderkey").alias("lead_id"), F.col("l_shipdate").alias("seen_at"))

    @functools.cached_property
    def deliveries(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("lead_id"),
            (F.col("l_linenumber") % 3 + 1).alias("record_version"), F.col("l_shipdate").alias("served_at"))

    @functools.cached_property
    def arrivals(self) -> DataFrame:
        """Raw observations of a lead in arrival order, with fields left blank at times."""
        n = F.col("l_linenumber")
        ordinal = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("identity"), n.alias("line"), ordinal.alias("ordinal"),
            F.when(F.col("l_partkey") % 4 == 0, F.lit("")).when(F.col("l_partkey") % 4 != 1, F.concat(
                F.lit("title "), F.col("l_partkey") % 5)).alias("title"),
            F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("note "), F.col("l_suppkey") % 4)).alias("notes"),
            F.when(F.col("l_quantity") > 10, F.lower("l_returnflag")).alias("category"),
            F.when(F.col("l_tax") > 0.02, F.col("l_shipdate")).alias("due_at"),
            F.col("l_returnflag").alias("source_code"), F.col("l_linestatus").alias("line_status"),
            F.col("l_shipdate").alias("seen_at"))

    @functools.cached_property
    def jobs(self) -> DataFrame:
        """One job per event: source, state, parameters, times and counters."""
        k, n = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
        status = F.element_at(string_array(JOB_STATES), (n % 7 + 1).cast("int"))
        return self.table("events").select(
            k.alias("job_id"), F.col("user_id").alias("created_by"), F.col("event_type").alias("script_id"),
            status.alias("status"), F.md5((n % 10).cast("string")).alias("params_hash"),
            F.when(k % 4 == 0, F.concat(F.lit("key-"), F.floor(k / 12))).alias("idempotency_key"),
            F.col("ts").alias("created_at"),
            F.when(n % 7 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(5))).alias("started_at"),
            F.when(n % 5 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (n % 60).cast("int"), F.lit(0))).alias("heartbeat_at"),
            n.alias("found"), F.floor(n / 2).alias("inserted"), F.floor(n / 4).alias("updated"),
            F.floor(n / 8).alias("unchanged"), (n % 3).alias("failed"), (n % 2).alias("skipped"),
            (n % 50 + 1).alias("target"))

    @functools.cached_property
    def requests(self) -> DataFrame:
        """Request log: one request per event."""
        k, n = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
        code = F.element_at(string_array(REQUEST_DECISIONS), (n % 12 + 1).cast("int"))
        return self.table("events").select(
            k.alias("request_id"), F.col("user_id"), F.floor(k / 10).alias("session_id"), code.alias("decision"),
            F.when(k % 13 == 0, F.lit("llm_unavailable")).otherwise(F.lit("completed")).alias("status"),
            F.when(k % 3 != 0, F.floor(k / 3) * 3 % 1000).alias("job_id"), F.col("event_type").alias("source_id"),
            (n % 30).alias("records_returned"), F.when(n % 6 != 0, F.col("ts")).alias("served_at"),
            F.col("ts").alias("created_at"), F.col("props"),
            F.when(n % 17 == 0, F.lit(True)).when(n % 17 == 1, F.lit(False)).alias("cancelled"),
            F.when(n % 19 == 0, F.lit("reset_receipt")).when(n % 19 == 1, F.lit("event")).alias("kind"))


JOB_STATES = ["Queued", "Running", "WaitingForUser", "Completed", "Partial", "Failed", "Cancelled"]
REQUEST_DECISIONS = ["KB", "DB", "scraper", "PARTIAL", "CLARIFY", "NONE", "USE_DATABASE", "NEED_FETCH", "use_kb",
                     "LLM_UNAVAILABLE", "OTHER", "other"]


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_case(column: str, values: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in values.items()) + " END"


ENTITY_SQL = {
    "organizations": f"""
        SELECT c_custkey AS org_id, c_name AS org_name, c_mktsegment AS industry,
          list_extract({_sql_list(CITIES)}, CAST(c_custkey % 5 + 1 AS INTEGER)) AS org_city,
          list_extract({_sql_list(NATION_STATES)}, c_nationkey + 1) AS org_state,
          CASE WHEN c_custkey % 4 <> 0 THEN 'https://www.shop' || (c_custkey % 100) || '.example.com/about' END AS website,
          CASE WHEN c_custkey % 3 <> 0 THEN 'Info' || c_custkey || '@firm' || (c_custkey % 50) || '.com' END AS email,
          CASE WHEN c_custkey % 4 <> 1 THEN '(' || (c_custkey % 700 + 200) || ') ' || (c_custkey % 799 + 200) || '-'
            || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS phone
        FROM customer""",
    "leads": f"""
        SELECT o_orderkey AS lead_id, o_custkey AS org_id,
          CASE WHEN o_orderkey % 3 = 0 THEN 'opportunity' ELSE 'company' END AS record_kind,
          {_sql_case('o_orderpriority', STATUSES)} AS status, {_sql_case('o_orderstatus', SOURCES)} AS source_code,
          o_orderdate AS created_at,
          CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 30 DAY END AS due_at,
          o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) AS last_seen_at,
          CAST(o_orderkey % 3 + 1 AS INTEGER) AS content_version,
          CASE WHEN o_orderkey % 7 <> 0 THEN org_city END AS city,
          CASE WHEN o_orderkey % 11 <> 0 THEN org_state END AS us_state, org_city, org_state, industry
        FROM orders LEFT JOIN organizations ON o_custkey = organizations.org_id""",
    "lead_titles": """
        SELECT lead_id, p_name || CASE WHEN lead_id % 4 = 0 THEN ' contractor' ELSE '' END AS title, p_type AS category FROM (
          SELECT l_orderkey AS lead_id, l_partkey,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) f
        LEFT JOIN part ON p_partkey = f.l_partkey WHERE rn = 1""",
    "titled_leads": """
        SELECT leads.*, title, category FROM leads LEFT JOIN lead_titles USING (lead_id)""",
    "lead_sources": """
        SELECT lower(l_returnflag) AS source_code, l_orderkey || '-' || l_linenumber AS external_id,
          l_orderkey AS lead_id, l_shipdate AS seen_at FROM lineitem""",
    "deliveries": """
        SELECT l_suppkey AS user_id, l_orderkey AS lead_id, l_linenumber % 3 + 1 AS record_version,
          l_shipdate AS served_at FROM lineitem""",
    "arrivals": """
        SELECT l_orderkey AS identity, l_linenumber AS line,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
            l_shipdate) AS ordinal,
          CASE WHEN l_partkey % 4 = 0 THEN '' WHEN l_partkey % 4 <> 1 THEN 'title ' || (l_partkey % 5) END AS title,
          CASE WHEN l_suppkey % 3 <> 0 THEN 'note ' || (l_suppkey % 4) END AS notes,
          CASE WHEN l_quantity > 10 THEN lower(l_returnflag) END AS category,
          CASE WHEN l_tax > 0.02 THEN l_shipdate END AS due_at, l_returnflag AS source_code,
          l_linestatus AS line_status, l_shipdate AS seen_at FROM lineitem""",
    "jobs": f"""
        SELECT event_id AS job_id, user_id AS created_by, event_type AS script_id,
          list_extract({_sql_list(JOB_STATES)}, CAST(n % 7 + 1 AS INTEGER)) AS status,
          md5(CAST(n % 10 AS VARCHAR)) AS params_hash,
          CASE WHEN event_id % 4 = 0 THEN 'key-' || (event_id // 12) END AS idempotency_key, ts AS created_at,
          CASE WHEN n % 7 <> 0 THEN ts + INTERVAL 5 SECOND END AS started_at,
          CASE WHEN n % 5 <> 0 THEN ts + to_minutes(n % 60) END AS heartbeat_at, n AS found, n // 2 AS inserted,
          n // 4 AS updated, n // 8 AS unchanged, n % 3 AS failed, n % 2 AS skipped, n % 50 + 1 AS target
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events) e""",
    "requests": f"""
        SELECT event_id AS request_id, user_id, event_id // 10 AS session_id,
          list_extract({_sql_list(REQUEST_DECISIONS)}, CAST(n % 12 + 1 AS INTEGER)) AS decision,
          CASE WHEN event_id % 13 = 0 THEN 'llm_unavailable' ELSE 'completed' END AS status,
          CASE WHEN event_id % 3 <> 0 THEN (event_id // 3) * 3 % 1000 END AS job_id, event_type AS source_id,
          n % 30 AS records_returned, CASE WHEN n % 6 <> 0 THEN ts END AS served_at, ts AS created_at, props,
          CASE WHEN n % 17 = 0 THEN TRUE WHEN n % 17 = 1 THEN FALSE END AS cancelled,
          CASE WHEN n % 19 = 0 THEN 'reset_receipt' WHEN n % 19 = 1 THEN 'event' END AS kind
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events) e""",
}
_NEEDS = {"leads": ["organizations"], "titled_leads": ["leads", "lead_titles"]}


def with_entities(names: list[str], sql: str) -> str:
    """Put the named entity views in front of ``sql`` as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{name} AS ({ENTITY_SQL[name]})" for name in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
