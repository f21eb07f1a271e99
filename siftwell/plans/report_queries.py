"""Reports, planning and governance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import decision
from ..functions.text import string_array
from ..operators import govern as G
from ..operators import planning as P
from ..operators import reports as R
from ..operators.ordered import first_rows
from .bindings import Entities
from .registry import plan


@plan("status_counts", uses="leads jobs", sql="""
SELECT 'lead' AS entity, status, count(*) AS n FROM leads GROUP BY 2 UNION ALL SELECT 'job', status, count(*) FROM jobs GROUP BY 2
UNION ALL SELECT 'run source', event_type, count(*) FROM events GROUP BY 2""")
def status_counts(e: Entities) -> DataFrame:
    """Leads and jobs per status, runs per source."""
    parts = [("lead", R.counts_by(e.leads, "status")), ("job", R.counts_by(e.jobs, "status")),
             ("run source", R.counts_by(e.events.withColumnRenamed("event_type", "status"), "status"))]
    tables = [df.select(F.lit(name).alias("entity"), "status", "n") for name, df in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@plan("decision_histogram", uses="requests", sql="""
WITH c AS (SELECT CASE upper(decision) WHEN 'USE_DATABASE' THEN 'DB' WHEN 'NEED_FETCH' THEN 'SCRAPER' WHEN 'USE_KB' THEN 'KB' ELSE upper(decision) END AS decision FROM requests WHERE decision <> ''),
f AS (SELECT unnest(['KB','DB','SCRAPER','PARTIAL','CLARIFY','NONE','DECLINED','FAILED','LLM_UNAVAILABLE']) AS decision)
SELECT coalesce(f.decision, c.decision) AS decision, CAST(count(c.decision) AS BIGINT) AS n FROM f FULL JOIN c USING (decision) GROUP BY 1""")
def decision_histogram(e: Entities) -> DataFrame:
    """Requests per decision, known codes with zeros, older spellings folded."""
    return R.decision_histogram(e.requests)


@plan("decision_derivation", uses="requests", sql="""
SELECT d AS decision, count(*) AS n FROM (SELECT CASE WHEN request_id % 7 = 0 THEN 'PARTIAL' WHEN request_id % 3 = 0 THEN 'DB' WHEN request_id % 4 = 1 AND request_id % 2 = 1 THEN 'KB' WHEN request_id % 5 = 0 THEN 'CLARIFY' ELSE 'NONE' END AS d FROM requests) GROUP BY 1""")
def decision_derivation(e: Entities) -> DataFrame:
    """Decision of a turn from what happened in it."""
    k = F.col("request_id")
    d = decision(F.when(k % 7 == 0, F.lit("PARTIAL")), k % 3 == 0, k % 2 == 0, k % 4 == 1, k % 5 == 0)
    return e.requests.groupBy(d.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@plan("admin_totals", uses="jobs requests", sql="""
SELECT 'leads' AS entity, count(*) AS n FROM orders UNION ALL SELECT 'datasets', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'users', count(*) FROM customer
UNION ALL SELECT 'requests', count(*) FROM requests UNION ALL SELECT 'duplicates prevented', CAST(coalesce(sum(updated + unchanged), 0) AS BIGINT) FROM jobs
UNION ALL SELECT 'unavailable turns', count(*) FROM requests WHERE decision = 'LLM_UNAVAILABLE' OR status = 'llm_unavailable'""")
def admin_totals(e: Entities) -> DataFrame:
    """Entity totals, duplicates prevented and turns without a model."""
    totals = R.entity_totals({"leads": e.orders, "datasets": e.part.select("p_brand").distinct(), "users": e.customer, "requests": e.requests})
    prevented = e.jobs.agg(F.coalesce(F.sum(F.col("updated") + F.col("unchanged")), F.lit(0)).cast("bigint").alias("n"))
    away = e.requests.agg(F.count_if((F.col("decision") == "LLM_UNAVAILABLE") | (F.col("status") == "llm_unavailable")).alias("n"))
    return totals.unionByName(prevented.select(F.lit("duplicates prevented").alias("entity"), "n")).unionByName(
        away.select(F.lit("unavailable turns").alias("entity"), "n"))


@plan("top_sources", sql="""SELECT user_id AS source, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, source LIMIT 10""")
def top_sources(e: Entities) -> DataFrame:
    """Ten sources with most jobs."""
    return R.top_groups(e.events.withColumnRenamed("user_id", "source"), "source", 10)


@plan("dataset_recount", sql="""
SELECT p_brand AS dataset_id, count(DISTINCT l_orderkey) AS records, count(DISTINCT l_orderkey) FILTER (l_linestatus = 'F') AS verified, count(*) - count(DISTINCT l_orderkey) AS duplicates
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def dataset_recount(e: Entities) -> DataFrame:
    """Distinct members per dataset; repeated memberships are combined before the count."""
    rows = e.lineitem.select("l_partkey", "l_orderkey", "l_linestatus").join(
        e.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("dataset_id")), "l_partkey")
    members = rows.groupBy("dataset_id", "l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_linestatus") == "F").alias("v"))
    return members.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("records"), F.count_if("v").alias("verified"),
                                             (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


@plan("kpi_cards", uses="leads", sql="""
SELECT count(*) AS total, count(*) FILTER (status = 'New') AS generated, count(*) FILTER (status = 'Called') AS called, count(*) FILTER (status = 'Emailed') AS emailed,
  count(*) FILTER (status = 'Interested') AS interested, count(*) FILTER (status = 'Pending') AS pending FROM leads""")
def kpi_cards(e: Entities) -> DataFrame:
    """Lead counters of the dashboard."""
    return R.kpi_cards(e.leads)


@plan("conversion_funnel", sql="""
WITH s AS (SELECT unnest([struct_pack(i := 0, stage := 'all', n := count(*)), struct_pack(i := 1, stage := 'viewed', n := count(*) FILTER (event_type <> 'error')), struct_pack(i := 2, stage := 'clicked', n := count(*) FILTER (event_type IN ('click', 'signup', 'purchase'))),
  struct_pack(i := 3, stage := 'signed up', n := count(*) FILTER (event_type IN ('signup', 'purchase'))), struct_pack(i := 4, stage := 'bought', n := count(*) FILTER (event_type = 'purchase')),
  struct_pack(i := 5, stage := 'big', n := count(*) FILTER (event_type = 'purchase' AND value > 10)), struct_pack(i := 6, stage := 'won', n := count(*) FILTER (event_type = 'purchase' AND value > 20))]) AS r, count(*) AS t FROM events)
SELECT CAST(r.i AS INTEGER) AS stage_no, r.stage AS stage, r.n AS n, CAST(floor((r.n * 200 + t) / (2 * t)) AS BIGINT) AS percent_of_total,
  CAST(floor((r.n * 200 + lag(r.n) OVER (ORDER BY r.i)) / (2 * lag(r.n) OVER (ORDER BY r.i))) AS BIGINT) AS percent_of_previous FROM s""")
def conversion_funnel(e: Entities) -> DataFrame:
    """Seven stages with their share of all and of the stage before."""
    t, v = F.col("event_type"), F.col("value")
    return R.funnel(e.events, [("all", F.lit(True)), ("viewed", t != "error"), ("clicked", t.isin("click", "signup", "purchase")), ("signed up", t.isin("signup", "purchase")),
                               ("bought", t == "purchase"), ("big", (t == "purchase") & (v > 10)), ("won", (t == "purchase") & (v > 20))])


@plan("department_rollup", uses="leads", sql="""
SELECT industry AS department, count(*) AS assigned, count(*) FILTER (status = 'Called') AS called, count(*) FILTER (status = 'Emailed') AS emailed,
  count(*) FILTER (status = 'Interested') AS interested, count(*) FILTER (status = 'Pending') AS pending,
  CAST(least(100, floor((count(*) FILTER (status IN ('Called', 'Emailed')) * 200 + count(*)) / (2 * count(*)))) AS BIGINT) AS completion_percent FROM leads GROUP BY 1""")
def department_rollup(e: Entities) -> DataFrame:
    """Work done per department."""
    return R.department_rollup(e.leads.withColumnRenamed("industry", "department"), "department")


@plan("coverage_report", sql="""
SELECT source AS search, CAST(max(n_chars) AS BIGINT) AS advertised, count(*) AS raw_rows, count(DISTINCT CASE WHEN doc_id % 50 <> 0 THEN md5(text) END) AS companies, count(*) FILTER (doc_id % 50 = 0) AS skipped_rows,
  max(doc_id % 7) AS max_page, CAST(floor(count(*) FILTER (doc_id % 3 = 0) * 1000 / count(*)) AS BIGINT) AS fill_phone, CAST(floor(count(*) FILTER (text LIKE '%@%') * 1000 / count(*)) AS BIGINT) AS fill_email,
  count(*) - count(*) FILTER (doc_id % 50 = 0) - count(DISTINCT CASE WHEN doc_id % 50 <> 0 THEN md5(text) END) AS duplicate_rows FROM documents GROUP BY 1""")
def coverage_report(e: Entities) -> DataFrame:
    """Advertised against found, repeats, skipped rows and fill rates per search."""
    k = F.col("doc_id")
    identity = F.when(k % 50 != 0, F.md5("text"))
    return R.coverage(e.documents.withColumnRenamed("source", "search"), "search", identity, F.col("n_chars"), k % 7,
                      {"phone": F.when(k % 3 == 0, F.lit("1")), "email": F.when(F.col("text").contains("@"), F.lit("m"))})


@plan("log_rows", uses="organizations", sql="""
SELECT '{"event":"chat","user":' || org_id || CASE WHEN email IS NOT NULL THEN ',"text":"mail I***' || substr(email, strpos(email, '@')) || '"' ELSE '' END || '}' AS value FROM organizations""")
def log_rows(e: Entities) -> DataFrame:
    """Masked structured log lines."""
    from ..functions.privacy import mask_text

    return R.masked_log_rows(e.organizations, {"event": F.lit("chat"), "user": F.col("org_id"), "text": mask_text(F.concat(F.lit("mail "), "email"))})


# --- governance ------------------------------------------------------------------------------
def _ownership(e: Entities):
    """Datasets are brands owned by a user number, members are the leads of their parts."""
    brand = F.substring_index("p_brand", "#", -1).cast("bigint")
    parts = e.part.select(F.col("p_partkey").alias("l_partkey"), brand.alias("dataset_id"))
    return e.lineitem.select("l_partkey", "l_orderkey", "l_suppkey").join(parts, "l_partkey").select(
        "dataset_id", F.col("l_orderkey").alias("lead_id"))


@plan("visibility_scope", sql="""
SELECT user_id, count(*) AS visible FROM (SELECT l_suppkey AS user_id, l_orderkey AS lead_id FROM lineitem
  UNION SELECT CAST(split_part(p_brand, '#', 2) AS BIGINT), l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def visibility_scope(e: Entities) -> DataFrame:
    """Leads each user may see, through own deliveries or own datasets."""
    delivered = e.lineitem.select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("lead_id"))
    owned = _ownership(e).select(F.col("dataset_id").alias("user_id"), "lead_id")
    return G.visible_ids([delivered, owned]).groupBy("user_id").agg(F.count(F.lit(1)).alias("visible"))


@plan("purge_closure", uses="jobs requests", sql="""
WITH u AS (SELECT DISTINCT user_id, user_id % 3 = 0 AS gone FROM events), rq AS (SELECT r.request_id, r.job_id, gone FROM requests r JOIN u USING (user_id)),
jb AS (SELECT job_id, created_by, CASE WHEN job_id % 2 = 0 THEN job_id % 97 END AS dataset_id FROM jobs),
gj AS (SELECT DISTINCT job_id FROM (SELECT job_id FROM jb WHERE created_by % 3 = 0 UNION SELECT job_id FROM rq WHERE gone AND job_id IS NOT NULL) WHERE job_id NOT IN (SELECT job_id FROM rq WHERE NOT gone AND job_id IS NOT NULL)),
ds AS (SELECT DISTINCT dataset_id, dataset_id % 30 AS created_by FROM jb WHERE dataset_id IS NOT NULL),
gd AS (SELECT DISTINCT dataset_id FROM (SELECT dataset_id FROM ds WHERE created_by IN (SELECT user_id FROM u WHERE gone) UNION SELECT dataset_id FROM jb WHERE job_id IN (SELECT job_id FROM gj) AND dataset_id IS NOT NULL)
  WHERE dataset_id NOT IN (SELECT dataset_id FROM jb WHERE dataset_id IS NOT NULL AND job_id IN (SELECT job_id FROM rq WHERE NOT gone AND job_id IS NOT NULL))),
mem AS (SELECT l_partkey % 97 AS dataset_id, l_orderkey AS lead_id FROM lineitem), del AS (SELECT l_suppkey AS request_id, l_orderkey AS lead_id FROM lineitem WHERE l_linenumber = 1),
gl AS (SELECT DISTINCT lead_id FROM mem WHERE dataset_id IN (SELECT dataset_id FROM gd) EXCEPT SELECT lead_id FROM mem WHERE dataset_id NOT IN (SELECT dataset_id FROM gd)
  EXCEPT SELECT lead_id FROM del WHERE request_id NOT IN (SELECT request_id FROM rq WHERE gone))
SELECT 'users' AS entity, count(*) AS n FROM u WHERE gone UNION ALL SELECT 'requests', count(*) FROM rq WHERE gone UNION ALL SELECT 'jobs', count(*) FROM gj
UNION ALL SELECT 'datasets', count(*) FROM gd UNION ALL SELECT 'leads', count(*) FROM gl""")
def purge_closure(e: Entities) -> DataFrame:
    """Dry-run report of an account purge that protects shared rows."""
    users = e.events.select("user_id").distinct()
    jobs = e.jobs.select("job_id", "created_by", F.when(F.col("job_id") % 2 == 0, F.col("job_id") % 97).alias("dataset_id"))
    datasets = jobs.select("dataset_id").filter(F.col("dataset_id").isNotNull()).distinct().withColumn("created_by", F.col("dataset_id") % 30)
    members = e.lineitem.select((F.col("l_partkey") % 97).alias("dataset_id"), F.col("l_orderkey").alias("lead_id"))
    deliveries = e.lineitem.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("request_id"), F.col("l_orderkey").alias("lead_id"))
    closure = G.purge_closure(users, e.requests, jobs, datasets, members, deliveries, users.filter("user_id % 3 = 0"))
    return G.purge_report(closure)


@plan("retention", sql="""
SELECT user_id, count(*) AS writes FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-25') GROUP BY 1""")
def retention(e: Entities) -> DataFrame:
    """Dependent rows of checkpoints young enough to keep."""
    cutoff = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    _, dependents = G.retain_since(e.events.filter("event_type = 'signup'"), "ts", cutoff, e.events.filter("event_type = 'click'"), "user_id")
    return dependents.groupBy("user_id").agg(F.count(F.lit(1)).alias("writes"))


@plan("ancestor_walk", sql="""
WITH RECURSIVE n AS (SELECT event_id AS id, CASE WHEN event_id % 1000 = 7 THEN event_id ELSE event_id // 2 END AS parent, event_type = 'signup' AS root FROM events),
w AS (SELECT id, id AS cur, 0 AS d FROM n UNION ALL SELECT w.id, n.parent, d + 1 FROM w JOIN n ON n.id = w.cur WHERE NOT n.root AND d < 60)
SELECT n.id, (SELECT min(cur) FROM w JOIN n m ON m.id = w.cur WHERE w.id = n.id AND m.root) AS root_id FROM n""")
def ancestor_walk(e: Entities) -> DataFrame:
    """Nearest root request above every request, circles guarded."""
    k = F.col("event_id")
    nodes = e.events.select(k.alias("id"), F.when(k % 1000 == 7, k).otherwise(F.floor(k / 2)).alias("parent_id"), (F.col("event_type") == "signup").alias("is_root"))
    return G.root_ancestors(nodes)


# --- planning --------------------------------------------------------------------------------
@plan("zip_range_join", uses="organizations", sql="""
WITH z AS (SELECT org_id, CAST(substr(lpad(CAST(org_id * 37 % 99999 AS VARCHAR), 5, '0'), 1, 3) AS INTEGER) AS p FROM organizations)
SELECT org_id, CASE WHEN p BETWEEN 100 AND 149 OR p = 5 THEN 'NY' WHEN p BETWEEN 10 AND 27 THEN 'MA' WHEN p BETWEEN 750 AND 799 THEN 'TX' WHEN p BETWEEN 900 AND 961 THEN 'CA' ELSE 'other' END AS zip_state,
  CASE WHEN p BETWEEN 100 AND 149 OR p = 5 THEN '1,40' WHEN p BETWEEN 10 AND 27 THEN '6,17' WHEN p BETWEEN 750 AND 799 THEN '12,13,18,48,49,50' WHEN p BETWEEN 900 AND 961 THEN '3,7,9,33,36' END AS regions FROM z""")
def zip_range_join(e: Entities) -> DataFrame:
    """State and sales regions of a ZIP code."""
    rows = e.organizations.select("org_id", F.lpad((F.col("org_id") * 37 % 99999).cast("string"), 5, "0").alias("zip"))
    found = P.state_of_zip(rows, "zip")
    known = F.col("zip_state").isin("NY", "MA", "TX", "CA")
    return found.select("org_id", F.when(known, F.col("zip_state")).otherwise(F.lit("other")).alias("zip_state"),
                        F.when(known, F.array_join(P.regions_of_state(F.col("zip_state")).cast("array<string>"), ",")).alias("regions"))


def trade_catalog(e: Entities) -> DataFrame:
    """Distinct part names as trades, in order of their first part; other trades of the same noun are related."""
    names = e.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("position"))
    noun, adjective = F.substring_index("name", " ", -1), F.substring_index("name", " ", 1)
    same = names.groupBy(noun.alias("noun")).agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("all"))  # as many as there are adjectives
    rows = names.withColumn("noun", noun).join(same, "noun")
    related = F.transform(F.filter("all", lambda s: s["name"] != F.col("name")), lambda s: s["name"])
    return rows.select("position", F.initcap("name").alias("name"), F.col("position").cast("string").alias("code"),
                       F.array(F.concat_ws(" ", "noun", adjective)).alias("aliases"), related.alias("related"))


def trade_keywords(e: Entities) -> DataFrame:
    """Requested keywords per part: plural names, aliases, partial names, misspellings and unknown words."""
    k, noun, adjective = F.col("p_partkey"), F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1)
    m = k % 5
    word = (F.when(m == 0, F.concat(F.upper("p_name"), F.lit("s"))).when(m == 1, F.concat(noun, F.lit("-"), adjective))
            .when(m == 2, F.concat(F.lit("Commercial "), noun, F.lit(" services"))).when(m == 3, F.concat(F.lit("fasteners & fittings")))
            .otherwise(F.lit("Q")))
    return e.part.select(k.alias("part_id"), word.alias("keyword"))


@plan("trade_resolution", sql="""
WITH c AS (SELECT p_name, min(p_partkey) AS pos, split_part(p_name, ' ', 2) AS noun FROM part GROUP BY p_name), first AS (SELECT noun, min(pos) AS pos FROM c GROUP BY noun),
k AS (SELECT p_partkey % 5 AS m, p_name, split_part(p_name, ' ', 2) AS noun, split_part(p_name, ' ', 1) AS adj FROM part)
SELECT DISTINCT CASE m WHEN 0 THEN CASE WHEN k.noun = 'rod' THEN k.p_name || 's' ELSE k.p_name END WHEN 1 THEN k.noun || ' ' || adj WHEN 2 THEN 'commercial ' || k.noun || ' service' WHEN 3 THEN 'fastener and fitting' ELSE 'q' END AS key,
  CASE WHEN m IN (0, 1) AND NOT (m = 0 AND k.noun = 'rod' AND length(k.p_name) < 9) THEN CAST(c.pos AS VARCHAR) WHEN m = 2 AND k.noun <> 'rod' THEN CAST(first.pos AS VARCHAR) WHEN m = 3 THEN CAST(g.pos AS VARCHAR) END AS code,
  CASE WHEN m = 0 AND k.noun = 'rod' THEN CASE WHEN length(k.p_name) >= 9 THEN 'fuzzy_match' END WHEN m IN (0, 1) THEN 'primary' WHEN m = 2 AND k.noun <> 'rod' THEN 'token_match' WHEN m = 3 THEN 'group_primary' END AS relation
FROM k LEFT JOIN c ON c.p_name = k.p_name LEFT JOIN first ON first.noun = k.noun LEFT JOIN c g ON k.m = 3 AND g.p_name IN ('red bolt', 'blue ring')""")
def trade_resolution(e: Entities) -> DataFrame:
    """Requested keywords to trades by group, name, alias, token overlap and similar spelling."""
    groups = e.part.filter(F.col("p_name").isin("red bolt", "blue ring")).groupBy(F.lit("Fasteners and fittings").alias("keyword")).agg(
        F.array_sort(F.collect_set("p_name")).alias("names"))
    return P.resolve_keywords(trade_keywords(e), trade_catalog(e), groups).select("key", "code", "relation")


@plan("trade_similarity", sql="""
WITH n AS (SELECT DISTINCT p_name, p_name || 'q' AS key FROM part)
SELECT a.key, b.p_name AS candidate, CAST(round((1 - levenshtein(a.key, b.p_name) / greatest(length(a.key), length(b.p_name))) * 1000) AS BIGINT) AS similarity
FROM n a JOIN n b ON 1 - levenshtein(a.key, b.p_name) / greatest(length(a.key), length(b.p_name)) >= 0.78""")
def trade_similarity(e: Entities) -> DataFrame:
    """Catalogue names spelled similarly to misspelled ones."""
    names = e.part.select("p_name").distinct()
    asked = names.select(F.concat("p_name", F.lit("q")).alias("key"))
    keys = names.select(F.col("p_name").alias("key"), F.lit("").alias("code"), F.lit(0).alias("position"))
    return P.similar_keys(asked, keys).select("key", "candidate", F.round(F.col("similarity") * 1000).cast("bigint").alias("similarity"))


@plan("related_trades", sql="""
WITH c AS (SELECT p_name, min(p_partkey) AS pos, split_part(p_name, ' ', 2) AS noun FROM part GROUP BY p_name),
r AS (SELECT a.p_name AS key, CAST(b.pos AS VARCHAR) AS code, row_number() OVER (PARTITION BY a.p_name ORDER BY b.pos) AS pos FROM c a JOIN c b ON a.noun = b.noun AND a.p_name <> b.p_name)
SELECT key, code, 1 AS depth FROM r WHERE pos <= 4 UNION ALL SELECT p_name, CAST(pos AS VARCHAR), 0 FROM c""")
def related_trades(e: Entities) -> DataFrame:
    """Every trade with its first four related trades."""
    catalog = trade_catalog(e)
    resolved = catalog.select(F.lower("name").alias("key"), "code", F.lit(0).alias("pos"))
    return P.related_trades(resolved, catalog).select("key", "code", "depth")


@plan("crawl_plan", sql="""
WITH c AS (SELECT p_name, min(p_partkey) AS code FROM part GROUP BY p_name), s AS (SELECT n_nationkey, list_extract(['AL','AK','AZ','AR','CA','CO','CT','DE','FL','GA','HI','ID','IL','IN','IA','KS','KY','LA','ME','MD','MA','MI','MN','MS','NY'], n_nationkey + 1) AS st FROM nation),
g(st, region) AS (SELECT * FROM (VALUES ('AL',43),('AZ',21),('AR',45),('CA',3),('CA',7),('CA',9),('CA',33),('CA',36),('CO',27),('CT',17),('DE',5),('FL',16),('FL',4),('GA',11),('GA',37),('ID',53),('IL',8),('IN',31),('IN',8),('IA',51),('KS',28),('KY',31),('KY',15),('KY',42),('LA',32),('ME',41),('MD',2),('MA',6),('MA',17),('MI',19),('MN',24),('MS',44),('NY',1),('NY',40)))
SELECT 'https://plan.example.com/search.html?class=' || nullif(ltrim(CAST(code AS VARCHAR), '0'), '') || '&region=' || region AS url, CAST(10 AS INTEGER) AS priority, count(DISTINCT p.p_name) AS keywords, p.p_name AS trade
FROM part p JOIN c USING (p_name) JOIN s ON s.n_nationkey = p.p_partkey % 25 JOIN g USING (st) WHERE code > 0 GROUP BY ALL""")
def crawl_plan(e: Entities) -> DataFrame:
    """Planned searches: requested trades in the regions of the request's state, one per URL."""
    catalog = e.part.groupBy("p_name").agg(F.min("p_partkey").alias("code")).filter("code > 0")
    trades = catalog.select(F.col("p_name").alias("key"), "code", F.col("p_name").alias("trade"), F.lit("primary").alias("relation"), F.lit(0).alias("depth"))
    asked = e.part.select(F.col("p_partkey").alias("request_id"), F.col("p_name").alias("keyword"), F.col("p_name").alias("key"))
    from .bindings import NATION_STATES

    state = F.element_at(string_array(NATION_STATES), (F.col("p_partkey") % 25 + 1).cast("int"))
    places = e.part.select(F.col("p_partkey").alias("request_id"), state.alias("state"), F.explode(P.regions_of_state(state)).alias("region"),
                           F.lit(10).alias("place_priority"), state.alias("label"))
    planned = P.build_plan(asked, trades, places, "https://plan.example.com/search.html")
    return planned.select("url", "priority", F.size("keywords").cast("bigint").alias("keywords"), "trade")


def source_table(e: Entities) -> DataFrame:
    n = F.col("n_nationkey")
    from .bindings import NATION_STATES

    return e.nation.select(
        F.concat(F.lit("src"), F.lpad(n.cast("string"), 2, "0")).alias("source_id"), F.when(n % 2 == 0, F.lit("company")).otherwise(F.lit("opportunity")).alias("record_kind"),
        F.when(n % 3 == 0, F.element_at(string_array(NATION_STATES), n + 1)).alias("coverage_state"), F.lit(None).cast("string").alias("coverage_city"),
        (n % 4 != 0).alias("supports_keyword"), (n % 3 != 0).alias("supports_location"), (n % 5 == 0).alias("requires_location"), (n % 11 == 10).alias("requires_city"),
        F.when(n % 6 == 2, F.array(F.lit("New York City"), F.lit("Buffalo"))).otherwise(F.array().cast("array<string>")).alias("supported_cities"), (n % 7 != 0).alias("ready"))


@plan("source_eligibility", uses="organizations", sql="""
WITH s AS (SELECT 'src' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS source_id, n_nationkey AS n, CASE WHEN n_nationkey % 3 = 0 THEN list_extract(['AL','AK','AZ','AR','CA','CO','CT','DE','FL','GA','HI','ID','IL','IN','IA','KS','KY','LA','ME','MD','MA','MI','MN','MS','NY'], n_nationkey + 1) END AS cov FROM nation WHERE n_nationkey % 7 <> 0),
r AS (SELECT org_id AS request_id, CASE WHEN org_id % 3 <> 0 THEN org_state END AS st, CASE WHEN org_id % 4 = 1 THEN org_city END AS city, CASE WHEN org_id % 2 = 0 THEN 'roofing' END AS kw, org_id % 3 AS k FROM organizations),
m AS (SELECT request_id, source_id, cov FROM r JOIN s ON (CASE WHEN k = 2 THEN 1 ELSE 0 END) = n % 2
  WHERE NOT (kw IS NOT NULL AND n % 4 = 0) AND NOT (n % 5 = 0 AND st IS NULL AND city IS NULL) AND NOT (n % 11 = 10 AND city IS NULL)
    AND NOT (city IS NOT NULL AND n % 6 = 2 AND city NOT IN ('New York', 'Buffalo')) AND NOT coalesce(st <> cov, FALSE)
    AND NOT ((st IS NOT NULL OR city IS NOT NULL) AND NOT (cov IS NOT NULL AND city IS NULL AND (st IS NULL OR st = cov)) AND n % 3 = 0)
    AND (cov IS NULL OR st IS NOT NULL) AND source_id <> 'src01')
SELECT request_id, count(*) AS eligible, first(source_id ORDER BY CASE WHEN cov IS NOT NULL THEN 0 ELSE 1 END, source_id) AS recommended FROM m GROUP BY 1""")
def source_eligibility(e: Entities) -> DataFrame:
    """Sources that can serve each request and the recommended one."""
    k = F.col("org_id")
    requests = e.organizations.select(
        k.alias("request_id"), F.when(k % 3 != 0, F.col("org_state")).alias("us_state"), F.when(k % 4 == 1, F.col("org_city")).alias("city"),
        F.when(k % 2 == 0, F.lit("roofing")).alias("keyword"), F.when(k % 3 == 2, F.lit("opportunity")).otherwise(F.lit("company")).alias("record_kind"),
        F.array(F.lit("src01")).alias("attempted"))
    fits = P.candidate_sources(requests, source_table(e))
    counts = fits.groupBy("request_id").agg(F.count(F.lit(1)).alias("eligible"))
    return P.recommend_sources(fits).select("request_id", F.col("source_id").alias("recommended")).join(counts, "request_id")


@plan("enrichment_fill", sql="""
WITH p AS (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1)
SELECT s_suppkey AS company_id, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'list' || s_suppkey END, CASE WHEN s_suppkey % 2 = 0 THEN 'contact' || s_suppkey END, 'profile' || k) AS phone,
  CASE WHEN s_suppkey % 2 = 0 THEN 'a,b,c' ELSE 'a,c' END AS socials FROM supplier LEFT JOIN p ON s_nationkey = c_nationkey""")
def enrichment_fill(e: Entities) -> DataFrame:
    """Listing rows completed from contacts pages, then from profile pages."""
    k = F.col("s_suppkey")
    listing = e.supplier.select(k.alias("company_id"), "s_nationkey", F.when(k % 3 == 0, F.concat(F.lit("list"), k)).alias("phone"), F.array(F.lit("a")).alias("socials"))
    contacts = e.supplier.filter("s_suppkey % 2 = 0").select(k.alias("company_id"), F.concat(F.lit("contact"), k).alias("phone"), F.array(F.lit("a"), F.lit("b")).alias("socials"))
    profile = first_rows(e.customer.select(F.col("c_nationkey").alias("s_nationkey"), "c_custkey"), ["s_nationkey"], [F.col("c_custkey")]).select(
        "s_nationkey", F.concat(F.lit("profile"), "c_custkey").alias("phone"), F.array(F.lit("c")).alias("socials"))
    filled = P.fill_missing(P.fill_missing(listing, contacts, ["company_id"], ["phone"], ["socials"]), profile, ["s_nationkey"], ["phone"], ["socials"])
    return filled.select("company_id", "phone", F.array_join("socials", ",").alias("socials"))


@plan("source_sync", sql="""
SELECT 'type ' || p_type AS code, CASE WHEN bool_or(p_partkey % 2 = 0) AND p_type <> 'PROMO' THEN 'new ' || p_type ELSE 'old ' || p_type END AS name, CASE WHEN p_type <> 'PROMO' THEN 'Active' ELSE 'Paused' END AS status
FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_type UNION ALL SELECT 'type ECONOMY', 'new ECONOMY', 'Active'""")
def source_sync(e: Entities) -> DataFrame:
    """Source registry written over the stored sources."""
    types = e.part.select("p_type").distinct()
    code = F.concat(F.lit("type "), "p_type").alias("code")
    stored = types.filter("p_type <> 'ECONOMY'").select(code, F.concat(F.lit("old "), "p_type").alias("name"), F.lit("x").alias("description"), F.lit("Paused").alias("status"))
    registry = types.filter("p_type <> 'PROMO'").select(code, F.concat(F.lit("new "), "p_type").alias("name"), F.lit("y").alias("description"))
    return P.synchronize_sources(stored, registry).select("code", "name", "status")
