"""Criteria search, filters and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.place import location_matches
from ..functions.text import all_words_match, present, string_array
from ..operators import search as S
from .bindings import AS_OF, CITIES, NATION_STATES, Entities, as_of, days
from .registry import plan

CATEGORIES = ["ring contractors", "bolt/gear", "plate, rod", "gizmo company", "Furniture", "promo & economy"]
# The terms behind those categories, written out by hand for the SQL side.
TERMS_SQL = """terms(n, plain, contractor) AS (VALUES
  (0, ['ring'], ['ring contractor']), (1, ['bolt/gear', 'bolt gear', 'bolt', 'gear'],
   ['bolt/gear contractor', 'bolt gear contractor', 'bolt contractor', 'gear contractor']),
  (2, ['plate', 'rod'], ['plate contractor', 'rod contractor']),
  (3, ['gizmo'], ['gizmo company contractor', 'gizmo contractor']), (4, ['furniture'], ['furniture contractor']),
  (5, ['promo & economy', 'promo and economy', 'promo economy', 'promo', 'economy'],
   ['promo & economy contractor', 'promo economy contractor', 'promo contractor', 'economy contractor']))"""
STATES_SQL = "[" + ", ".join(f"'{s}'" for s in NATION_STATES) + "]"
CITIES_SQL = "[" + ", ".join(f"'{c}'" for c in CITIES) + "]"


def state_requests(e: Entities) -> DataFrame:
    """One request per nation: its state, a category, sometimes a city and a record kind."""
    n = F.col("n_nationkey")
    return e.nation.select(
        n.cast("bigint").alias("request_id"), (n * 3).cast("bigint").alias("user_id"),
        F.element_at(string_array(CATEGORIES), n % 6 + 1).alias("category"),
        F.element_at(string_array(NATION_STATES), n + 1).alias("us_state"),
        F.when(n % 2 == 0, F.element_at(string_array(CITIES), n % 5 + 1)).alias("city"),
        F.when(n % 3 == 0, F.lit("company")).when(n % 3 == 1, F.lit("opportunity")).alias("record_kind"),
        (n + 5).alias("quantity"), (n % 5 == 0).alias("has_email"))


REQUESTS_SQL = f"""asked AS (SELECT CAST(n_nationkey AS BIGINT) AS request_id, CAST(n_nationkey * 3 AS BIGINT) AS user_id,
    n_nationkey % 6 AS n, list_extract({STATES_SQL}, n_nationkey + 1) AS want_state,
    CASE WHEN n_nationkey % 2 = 0 THEN list_extract({CITIES_SQL}, n_nationkey % 5 + 1) END AS raw_city,
    CASE n_nationkey % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'opportunity' END AS want_kind,
    n_nationkey + 5 AS quantity FROM nation),
  wanted AS (SELECT asked.* EXCLUDE raw_city, CASE WHEN raw_city <> 'New York' THEN raw_city END AS want_city, plain, contractor
    FROM asked JOIN terms USING (n))"""
MATCH_SQL = f"""matched AS (SELECT w.request_id, w.user_id, w.quantity, l.*,
    len(list_filter(contractor, lambda t: contains(txt, t))) > 0 AS contractor_first
  FROM wanted w JOIN (SELECT *, lower(concat_ws(' ', category, title, CASE WHEN record_kind = 'company' THEN industry END)) AS txt
    FROM titled_leads) l
  ON (want_kind IS NULL OR record_kind = want_kind)
    AND (((want_city IS NULL OR lower(city) = lower(want_city)) AND us_state = want_state)
      OR (record_kind = 'company' AND ((want_city IS NOT NULL AND city IS NULL) OR us_state IS NULL)
        AND (want_city IS NULL OR lower(org_city) = lower(want_city)) AND org_state = want_state))
    AND (record_kind <> 'opportunity' OR due_at IS NULL OR due_at >= TIMESTAMP '{AS_OF}')
    AND len(list_filter(list_concat(plain, contractor), lambda t: contains(txt, t))) > 0)"""


def _searchable(e: Entities) -> DataFrame:
    text = S.search_text(F.col("record_kind"), F.col("industry"), F.col("category"), F.col("title"))
    return e.titled_leads.withColumn("text", text)


def _matches(e: Entities) -> DataFrame:
    requests = S.canonical_criteria(state_requests(e).drop("has_email"))
    return S.match_requests(_searchable(e), requests, as_of())


@plan("search_category_state", uses="organizations titled_leads", sql=f"""
WITH {TERMS_SQL}, {REQUESTS_SQL}, {MATCH_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id
  ORDER BY CASE WHEN contractor_first THEN 1 ELSE 2 END, created_at DESC, lead_id) AS rnk FROM matched)
SELECT request_id, CAST(rnk AS BIGINT) AS rank, lead_id, record_kind, title, category, contractor_first, created_at,
  CASE WHEN record_kind = 'company' THEN coalesce(city, r.org_city) ELSE city END AS city,
  CASE WHEN record_kind = 'company' THEN coalesce(us_state, r.org_state) ELSE us_state END AS state,
  o.org_name AS company, CASE WHEN record_kind = 'company' THEN o.email END AS email,
  CASE WHEN record_kind = 'company' THEN o.phone END AS phone
FROM ranked r LEFT JOIN organizations o USING (org_id) WHERE rnk <= quantity""")
def search_category_state(e: Entities) -> DataFrame:
    """Category, place and kind criteria for many requests, contractor wording first."""
    ranked = S.rank_matches(_matches(e))
    orgs = e.organizations.select("org_id", "org_name", F.col("email").alias("org_email"), F.col("phone").alias("org_phone"))
    view = S.lead_view(ranked.join(orgs, "org_id", "left"))
    return view.select(
        "request_id", F.col("rank").cast("bigint").alias("rank"), "lead_id", "record_kind", "title", "category",
        "contractor_first", "created_at", F.col("view_city").alias("city"), F.col("view_state").alias("state"),
        F.col("org_name").alias("company"), F.col("view_email").alias("email"), F.col("view_phone").alias("phone"))


@plan("search_multi_request_cap", uses="titled_leads", sql=f"""
WITH {TERMS_SQL}, {REQUESTS_SQL}, {MATCH_SQL}
SELECT request_id, count(DISTINCT lead_id) AS total, least(count(DISTINCT lead_id), any_value(quantity)) AS returned,
  count(DISTINCT lead_id) >= any_value(quantity) AS sufficient
FROM matched GROUP BY request_id""")
def search_multi_request_cap(e: Entities) -> DataFrame:
    """Distinct total before paging, and what the per-request cap lets through."""
    totals = _matches(e).groupBy("request_id", "quantity").agg(F.count_distinct("lead_id").alias("total"))
    return totals.select("request_id", "total", F.least("total", F.col("quantity").cast("bigint")).alias("returned"),
                         (F.col("total") >= F.col("quantity")).alias("sufficient"))


@plan("search_new_only", uses="titled_leads deliveries", sql=f"""
WITH {TERMS_SQL}, {REQUESTS_SQL}, {MATCH_SQL}
SELECT request_id, lead_id, content_version FROM matched m
WHERE request_id % 2 = 0 OR user_id = 3 OR NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.user_id = m.user_id AND d.lead_id = m.lead_id
  AND d.record_version = m.content_version AND d.served_at IS NOT NULL)""")
def search_new_only(e: Entities) -> DataFrame:
    """New leads only for the requests that ask for it and name a user; the others keep what was delivered."""
    asked = state_requests(e).drop("has_email").withColumn("new_only", F.col("request_id") % 2 == 1).withColumn(
        "user_id", F.nullif("user_id", F.lit(3).cast("bigint")))
    matches = S.match_requests(_searchable(e), S.canonical_criteria(asked), as_of())
    return S.exclude_delivered(matches, e.deliveries, asked).select("request_id", "lead_id", "content_version")


@plan("search_all_criteria", uses="titled_leads lead_sources organizations", sql=f"""
WITH asked AS (SELECT CAST(n_nationkey AS BIGINT) AS request_id, n_nationkey AS n, list_extract({STATES_SQL}, n_nationkey + 1) AS state FROM nation),
own_email AS (SELECT DISTINCT l_orderkey AS lead_id FROM lineitem WHERE l_suppkey % 4 = 0),
own_phone AS (SELECT DISTINCT l_orderkey AS lead_id FROM lineitem WHERE l_suppkey % 6 = 0),
sites AS (SELECT org_id, lower(org_city) AS city, org_state AS state FROM organizations
  UNION SELECT org_id, 'utica', list_extract({STATES_SQL}, CAST(org_id % 25 + 1 AS INTEGER)) FROM organizations WHERE org_id % 2 = 0),
hits AS (SELECT a.request_id, a.n, l.*, lower(concat_ws(' ', l.category, l.title, CASE WHEN l.record_kind = 'company' THEN l.industry END)) AS txt FROM asked a JOIN titled_leads l
  ON (n % 5 = 4 OR l.us_state = a.state OR (l.record_kind = 'company' AND l.us_state IS NULL AND EXISTS (SELECT 1 FROM sites s WHERE s.org_id = l.org_id AND s.state = a.state)))
  AND (n % 7 <> 6 OR l.record_kind = 'company')
  AND (n % 4 <> 0 OR l.source_code = 'municipal' OR EXISTS (SELECT 1 FROM lead_sources s WHERE s.lead_id = l.lead_id AND s.source_code = 'municipal'))
  AND (n % 4 <> 2 OR EXISTS (SELECT 1 FROM lead_sources s WHERE s.lead_id = l.lead_id AND s.source_code = 'r'))
  AND (n % 3 <> 0 OR l.status = 'New') AND (n % 3 <> 1 OR l.org_id % 4 = n % 4) AND (n % 6 <> 2 OR l.lead_id % 5 = n % 5)
  AND (n % 4 <> 3 OR EXISTS (SELECT 1 FROM own_email c WHERE c.lead_id = l.lead_id) OR (l.record_kind = 'company' AND EXISTS (SELECT 1 FROM organizations o WHERE o.org_id = l.org_id AND o.email IS NOT NULL)))
  AND (n % 4 <> 1 OR EXISTS (SELECT 1 FROM own_phone c WHERE c.lead_id = l.lead_id) OR (l.record_kind = 'company' AND EXISTS (SELECT 1 FROM organizations o WHERE o.org_id = l.org_id AND o.phone IS NOT NULL)))
  AND (n % 8 = 5 OR l.record_kind <> 'opportunity' OR l.due_at IS NULL OR l.due_at >= TIMESTAMP '{AS_OF}')
  AND (n % 9 <> 4 OR l.last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY)
  AND l.lead_id NOT IN (n, n + 32, n + 64) AND (n % 10 <> 8 OR contains(lower(concat_ws(' ', l.category, l.title, CASE WHEN l.record_kind = 'company' THEN l.industry END)), 'ring'))),
ranked AS (SELECT request_id, lead_id, row_number() OVER (PARTITION BY request_id
  ORDER BY CASE WHEN n % 10 = 8 AND contains(txt, 'ring contractor') THEN 1 ELSE 2 END, created_at DESC, lead_id) AS rank FROM hits)
SELECT request_id, CAST(rank AS BIGINT) AS rank, lead_id FROM ranked WHERE rank <= 1500""")
def search_all_criteria(e: Entities) -> DataFrame:
    """Requests that use every criterion: place over all locations, source, state of work, people, contact, time, exclusions."""
    n = F.col("n_nationkey")
    asked = e.nation.select(
        n.cast("bigint").alias("request_id"), F.when(n % 5 != 4, F.element_at(string_array(NATION_STATES), n + 1)).alias("us_state"),
        F.when(n % 7 == 6, F.lit("company")).alias("record_kind"), F.when(n % 4 == 0, F.lit(" Municipal ")).when(n % 4 == 2, F.lit("R")).alias("source"),
        F.when(n % 3 == 0, F.lit("New")).alias("status"), F.when(n % 3 == 1, n % 4).alias("assigned_to"), F.when(n % 6 == 2, n % 5).alias("department_id"),
        (n % 4 == 3).alias("has_email"), (n % 4 == 1).alias("has_phone"), (n % 8 == 5).alias("include_expired"), F.when(n % 9 == 4, F.lit(400)).alias("fresh_within_days"),
        F.array(n, n + 32, n + 64).alias("exclude_lead_ids"), F.when(n % 10 == 8, F.lit("ring")).alias("category"), F.lit(1500).alias("quantity"))
    contacts = e.lineitem.select(F.col("l_orderkey").alias("lead_id"), F.when(F.col("l_suppkey") % 4 == 0, F.lit("a@b")).alias("email"),
                                 F.when(F.col("l_suppkey") % 6 == 0, F.lit("1")).alias("phone"))
    places = e.organizations.select("org_id", F.col("org_city").alias("city"), F.col("org_state").alias("state"))
    branches = e.organizations.filter("org_id % 2 = 0").select("org_id", F.lit("Utica").alias("city"), F.element_at(
        string_array(NATION_STATES), (F.col("org_id") % 25 + 1).cast("int")).alias("state"))
    leads = S.with_sources(_searchable(e), e.lead_sources)
    leads = S.with_places(S.with_contact_flags(leads, contacts, e.organizations), places.unionByName(branches))
    leads = leads.withColumns({"assigned_to": F.col("org_id") % 4, "department_id": F.col("lead_id") % 5})
    return S.rank_matches(S.match_requests(leads, S.canonical_criteria(asked), as_of())).select("request_id", F.col("rank").cast("bigint").alias("rank"), "lead_id")


@plan("search_source_exists", uses="leads lead_sources", sql="""
SELECT code, count(*) AS leads, sum(CAST(own AS BIGINT))::BIGINT AS own_code FROM (
  SELECT v.code, l.source_code = v.code AS own FROM leads l JOIN (VALUES ('municipal'), ('a'), ('n'), ('r')) v(code)
  ON l.source_code = v.code OR EXISTS (SELECT 1 FROM lead_sources s WHERE s.lead_id = l.lead_id AND s.source_code = v.code))
GROUP BY code""")
def search_source_exists(e: Entities) -> DataFrame:
    """Own source code, or any sighting from that source."""
    found = S.with_sources(e.leads, e.lead_sources).select("source_code", F.explode("sources").alias("code"))
    return found.filter(F.col("code").isin("municipal", "a", "n", "r")).groupBy("code").agg(
        F.count(F.lit(1)).alias("leads"), F.count_if(F.col("source_code") == F.col("code")).alias("own_code"))


@plan("search_has_contact", uses="leads organizations", sql="""
WITH contacts AS (SELECT l_orderkey AS lead_id, bool_or(l_suppkey % 4 = 0) AS c_email, bool_or(l_suppkey % 6 = 0) AS c_phone
  FROM lineitem GROUP BY 1)
SELECT lead_id, coalesce(c_email, FALSE) OR (record_kind = 'company' AND o.email IS NOT NULL) AS has_email,
  coalesce(c_phone, FALSE) OR (record_kind = 'company' AND o.phone IS NOT NULL) AS has_phone
FROM leads LEFT JOIN contacts USING (lead_id) LEFT JOIN organizations o USING (org_id)
WHERE coalesce(c_email, FALSE) OR coalesce(c_phone, FALSE) OR (record_kind = 'company' AND (o.email IS NOT NULL OR o.phone IS NOT NULL))""")
def search_has_contact(e: Entities) -> DataFrame:
    """Email and phone flags from linked contacts or, for companies, from the organisation."""
    contacts = e.lineitem.select(F.col("l_orderkey").alias("lead_id"), F.when(F.col("l_suppkey") % 4 == 0, F.lit("a@b")).alias("email"),
                                 F.when(F.col("l_suppkey") % 6 == 0, F.lit("1")).alias("phone"))
    return S.with_contact_flags(e.leads, contacts, e.organizations).filter("has_email OR has_phone").select("lead_id", "has_email", "has_phone")


@plan("search_unexpired_fresh", uses="leads", sql=f"""
SELECT lead_id, record_kind, due_at, last_seen_at FROM leads
WHERE (record_kind <> 'opportunity' OR due_at IS NULL OR due_at >= TIMESTAMP '{AS_OF}')
  AND last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 45 DAY""")
def search_unexpired_fresh(e: Entities) -> DataFrame:
    """Open opportunities and companies seen in the last 45 days."""
    open_ = (F.col("record_kind") != "opportunity") | F.col("due_at").isNull() | (F.col("due_at") >= as_of())
    return e.leads.filter(open_ & (F.col("last_seen_at") >= as_of() - days(45))).select(
        "lead_id", "record_kind", "due_at", "last_seen_at")


@plan("search_keyword_ilike", uses="titled_leads organizations", sql="""
SELECT lead_id, org_name, title, status FROM titled_leads t LEFT JOIN organizations o USING (org_id)
WHERE (org_name ILIKE '%00012%' OR title ILIKE '%RING%' OR t.category ILIKE '%ring%') AND status = 'New' AND us_state IS NOT NULL""")
def search_keyword_ilike(e: Entities) -> DataFrame:
    """Facet filter plus a case-insensitive keyword over several columns."""
    orgs = e.organizations.select("org_id", "org_name")
    joined = e.titled_leads.filter((F.col("status") == "New") & F.col("us_state").isNotNull()).join(orgs, "org_id", "left")
    hit = S.keyword_filter([F.col("title"), F.col("category")], "ring") | S.keyword_filter([F.col("org_name")], "00012")
    return joined.filter(hit).select("lead_id", "org_name", "title", "status")


@plan("search_exclusions", uses="leads deliveries", sql="""
SELECT lead_id, status, us_state FROM leads
WHERE status = 'Called' AND city IS NULL AND lead_id NOT IN (SELECT lead_id FROM deliveries WHERE record_version = 3)""")
def search_exclusions(e: Entities) -> DataFrame:
    """Equality and IS NULL filters with an explicit exclusion list."""
    excluded = e.deliveries.filter(F.col("record_version") == 3).select("lead_id").distinct()
    chosen = S.equality_filter(e.leads, {"status": "Called", "city": None})
    return chosen.join(excluded, "lead_id", "left_anti").select("lead_id", "status", "us_state")


@plan("location_match", uses="leads organizations", sql=f"""
SELECT org_state, count(*) AS leads, CAST(count_if(ok) AS BIGINT) AS matched FROM (
  SELECT o.org_state, CASE
    WHEN l.org_id % 3 = 0 THEN coalesce(l.city, '') = CASE WHEN o.org_city = 'Albany' THEN 'Albany' ELSE o.org_city END AND coalesce(l.us_state, '') = o.org_state
    WHEN l.org_id % 3 = 1 THEN coalesce(l.us_state = o.org_state, FALSE)
    ELSE coalesce(contains(lower(l.city), 'new'), FALSE) END AS ok
  FROM leads l JOIN organizations o USING (org_id)) GROUP BY org_state""")
def location_match(e: Entities) -> DataFrame:
    """Lead place against a request that names a city and state, a state, or free text."""
    orgs = e.organizations.select("org_id", F.col("org_city").alias("want_city"), F.col("org_state").alias("want_state"))
    joined = e.leads.drop("org_city", "org_state").join(orgs, "org_id")
    m = F.col("org_id") % 3
    ok = location_matches(F.col("city"), F.col("us_state"), F.when(m == 0, F.upper("want_city")),
                          F.when(m != 2, F.lower("want_state")), F.when(m == 2, F.lit("New")))
    return joined.groupBy(F.col("want_state").alias("org_state")).agg(
        F.count(F.lit(1)).alias("leads"), F.count_if(ok).alias("matched"))


@plan("all_words_match", sql=r"""
SELECT doc_id FROM documents WHERE contains(lower(text), 'token') OR (contains(lower(text), 'that') AND contains(lower(text), 'whst'))""")
def all_words(e: Entities) -> DataFrame:
    """Every keyword word except filler words occurs in the whole text; blank texts, which the operator lets pass, are left out."""
    matched = all_words_match(F.col("text"), F.lit("Leads for token")) | all_words_match(F.col("text"), F.lit("THAT of whst"))
    return e.documents.filter(present(F.col("text")) & matched).select("doc_id")


@plan("missing_requirements", sql="""
SELECT o_orderkey AS request_id, concat_ws('; ',
  CASE WHEN o_orderkey % 3 = 0 THEN 'record type' END,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN 'category' END,
  CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 THEN 'state' WHEN o_orderkey % 5 > 1 AND o_orderkey % 2 = 0 THEN 'location' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'quantity' END, CASE WHEN o_orderkey % 6 = 0 THEN 'contact requirements' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'record choice' END,
  CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 9 <> 0 THEN 'city' END) AS missing FROM orders""")
def missing_requirements(e: Entities) -> DataFrame:
    """Open points of a request; "any" and "no" count as answers."""
    k = F.col("o_orderkey")
    slots = {
        "record_kind": F.when(k % 3 != 0, F.lit("company")), "category": F.when(k % 4 != 0, F.lit("roofing")),
        "category_specified": k % 8 == 0,
        "location_scope": F.when(k % 5 == 0, F.lit("any")).when(k % 5 == 1, F.lit("statewide")),
        "us_state": F.when(k % 2 != 0, F.lit("NY")), "quantity": F.when(k % 7 != 0, k % 50 + 1),
        "has_email": F.when(k % 6 != 0, F.lit(True)), "has_phone": F.lit(False), "needs_record_choice": k % 11 == 0,
        "source_needs_city": k % 13 == 0, "city": F.when(k % 9 == 0, F.lit("Albany")),
    }
    return e.orders.select(k.alias("request_id"), F.array_join(S.missing_requirements(slots), "; ").alias("missing"))


@plan("category_terms", sql="""
WITH a(trade, aliases) AS (VALUES ('ring', ['roofing', 'roofer', 'roofers']), ('bolt', ['plumber', 'plumbing', 'plumbers', 'pipefitting', 'pipefitter', 'drainage']),
  ('gear', ['gear']), ('plate', ['tile', 'flooring', 'tiling']))
SELECT p_partkey AS part_id, list_aggregate(list_sort(aliases), 'string_agg', '|') AS plain_terms,
  CAST(len(list_distinct(flatten(list_transform(aliases, lambda x: CASE WHEN x LIKE '%s' THEN [x, x[:-2]] ELSE [x] END)))) * 2 AS INTEGER) AS contractor_terms
FROM part JOIN a ON trade = split_part(p_name, ' ', 2)""")
def category_terms(e: Entities) -> DataFrame:
    """Search terms of a trade with its aliases."""
    noun = F.substring_index("p_name", " ", -1)
    trade = (F.when(noun == "ring", F.lit("Roofing")).when(noun == "bolt", F.lit("plumber companies"))
             .when(noun == "gear", F.lit("gear")).when(noun == "plate", F.lit("tile")))
    terms = S.category_variations(trade)
    return e.part.filter(noun.isin("ring", "bolt", "gear", "plate")).select(
        F.col("p_partkey").alias("part_id"), F.array_join(F.array_sort(terms["plain"]), "|").alias("plain_terms"),
        F.size(F.filter(terms["contractor"], lambda t: ~t.contains("companies"))).alias("contractor_terms"))


@plan("lead_view", uses="leads organizations", sql="""
WITH c AS (SELECT l_orderkey AS lead_id, min(l_suppkey) FILTER (l_suppkey % 4 = 0) AS sup FROM lineitem GROUP BY 1),
v AS (SELECT lead_id, record_kind, leads.city, us_state, leads.org_city, leads.org_state, org_name, o.email AS o_email, o.phone AS o_phone, sup,
    CASE WHEN lead_id % 10 = 0 THEN 'meta' || lead_id || '@firm.com' END AS m_email
  FROM leads LEFT JOIN organizations o USING (org_id) LEFT JOIN c USING (lead_id)),
w AS (SELECT *, CASE WHEN record_kind = 'company' THEN coalesce(city, org_city) ELSE city END AS vc,
  CASE WHEN record_kind = 'company' THEN coalesce(us_state, org_state) ELSE us_state END AS vs FROM v)
SELECT lead_id, org_name AS company, coalesce(m_email, 'contact' || sup || '@firm.com', CASE WHEN record_kind = 'company' THEN o_email END) AS email,
  CASE WHEN record_kind = 'company' THEN o_phone END AS phone, vc AS city, vs AS state,
  CASE WHEN vc IS NOT NULL AND vs IS NOT NULL THEN vc || ', ' || vs ELSE coalesce(vc, vs) END AS location FROM w""")
def lead_view(e: Entities) -> DataFrame:
    """Displayed values of every lead, children reduced to one row before they are joined."""
    contacts = e.lineitem.filter(F.col("l_suppkey") % 4 == 0).select(
        F.col("l_orderkey").alias("lead_id"), "l_suppkey",
        F.concat(F.lit("contact"), F.col("l_suppkey"), F.lit("@firm.com")).alias("contact_email"))
    first = S.primary_children(contacts, "lead_id", [F.col("l_suppkey")], ["contact_email"])
    orgs = e.organizations.select("org_id", "org_name", F.col("email").alias("org_email"), F.col("phone").alias("org_phone"))
    leads = e.leads.join(orgs, "org_id", "left").join(first, "lead_id", "left").withColumn(
        "meta_email", F.when(F.col("lead_id") % 10 == 0, F.concat(F.lit("meta"), F.col("lead_id"), F.lit("@firm.com"))))
    return S.lead_view(leads).select(
        "lead_id", F.col("org_name").alias("company"), F.col("view_email").alias("email"), F.col("view_phone").alias("phone"),
        F.col("view_city").alias("city"), F.col("view_state").alias("state"), F.col("view_location").alias("location"))


@plan("criteria_canonical", uses="organizations", sql="""
SELECT org_id AS request_id, CASE WHEN org_id % 4 = 0 THEN NULL WHEN org_id % 4 = 1 THEN industry ELSE 'Roofing' END AS category,
  org_state AS us_state, CASE WHEN org_city = 'New York' THEN NULL ELSE org_city END AS city,
  CAST(CASE WHEN org_id % 2 = 0 THEN org_id % 30 + 1 ELSE 20 END AS INTEGER) AS quantity,
  CASE WHEN org_id % 3 = 0 THEN 'reporter' ELSE 'gov' END AS source, org_id % 5 = 0 AS rejected FROM organizations""")
def criteria_canonical(e: Entities) -> DataFrame:
    """Requests with alias fields, generic categories and redundant cities in canonical form."""
    k = F.col("org_id")
    raw = e.organizations.select(
        k.alias("request_id"),
        F.when(k % 4 == 0, F.lit(" Contractors ")).when(k % 4 == 1, F.col("industry")).otherwise(F.lit("")).alias("category"),
        F.when(k % 4 > 1, F.lit(" Roofing")).alias("keyword"), F.lower("org_state").alias("us_state"),
        F.upper("org_city").alias("city"), F.when(k % 2 == 0, k % 30 + 1).alias("limit"),
        F.when(k % 3 == 0, F.lit("NY")).otherwise(F.lit("Gov Scraper")).alias("source"),
        F.when(k % 5 == 0, F.lit("person")).otherwise(F.lit("company")).alias("record_kind"))
    return S.canonical_criteria(raw, {"ny": "reporter"}).select(
        "request_id", "category", "us_state", "city", "quantity", "source", (F.size("problems") > 0).alias("rejected"))


@plan("main_location", uses="leads organizations", sql="""
WITH loc AS (SELECT l_orderkey AS lead_id, l_suppkey, l_linenumber, l_partkey % 5 = 0 AS is_main FROM lineitem),
pick AS (SELECT lead_id, l_suppkey, is_main, row_number() OVER (PARTITION BY lead_id ORDER BY is_main DESC, l_linenumber, l_suppkey) AS rn FROM loc)
SELECT lead_id, l_suppkey AS location_id, is_main, org_name FROM pick JOIN leads USING (lead_id) JOIN organizations USING (org_id)
WHERE rn = 1 AND org_name ILIKE '%customer%1%'""")
def main_location(e: Entities) -> DataFrame:
    """The location flagged as main, else the first one, for organisations found by partial name."""
    loc = e.lineitem.select(F.col("l_orderkey").alias("lead_id"), F.col("l_suppkey").alias("location_id"), "l_linenumber",
                            (F.col("l_partkey") % 5 == 0).alias("is_main"))
    main = S.primary_children(loc, "lead_id", [~F.col("is_main"), F.col("l_linenumber"), F.col("location_id")], ["location_id", "is_main"])
    named = e.organizations.filter(F.col("org_name").ilike("%customer%1%")).select("org_id", "org_name")
    return main.join(e.leads.select("lead_id", "org_id"), "lead_id").join(named, "org_id").select(
        "lead_id", "location_id", "is_main", "org_name")
