"""Merging, upserts, sightings, accounting, listings and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators.ordered import block_bucket, day_bucket
from ..session import scratch_folder
from .bindings import AS_OF, Entities, as_of
from .registry import plan

FIELDS = ["title", "notes", "category", "due_at"]


def _line_bucket() -> Column:
    return block_bucket(F.col("line"))


@plan("batch_merge_first", uses="arrivals", sql="""
SELECT DISTINCT identity, first_value(nullif(title, '') IGNORE NULLS) OVER w AS title, first_value(notes IGNORE NULLS) OVER w AS notes,
  first_value(category IGNORE NULLS) OVER w AS category, first_value(due_at IGNORE NULLS) OVER w AS due_at, count(*) OVER w AS observations FROM arrivals
WINDOW w AS (PARTITION BY identity ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def batch_merge_first(e: Entities) -> DataFrame:
    """First non-empty value per field and identity."""
    return M.merge_batch(e.arrivals, ["identity"], "ordinal", FIELDS)


@plan("arrival_merge_last", uses="arrivals", sql="""
WITH s AS (SELECT identity, ordinal, last_value(nullif(title, '') IGNORE NULLS) OVER w AS title, last_value(notes IGNORE NULLS) OVER w AS notes,
    last_value(category IGNORE NULLS) OVER w AS category, last_value(due_at IGNORE NULLS) OVER w AS due_at FROM arrivals
  WINDOW w AS (PARTITION BY identity ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, row_number() OVER v AS rn, row_number() OVER (PARTITION BY identity ORDER BY ordinal DESC) AS back,
    (lag(title) OVER v IS DISTINCT FROM title OR lag(notes) OVER v IS DISTINCT FROM notes OR lag(category) OVER v IS DISTINCT FROM category
      OR lag(due_at) OVER v IS DISTINCT FROM due_at) AS differs FROM s WINDOW v AS (PARTITION BY identity ORDER BY ordinal)),
n AS (SELECT identity, 1 + count(*) FILTER (rn > 1 AND differs) AS version FROM c GROUP BY identity)
SELECT identity, title, notes, category, due_at, version FROM c JOIN n USING (identity) WHERE back = 1""")
def arrival_merge_last(e: Entities) -> DataFrame:
    """Latest non-empty values per identity with a version per material change."""
    return M.merge_arrivals(e.arrivals, "identity", "ordinal", _line_bucket(), FIELDS).drop("content_hash")


@plan("upsert_rows", uses="arrivals", sql=f"""
WITH s AS (SELECT identity, ordinal, line, source_code, seen_at, last_value(nullif(title, '') IGNORE NULLS) OVER w AS title, last_value(notes IGNORE NULLS) OVER w AS notes,
    last_value(category IGNORE NULLS) OVER w AS category, last_value(due_at IGNORE NULLS) OVER w AS due_at,
    last_value(CASE WHEN line % 2 = 0 THEN line_status END IGNORE NULLS) OVER w AS state, last_value(CASE WHEN line % 3 = 0 THEN source_code END IGNORE NULLS) OVER w AS mark
  FROM arrivals WINDOW w AS (PARTITION BY identity ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, row_number() OVER v AS rn, row_number() OVER (PARTITION BY identity ORDER BY ordinal DESC) AS back,
    (lag(title) OVER v IS DISTINCT FROM title OR lag(notes) OVER v IS DISTINCT FROM notes OR lag(category) OVER v IS DISTINCT FROM category
      OR lag(due_at) OVER v IS DISTINCT FROM due_at OR lag(state) OVER v IS DISTINCT FROM state OR lag(mark) OVER v IS DISTINCT FROM mark) AS differs
  FROM s WINDOW v AS (PARTITION BY identity ORDER BY ordinal)),
n AS (SELECT identity, 1 + count(*) FILTER (rn > 1 AND differs) AS version, arg_min(source_code, ordinal) AS source_code,
  count(*) FILTER (line <= 3) > 0 AS known, count(*) FILTER (line > 3) AS later, count(*) FILTER (line > 3 AND rn > 1 AND differs) AS changed FROM c GROUP BY identity)
SELECT identity, title, notes, category, due_at, n.source_code, version, coalesce(mark, '') AS mark, coalesce(state, '') AS state,
  CASE WHEN NOT known THEN 'inserted' WHEN later = 0 THEN 'untouched' WHEN changed > 0 THEN 'updated' ELSE 'unchanged' END AS outcome
FROM c JOIN n USING (identity) WHERE back = 1""")
def upsert_rows(e: Entities) -> DataFrame:
    """Two batches of arrivals: fields, open metadata, version and outcome are those of a single pass."""
    extra = F.map_filter(F.create_map(F.lit("state"), F.when(F.col("line") % 2 == 0, F.col("line_status")), F.lit("mark"), F.when(F.col("line") % 3 == 0, F.col("source_code"))),
                         lambda k, v: v.isNotNull())
    rows = e.arrivals.withColumn("extra", extra).select("identity", "ordinal", "line", *FIELDS, "source_code", "extra")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    empty = e.spark.createDataFrame([], ", ".join(f"{c} {kinds[c]}" for c in ["identity", *FIELDS, "source_code", "extra"]) + ", version bigint, content_hash string, "
                                    "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")

    def apply(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return M.upsert_arrivals(stored, batch, "identity", "ordinal", _line_bucket(), FIELDS, ["source_code"], FIELDS, as_of())

    folder = scratch_folder(e.spark, "stored")  # the first batch is a stored table when the second arrives
    apply(empty, rows.filter("line <= 3")).drop("outcome").write.parquet(folder)
    done = apply(e.spark.read.schema(empty.schema).parquet(folder), rows.filter("line > 3"))
    return done.select("identity", *FIELDS, "source_code", "version", *[F.coalesce(F.try_element_at("extra", F.lit(k)), F.lit("")).alias(k) for k in ("mark", "state")], "outcome")


@plan("upsert_outcomes", uses="arrivals", sql=f"""
WITH old_rows AS (SELECT * FROM arrivals WHERE seen_at < TIMESTAMP '{AS_OF}'),
new_rows AS (SELECT *, CASE WHEN line = 7 AND notes IS NULL THEN NULL ELSE identity END AS key FROM arrivals WHERE seen_at >= TIMESTAMP '{AS_OF}'),
old AS (SELECT DISTINCT identity, last_value(nullif(title, '') IGNORE NULLS) OVER w AS title, last_value(notes IGNORE NULLS) OVER w AS notes,
  last_value(category IGNORE NULLS) OVER w AS category, last_value(due_at IGNORE NULLS) OVER w AS due_at FROM old_rows
  WINDOW w AS (PARTITION BY identity ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
new AS (SELECT DISTINCT key AS identity, first_value(nullif(title, '') IGNORE NULLS) OVER w AS title, first_value(notes IGNORE NULLS) OVER w AS notes,
  first_value(category IGNORE NULLS) OVER w AS category, first_value(due_at IGNORE NULLS) OVER w AS due_at FROM new_rows WHERE key IS NOT NULL
  WINDOW w AS (PARTITION BY key ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
res AS (SELECT n.identity, CASE WHEN o.identity IS NULL THEN 'inserted' WHEN coalesce(n.title, o.title) IS DISTINCT FROM o.title
  OR coalesce(n.notes, o.notes) IS DISTINCT FROM o.notes OR coalesce(n.category, o.category) IS DISTINCT FROM o.category
  OR coalesce(n.due_at, o.due_at) IS DISTINCT FROM o.due_at THEN 'updated' ELSE 'unchanged' END AS outcome FROM new n LEFT JOIN old o USING (identity)),
k AS (SELECT source_code AS run, key AS identity, count(*) AS n FROM new_rows GROUP BY ALL),
r AS (SELECT run, CAST(count(*) FILTER (outcome = 'inserted') AS BIGINT) AS inserted, CAST(count(*) FILTER (outcome = 'updated') AS BIGINT) AS updated,
  CAST(sum(CASE WHEN k.identity IS NULL THEN 0 WHEN outcome = 'unchanged' THEN n ELSE n - 1 END) AS BIGINT) AS unchanged,
  CAST(coalesce(sum(n) FILTER (k.identity IS NULL), 0) AS BIGINT) AS skipped FROM k LEFT JOIN res USING (identity) GROUP BY run)
SELECT *, inserted + updated + unchanged AS verified, updated + unchanged AS duplicates,
  CASE WHEN inserted + updated + unchanged = 0 THEN 'Failed' WHEN inserted + updated + unchanged < 1000000000 THEN 'Partial' END AS status FROM r""")
def upsert_outcomes(e: Entities) -> DataFrame:
    """A second run merged into the first one, with the counters and state of each source's run."""
    seen = F.col("seen_at") >= as_of()
    old = M.merge_latest(e.arrivals.filter(~seen), ["identity"], "ordinal", FIELDS).withColumns({
        "content_hash": M.content_hash(FIELDS), "version": F.lit(1).cast("bigint"), "first_seen_at": as_of(), "last_seen_at": as_of()})
    lost = (F.col("line") == 7) & F.col("notes").isNull()
    incoming = e.arrivals.filter(seen).withColumn("identity", F.when(~lost, F.col("identity")))
    batch = M.merge_batch(incoming.filter(F.col("identity").isNotNull()), ["identity"], "ordinal", FIELDS)
    merged = M.upsert(old, batch, "identity", FIELDS, [], FIELDS, as_of())
    outcomes = M.batch_outcomes(incoming.withColumnRenamed("source_code", "run"), merged, "identity", "run")
    return M.run_rollup(outcomes, F.lit(1_000_000_000)).drop("errors")


@plan("org_upsert", sql="""
WITH o AS (SELECT c_nationkey % 10 || '-' || c_custkey // 3 AS key, c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS industry,
  CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name, c_custkey % 3 AS part FROM customer),
a AS (SELECT DISTINCT key, first_value(industry IGNORE NULLS) OVER w AS industry, first_value(name IGNORE NULLS) OVER w AS name FROM o WHERE part = 0
  WINDOW w AS (PARTITION BY key ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
b AS (SELECT DISTINCT key, first_value(industry IGNORE NULLS) OVER w AS industry, first_value(name IGNORE NULLS) OVER w AS name FROM o WHERE part <> 0
  WINDOW w AS (PARTITION BY key ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT key, coalesce(a.industry, b.industry) AS industry, coalesce(a.name, b.name) AS name FROM a FULL JOIN b USING (key)""")
def org_upsert(e: Entities) -> DataFrame:
    """Stored organisation values are permanent, gaps are filled."""
    k = F.col("c_custkey")
    rows = e.customer.select(
        F.concat(F.col("c_nationkey") % 10, F.lit("-"), F.floor(k / 3)).alias("key"), k.alias("ordinal"),
        F.when(k % 4 != 0, F.col("c_mktsegment")).alias("industry"), F.when(k % 5 != 0, F.col("c_name")).alias("name"), (k % 3).alias("part"))
    stored = M.merge_batch(rows.filter("part = 0"), ["key"], "ordinal", ["industry", "name"])
    return M.upsert_first_wins(stored, rows.filter("part <> 0"), "key", "ordinal", ["industry", "name"])


@plan("child_insert_absent", sql=f"""
WITH c AS (SELECT 'm' || (l_partkey % 50) AS email, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS org_id, l_orderkey, l_linenumber, l_partkey,
  l_shipdate < TIMESTAMP '{AS_OF}' AS stored FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY email, org_id ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM c WHERE NOT stored)
SELECT email, org_id, l_orderkey AS first_lead FROM f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE stored AND c.email = f.email AND c.org_id IS NOT DISTINCT FROM f.org_id)""")
def child_insert_absent(e: Entities) -> DataFrame:
    """Child rows inserted only where the null-safe natural key is new."""
    rows = e.lineitem.select(
        F.concat(F.lit("m"), F.col("l_partkey") % 50).alias("email"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("org_id"),
        F.col("l_orderkey").alias("first_lead"), "l_linenumber", "l_partkey", (F.col("l_shipdate") < as_of()).alias("stored"))
    fresh = M.insert_absent(rows.filter("stored"), rows.filter("NOT stored"), ["email", "org_id"],
                            [F.col("first_lead"), F.col("l_linenumber"), F.col("l_partkey")])
    return fresh.select("email", "org_id", "first_lead")


@plan("dataset_members", uses="leads", sql="""
WITH m AS (SELECT p_brand AS dataset_id, l_orderkey AS lead_id, l_shipdate AS added_at, l_linenumber <= 3 AS old FROM lineitem JOIN part ON p_partkey = l_partkey),
o AS (SELECT dataset_id, lead_id, min(added_at) AS added_at FROM m WHERE old GROUP BY ALL),
f AS (SELECT dataset_id, lead_id, min(added_at) AS added_at FROM m WHERE NOT old AND NOT EXISTS (SELECT 1 FROM o WHERE o.dataset_id = m.dataset_id AND o.lead_id = m.lead_id) GROUP BY ALL),
a AS (SELECT * FROM o UNION ALL SELECT * FROM f), n AS (SELECT dataset_id, count(*) AS inserted FROM f GROUP BY 1)
SELECT a.dataset_id, lead_id, added_at, status, row_number() OVER (PARTITION BY a.dataset_id ORDER BY added_at, lead_id) AS position, coalesce(inserted, 0) AS inserted
FROM a JOIN leads USING (lead_id) LEFT JOIN n ON n.dataset_id = a.dataset_id""")
def dataset_members(e: Entities) -> DataFrame:
    """Members added to datasets without repeats, and the rows of each dataset in the order they were added."""
    brands = e.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("dataset_id"))
    rows = e.lineitem.join(brands, "l_partkey").select("dataset_id", F.col("l_orderkey").alias("lead_id"), F.col("l_shipdate").alias("added_at"), "l_linenumber")
    stored = rows.filter("l_linenumber <= 3").groupBy("dataset_id", "lead_id").agg(F.min("added_at").alias("added_at"))
    members, inserted = M.add_members(stored, rows.filter("l_linenumber > 3").drop("l_linenumber"))
    listed = M.dataset_rows(members, e.leads.select("lead_id", "status"), day_bucket(F.col("added_at")))
    return listed.join(inserted, "dataset_id", "left").select("dataset_id", "lead_id", "added_at", "status", "position", F.coalesce("inserted", F.lit(0)).alias("inserted"))


@plan("sighting_upsert", uses="lead_sources", sql=f"""
WITH s AS (SELECT source_code, split_part(external_id, '-', 1) AS external_id, lead_id, seen_at, seen_at >= TIMESTAMP '{AS_OF}' AS fresh,
  CASE WHEN lead_id % 3 <> 0 THEN 'https://s.example.com/' || strftime(seen_at, '%Y%m%d') END AS source_url FROM lead_sources),
u AS (SELECT source_code, external_id, source_url, row_number() OVER (PARTITION BY source_code, external_id ORDER BY seen_at DESC) AS rn FROM s WHERE source_url IS NOT NULL)
SELECT source_code, external_id, min(lead_id) AS lead_id, max(seen_at) AS seen_at, any_value(u.source_url) AS source_url
FROM s LEFT JOIN (SELECT * FROM u WHERE rn = 1) u USING (source_code, external_id) GROUP BY ALL""")
def sighting_upsert(e: Entities) -> DataFrame:
    """Sightings refreshed by a second run, the newest known URL kept."""
    rows = e.lead_sources.select(
        "source_code", F.substring_index("external_id", "-", 1).alias("external_id"), "lead_id", "seen_at",
        F.when(F.col("lead_id") % 3 != 0, F.concat(F.lit("https://s.example.com/"), F.date_format("seen_at", "yyyyMMdd"))).alias("source_url"))
    fresh = F.col("seen_at") >= as_of()
    return M.upsert_sightings(rows.filter(~fresh), rows.filter(fresh))


@plan("alias_resolution", uses="lead_sources", sql=f"""
WITH k AS (SELECT source_code, external_id, 'src:' || min(lead_id) AS known FROM lead_sources WHERE seen_at < TIMESTAMP '{AS_OF}' GROUP BY ALL)
SELECT r.lead_id, r.external_id, coalesce(known, 'new:' || r.lead_id) AS identity_key, count(*) AS n
FROM lead_sources r LEFT JOIN k USING (source_code, external_id) GROUP BY ALL""")
def alias_resolution(e: Entities) -> DataFrame:
    """A known (source, external id) overrides the computed identity."""
    rows = e.lead_sources.withColumn("identity_key", F.concat(F.lit("new:"), "lead_id"))
    known = e.lead_sources.filter(F.col("seen_at") < as_of()).withColumn("identity_key", F.concat(F.lit("src:"), "lead_id"))
    return M.resolve_aliases(rows, known).groupBy("lead_id", "external_id", "identity_key").agg(F.count(F.lit(1)).alias("n"))


@plan("reference_lookup", sql="""
SELECT p_type AS code, CASE WHEN p_type <> 'PROMO' THEN 'id-' || lower(p_type) END AS source_id, count(*) AS parts FROM part GROUP BY 1, 2""")
def reference_lookup(e: Entities) -> DataFrame:
    """Codes validated against a dimension, case-insensitively; unknown ones become NULL."""
    known = e.part.filter("p_type <> 'PROMO'").select(F.lower("p_type").alias("code"), F.concat(F.lit("id-"), F.lower("p_type")).alias("id")).distinct()
    rows = e.part.select(F.col("p_type").alias("kind"), F.initcap("p_type").alias("source_id"))
    checked = M.valid_reference(rows, "source_id", known, "code", "id")
    return checked.groupBy(F.col("kind").alias("code"), "source_id").agg(F.count(F.lit(1)).alias("parts"))


@plan("find_or_create", sql="""
SELECT name, bool_and(NOT old) AS created, min(k) AS first_key FROM (SELECT lower(c_mktsegment) || c_nationkey AS name, c_custkey AS k, c_custkey % 3 = 0 AS old FROM customer) c
WHERE old OR name NOT IN (SELECT lower(c_mktsegment) || c_nationkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY name""")
def find_or_create(e: Entities) -> DataFrame:
    """Existing rows plus created ones for missing keys."""
    rows = e.customer.select(F.concat(F.lower("c_mktsegment"), "c_nationkey").alias("name"), F.col("c_custkey").alias("first_key"))
    stored = rows.filter("first_key % 3 = 0").groupBy("name").agg(F.min("first_key").alias("first_key"))
    return M.find_or_create(stored, rows.filter("first_key % 3 <> 0"), "name", [F.col("first_key")])


@plan("listing_merge", sql="""
WITH r AS (SELECT l_suppkey AS company_id, l_orderkey * 10 + l_linenumber AS o, 'Supplier ' || l_suppkey || repeat('x', CAST(l_linenumber % 3 AS INTEGER)) AS name,
  CASE WHEN l_partkey % 3 <> 0 THEN '555-' || (l_partkey % 4) END AS phone, CASE WHEN l_partkey % 5 = 0 THEN 'm' || (l_partkey % 2) || '@x.com' END AS email,
  CASE WHEN l_quantity > 40 THEN 'City' || (l_partkey % 3) END AS city, l_returnflag AS trade, l_partkey FROM lineitem),
f AS (SELECT company_id, phone, email, city, name, row_number() OVER (PARTITION BY company_id ORDER BY CASE WHEN phone IS NULL THEN 1 ELSE 0 END, o, l_partkey) AS rp,
  row_number() OVER (PARTITION BY company_id ORDER BY CASE WHEN email IS NULL THEN 1 ELSE 0 END, o, l_partkey) AS re,
  row_number() OVER (PARTITION BY company_id ORDER BY CASE WHEN city IS NULL THEN 1 ELSE 0 END, o, l_partkey) AS rc FROM r),
m AS (SELECT company_id, max(phone) FILTER (rp = 1) AS phone, max(email) FILTER (re = 1) AS email, max(city) FILTER (rc = 1) AS city,
  max_by(name, length(name)) AS name FROM f GROUP BY company_id)
SELECT m.*, array_to_string(list_sort(list_distinct(list(r.name) FILTER (r.name <> m.name))), ',') AS name_aliases,
  array_to_string(list_sort(list_distinct(list(r.phone) FILTER (r.phone <> m.phone))), ',') AS extra_phones,
  array_to_string(list_sort(list_distinct(list(r.trade))), ',') AS trades, count(*) AS listed_rows FROM m JOIN r USING (company_id) GROUP BY ALL""")
def listing_merge(e: Entities) -> DataFrame:
    """Repeated listing rows of a company merged into one."""
    k = F.col("l_partkey")
    rows = e.lineitem.select(
        F.col("l_suppkey").alias("company_id"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), k).alias("ordinal"),
        F.concat(F.lit("Supplier "), "l_suppkey", F.repeat(F.lit("x"), F.col("l_linenumber") % 3)).alias("name"),
        F.when(k % 3 != 0, F.concat(F.lit("555-"), k % 4)).alias("phone"), F.when(k % 5 == 0, F.concat(F.lit("m"), k % 2, F.lit("@x.com"))).alias("email"),
        F.when(F.col("l_quantity") > 40, F.concat(F.lit("City"), k % 3)).alias("city"), F.array("l_returnflag").alias("trades"), F.lit("u").alias("url"))
    merged = M.merge_listings(rows, "company_id", "ordinal", ["city"], ["trades"])
    return merged.select("company_id", "phone", "email", "city", "name", *[F.array_join(c, ",").alias(c) for c in ("name_aliases", "extra_phones", "trades")], "listed_rows")


@plan("location_merge", sql="""
WITH r AS (SELECT l_suppkey AS company_id, l_orderkey * 10 + l_linenumber AS o, l_partkey, CASE WHEN l_partkey % 4 <> 0 THEN (l_partkey % 9) || ' Main St.' END AS address,
  CASE WHEN l_partkey % 3 = 0 THEN '555-' || (l_partkey % 4) END AS phone, l_returnflag AS label, l_linenumber = 1 AS is_main FROM lineitem)
SELECT company_id, coalesce(regexp_replace(lower(address), '[^a-z0-9]', '', 'g'), phone, lower(label)) AS location_key,
  arg_min(label, (o, l_partkey, label)) AS label, bool_or(is_main) AS is_main FROM r GROUP BY 1, 2""")
def location_merge(e: Entities) -> DataFrame:
    """Locations of a company by address, phone or label."""
    k = F.col("l_partkey")
    rows = e.lineitem.select(
        F.col("l_suppkey").alias("company_id"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), k, "l_returnflag").alias("ordinal"),
        F.when(k % 4 != 0, F.concat(k % 9, F.lit(" Main St."))).alias("address"), F.when(k % 3 == 0, F.concat(F.lit("555-"), k % 4)).alias("phone"),
        F.col("l_returnflag").alias("label"), (F.col("l_linenumber") == 1).alias("is_main"))
    return M.merge_locations(rows, "company_id", "ordinal", ["label"])


def people_candidates(e: Entities) -> DataFrame:
    k = F.col("l_partkey")
    return e.lineitem.select(
        F.col("l_suppkey").alias("company_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        F.concat(F.element_at(F.array(F.lit("Mr. Jane Doe"), F.lit("jane  doe"), F.lit("Ann Lee"), F.lit("Bob Ray")), (k % 4 + 1).cast("int"))).alias("name"),
        F.when(k % 3 == 0, F.lit("Owner")).alias("title"), F.when(k % 5 != 0, F.concat(F.lit("+1212555000"), k % 3)).alias("phone"),
        F.when(k % 7 == 0, F.concat(F.lit("P"), k % 2, F.lit("@x.com"))).alias("email"))


@plan("person_merge")
def person_merge(e: Entities) -> DataFrame:
    """People per company with compatible contact data put together (checked against brute force in tests)."""
    return M.merge_people(people_candidates(e)).select(
        "company_id", "person_key", "name", "title", "phone", "email", F.array_join("extra_phones", ",").alias("extra_phones"),
        F.array_join("extra_emails", ",").alias("extra_emails"), "first_seen")


@plan("person_export", sql="""
WITH c AS (SELECT l_suppkey AS company_id, CASE l_partkey % 4 WHEN 0 THEN 'jane doe' WHEN 1 THEN 'jane doe' WHEN 2 THEN 'ann lee' ELSE 'bob ray' END AS person_key FROM lineitem WHERE l_suppkey % 5 <> 0),
n AS (SELECT company_id, count(DISTINCT person_key) AS people FROM c GROUP BY 1)
SELECT s_suppkey AS company_id, person_key IS NULL AS blank_person, count(*) AS persons FROM supplier LEFT JOIN (SELECT DISTINCT * FROM c) c ON s_suppkey = company_id GROUP BY ALL""")
def person_export(e: Entities) -> DataFrame:
    """One row per company and person, a blank-person row for companies without people."""
    people = M.merge_people(people_candidates(e).filter("company_id % 5 <> 0"))
    companies = e.supplier.select(F.col("s_suppkey").alias("company_id"), F.lit("+12125550000").alias("company_phone"), F.lit("info@x.com").alias("company_email"))
    rows = M.person_rows(companies, people)
    return rows.groupBy("company_id", F.col("person").isNull().alias("blank_person")).agg(F.count(F.lit(1)).alias("persons"))


@plan("backfill", sql="""
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'key' || c_custkey ELSE md5(CAST(c_custkey AS VARCHAR)) END AS key, lower(c_mktsegment) AS code,
  CASE WHEN c_custkey % 3 = 0 THEN 'opportunity' ELSE 'company' END AS record_kind, CASE WHEN c_custkey % 5 <> 0 THEN 'NY' END AS us_state FROM customer""")
def backfill(e: Entities) -> DataFrame:
    """Missing keys, codes and metadata fields filled from what is stored."""
    k = F.col("c_custkey")
    meta = F.to_json(F.struct(F.when(k % 3 == 0, F.lit("opportunity")).alias("kind"), F.when(k % 5 != 0, F.lit("NY")).alias("state")))
    key = F.when(k % 2 == 0, F.concat(F.lit("key"), k))
    return e.customer.select(
        k.alias("id"), F.coalesce(key, F.md5(k.cast("string"))).alias("key"), F.lower("c_mktsegment").alias("code"),
        F.coalesce(F.get_json_object(meta, "$.kind"), F.lit("company")).alias("record_kind"), F.get_json_object(meta, "$.state").alias("us_state"))
