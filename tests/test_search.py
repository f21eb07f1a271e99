"""Criteria that requests may use, on small leads."""

from pyspark.sql import functions as F

from siftwell.operators import search as S
from siftwell.operators.standardize import project_with_map

LEADS = ("lead_id long, org_id long, record_kind string, source_code string, city string, us_state string, text string, status string, "
         "created_at timestamp_ntz, due_at timestamp_ntz, last_seen_at timestamp_ntz, content_version int")


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


def lead(i, **kw):
    row = {"org_id": i % 3, "record_kind": "company", "source_code": "Portal", "city": "Albany", "us_state": "NY", "text": "roof work", "status": "New"} | kw
    return (i, row["org_id"], row["record_kind"], row["source_code"], row["city"], row["us_state"], row["text"], row["status"], None, None, None, 1)


def matched(spark, leads, **asked):
    kinds = {bool: "boolean", int: "int", str: "string", list: "array<bigint>"}
    table = leads if not isinstance(leads, list) else spark.createDataFrame(leads, LEADS)
    request = spark.createDataFrame([(1, *asked.values())], "request_id long, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in asked.items()))
    if "org_places" not in table.columns:
        table = table.withColumns({"org_city": F.lit(None).cast("string"), "org_state": F.lit(None).cast("string")})
    return S.match_requests(table, S.canonical_criteria(request), now())


def ids(df):
    return sorted(r.lead_id for r in df.collect())


def test_source_own_or_seen(spark):
    leads = spark.createDataFrame([lead(1), lead(2, source_code="other"), lead(3, source_code=None)], LEADS)
    seen = spark.createDataFrame([(3, "por-tal"), (2, "x")], "lead_id long, source_code string")
    assert ids(matched(spark, S.with_sources(leads, seen), source="portal")) == [1, 3]
    assert ids(matched(spark, [lead(1)], source="portal")) == []


def test_status_and_exclusions(spark):
    leads = [lead(1), lead(2, status="Called"), lead(3)]
    assert ids(matched(spark, leads, status="New", exclude_lead_ids=[3])) == [1]
    assert ids(matched(spark, leads, assigned_to=4)) == []


def test_any_place_of_the_organisation(spark):
    leads = spark.createDataFrame([lead(1, city=None, us_state=None), lead(2, city=None, us_state=None, record_kind="opportunity")], LEADS)
    places = spark.createDataFrame([(1, "Utica", "ny"), (1, "Salem", "MA"), (2, "Salem", "MA")], "org_id long, city string, state string")
    placed = S.with_places(leads, places)
    assert ids(matched(spark, placed, city="Salem", us_state="MA")) == [1] and ids(matched(spark, placed, us_state="NY")) == [1]
    assert ids(matched(spark, placed, us_state="TX")) == [] and ids(matched(spark, placed, quantity=5)) == [1, 2]


def test_quantity_is_the_only_cap(spark):
    found = matched(spark, [lead(i) for i in range(1500)], quantity=1200, us_state="NY")
    ranked = S.rank_matches(found).collect()
    assert sorted(r.rank for r in ranked) == list(range(1, 1201))


def test_new_only_binds_who_asks(spark):
    pairs = spark.createDataFrame([(1, 7, 10, True), (2, 7, 10, False), (3, None, 10, True), (4, 7, 11, True)], "request_id long, user_id long, lead_id long, new_only boolean")
    pairs = pairs.withColumn("content_version", F.lit(1))
    told = spark.createDataFrame([(7, 10, 1, "x"), (7, 11, 2, "x")], "user_id long, lead_id long, record_version int, served_at string")
    assert sorted(r.request_id for r in S.exclude_delivered(pairs, told).collect()) == [2, 3, 4]


def test_own_metadata_of_a_record_is_kept(spark):
    raw = {"title": "t", "colour": "red", "extra": '{"colour": "blue", "size": "2"}'}
    rows = spark.createDataFrame([(1, raw, None)], "ordinal long, raw map<string,string>, field_map map<string,string>")
    assert project_with_map(rows).collect()[0].extra == {"colour": "red", "size": "2"}
