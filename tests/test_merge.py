"""Merge rules, upserts and people."""

import random

from pyspark.sql import functions as F

from siftwell.operators import merge as M
from siftwell.operators.standardize import ingest_fields

RAW = "ordinal long, record_kind string, source_code string, external_id string, title string, description string, organization_name string, phone string, email string, city string, us_state string, contact_name string"


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz")


def empty_store(spark):
    return M.LeadStore(**{n: spark.createDataFrame([], s) for n, s in M.STORE_SCHEMAS.items()})


def records(spark, rows):
    return ingest_fields(spark.createDataFrame(rows, RAW))


def opportunity(i, ext, title="Bid", description=None, org="City of Albany", **kw):
    return (i, "opportunity", "reg", ext, title, description, org, kw.get("phone"), kw.get("email"), kw.get("city", "Albany"), kw.get("state", "NY"), kw.get("contact"))


def counts(outcomes):
    r = outcomes.collect()[0]
    return r.inserted, r.updated, r.unchanged, r.skipped


def test_same_batch_twice_changes_nothing(spark):
    rows = records(spark, [opportunity(i, f"x{i}", contact="Jane Doe", email="j@acme.com") for i in range(50)])
    store, first = M.upsert_store(empty_store(spark), rows, at(1))
    again, second = M.upsert_store(store, rows, at(2))
    assert counts(first) == (50, 0, 0, 0) and counts(second) == (0, 0, 50, 0)
    for table in ("leads", "organizations", "contacts", "emails", "locations", "lead_sources"):
        assert getattr(again, table).count() == getattr(store, table).count()
    assert store.organizations.count() == store.contacts.count() == store.emails.count() == 1
    assert {r.version for r in again.leads.collect()} == {1}


def test_versions_do_not_depend_on_the_cut(spark):
    """One input in one, two and six batches, of which every state is stored and read back."""
    kinds = "key string, ordinal long, title string, note string, source string, extra map<string,string>"
    rows = [(f"k{i % 2}", i, f"t{i % 3}" if i % 4 else "", None if i % 5 else "n", f"s{i}", {"step": str(i % 4), "kind": "a"}) for i in range(12)]
    stored = "key string, title string, note string, source string, extra map<string,string>, version long, content_hash string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
    results = []
    for size in (12, 6, 2):
        state = spark.createDataFrame([], stored)
        for start in range(0, 12, size):
            batch = spark.createDataFrame(rows[start:start + size], kinds)
            state = M.upsert_arrivals(state, batch, "key", "ordinal", F.lit(0), ["title", "note"], ["source"], ["title", "note"], at(1))
            state = spark.createDataFrame(state.select([c.split()[0] for c in stored.split(", ")]).collect(), stored)
        results.append({r.key: (r.title, r.note, r.source, r.version, r.content_hash, tuple(sorted(r.extra.items()))) for r in state.collect()})
    assert results[0] == results[1] == results[2]
    assert {v[2] for v in results[0].values()} == {"s0", "s1"} and all(v[3] > 3 and dict(v[5])["kind"] == "a" for v in results[0].values())


def test_overlapping_halves(spark):
    first = records(spark, [opportunity(i, f"x{i}") for i in range(30)])
    second = records(spark, [opportunity(i, f"x{i}", title="New" if i % 2 else "Bid") for i in range(20, 40)])
    store, _ = M.upsert_store(empty_store(spark), first, at(1))
    store, outcomes = M.upsert_store(store, second, at(2))
    assert counts(outcomes) == (10, 5, 5, 0)
    assert {r.version: r.n for r in store.leads.groupBy("version").agg(F.count("*").alias("n")).collect()} == {1: 35, 2: 5}


def test_two_merge_rules_and_skipped_rows(spark):
    rows = records(spark, [opportunity(1, "a", title="first", description=None), opportunity(2, "a", title="second", description="d"),
                           (3, "company", None, None, None, None, None, None, None, None, None, None)])
    batch, outcomes = M.upsert_store(empty_store(spark), rows, at(1), merge="batch")
    arrival, _ = M.upsert_store(empty_store(spark), rows, at(1), merge="arrival")
    assert counts(outcomes) == (1, 0, 1, 1)
    assert [(r.title, r.description) for r in batch.leads.collect()] == [("first", "d")]
    assert [(r.title, r.description) for r in arrival.leads.collect()] == [("second", "d")]


def test_known_source_id_keeps_its_lead(spark):
    company = lambda i, phone: (i, "company", "dir", "77", "Acme", None, "Acme Inc", phone, None, None, None, None)
    store, _ = M.upsert_store(empty_store(spark), records(spark, [company(1, "212-555-0100")]), at(1))
    store, outcomes = M.upsert_store(store, records(spark, [company(2, "212-555-0199")]), at(2))
    assert counts(outcomes) == (0, 1, 0, 0)
    assert store.leads.count() == 1 and store.phones.count() == 2


def test_insert_absent_treats_null_as_equal(spark):
    old = spark.createDataFrame([("a", None, 1)], "k string, o string, n int")
    new = spark.createDataFrame([("a", None, 2), ("a", "x", 3), ("a", "x", 4)], "k string, o string, n int")
    assert [tuple(r) for r in M.insert_absent(old, new, ["k", "o"], [F.col("n")]).select("k", "o", "n").collect()] == [("a", "x", 3)]


def brute_force_people(rows):
    """Candidate by candidate; an exact repeat belongs to the entry of its first copy."""
    out, seen = {}, set()
    for company, ordinal, name, title, phone, email in sorted(rows, key=lambda r: r[1]):
        if (company, name, phone, email) in seen:
            continue
        seen.add((company, name, phone, email))
        people = out.setdefault((company, name), [])
        for p in people:
            same = (phone and p["phone"] == phone) or (email and p["email"].lower() == email.lower())
            clash = (phone and p["phone"] and p["phone"] != phone) or (email and p["email"] and p["email"].lower() != email.lower())
            if same or not clash:
                break
        else:
            p = {"phone": "", "email": "", "xp": [], "xe": []}
            people.append(p)
        for field, value, extra in (("phone", phone or "", "xp"), ("email", email or "", "xe")):
            if value and not p[field]:
                p[field] = value
            elif value and p[field].lower() != value.lower() and value not in p[extra]:
                p[extra].append(value)
    return sorted((k[0], k[1], p["phone"], p["email"], tuple(p["xp"]), tuple(p["xe"])) for k, ps in out.items() for p in ps)


def test_people_like_brute_force(spark):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.5 else rng.randrange(2, 6), i, rng.choice(["jane doe", "ann lee"]), None,
             rng.choice([None, "+12125550001", "+12125550002", "+12125550003"]), rng.choice([None, None, "a@x.com", "b@x.com"])) for i in range(400)]
    df = spark.createDataFrame(rows, "company_id long, ordinal long, name string, title string, phone string, email string").repartition(5)
    got = sorted((r.company_id, r.person_key, r.phone, r.email, tuple(r.extra_phones), tuple(r.extra_emails)) for r in M.merge_people(df).collect())
    assert got == brute_force_people(rows)


def test_person_rows(spark):
    people = M.merge_people(spark.createDataFrame([(1, 1, "Mr. Jane Doe", "Owner", "+1", None), (1, 2, "jane doe", None, None, "j@x.com"), (1, 3, "Ann Lee", None, None, None), (2, 4, "Bob Ray", None, None, None)],
                                                  "company_id long, ordinal long, name string, title string, phone string, email string"))
    companies = spark.createDataFrame([(1, "+9", "info@1"), (2, "+9", "info@2"), (3, None, "info@3")], "company_id long, company_phone string, company_email string")
    got = sorted(tuple(r) for r in M.person_rows(companies, people).select("company_id", F.coalesce("person", F.lit("")), "phone", "phone_source", "email").collect())
    assert got == [(1, "Ann Lee", "+9", "company", None), (1, "Mr. Jane Doe", "+1", "direct", "j@x.com"), (2, "Bob Ray", "+9", "company", "info@2"), (3, "", None, None, "info@3")]


def test_map_merge(spark):
    df = spark.createDataFrame([(1, 1, {"a": "1", "b": "1"}), (1, 2, {"b": "2"})], "k int, o int, m map<string,string>")
    assert M.merge_maps(df, ["k"], "o", "m").collect()[0].m == {"a": "1", "b": "2"}


def test_arrivals_fold_the_same_in_blocks_of_any_size(spark):
    """Two shuffles whatever the blocks: one of the arrivals, one of a summary per key and block."""
    pick = random.Random(7)
    rows = [(k, i, pick.choice([None, "", "a", "b"]), pick.choice([None, None, "x", "y"]), {n: pick.choice("uv") for n in "mnc" if pick.random() < 0.4})
            for k in range(40) for i in range(12)]
    expected = {}
    for k in range(40):
        state, extra, n = {}, {}, 1
        for place, (_, _, title, note, told) in enumerate([r for r in rows if r[0] == k]):
            fields = {f: v for f, v in (("title", title), ("note", note)) if v}
            changed = any(state.get(f) != v for f, v in fields.items()) or any(extra.get(e) != v for e, v in told.items() if e != "c")
            state.update(fields), extra.update(told)
            n += bool(place and changed)
        expected[k] = (state.get("title"), state.get("note"), extra, n)
    df = spark.createDataFrame(rows, "key int, ordinal int, title string, note string, extra map<string,string>")
    for size in (100, 5, 1):
        arrivals = df.withColumns({"_block": F.floor(F.col("ordinal") / size), "_at": F.col("ordinal")})
        folded = M.fold_arrivals(arrivals, "key", ["title", "note"], ["title", "note"], entries=True, context=["c"])
        assert {r.key: (r.title, r.note, r.extra, r._n + 1) for r in folded.collect()} == expected
    merged = M.merge_arrivals(df, "key", "ordinal", F.floor(F.col("ordinal") / 5), ["title", "note"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
