"""Criteria search: canonical requests, predicates, ranking and the lead view."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.place import normalize_state, parse_location
from ..functions.text import blank_to_null, collapse, constant_map, let, normalize_city, present, string_array
from .ordered import top_rows

ANYWHERE = "*"
SALTS = 16  # parts that the leads of one place are dealt to


# --- generic filters -------------------------------------------------------------------------
def equality_filter(df: DataFrame, filters: dict[str, object], ignore_unknown: bool = False) -> DataFrame:
    """Rows equal to every given value; ``None`` asks for NULL. Unknown columns are an error by default."""
    unknown = [c for c in filters if c not in df.columns]
    if unknown and not ignore_unknown:
        raise ValueError(f"unknown columns {unknown}")
    tests = [F.col(c).isNull() if v is None else F.col(c) == v for c, v in filters.items() if c in df.columns]
    return df.filter(functools.reduce(operator.and_, tests, F.lit(True)))


def day_range(ts: Column, first: str | None, last: str | None) -> Column:
    """``first`` to ``last`` inclusive, given as ``YYYY-MM-DD``; a malformed date raises."""
    import datetime

    test = F.lit(True)
    if first:
        test = test & (ts >= F.lit(datetime.datetime.strptime(first, "%Y-%m-%d")).cast("timestamp_ntz"))
    if last:
        end = datetime.datetime.strptime(last, "%Y-%m-%d") + datetime.timedelta(days=1)
        test = test & (ts < F.lit(end).cast("timestamp_ntz"))
    return test


def page(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0, most: int = 1000) -> DataFrame:
    """One ordered page; the limit is clamped to 1..``most`` and the offset to 0 or more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def keyword_filter(columns: Sequence[Column], keyword: str) -> Column:
    return functools.reduce(operator.or_, [F.coalesce(c.ilike(f"%{keyword}%"), F.lit(False)) for c in columns])


def exists_flag(df: DataFrame, others: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Boolean column: some row of ``others`` has the same key. The other side is reduced to its
    distinct keys before the join, so repeated keys cost nothing."""
    keys = others.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(keys, list(on), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


# --- categories ------------------------------------------------------------------------------
def _aliases(trade: Column) -> Column:
    known = F.create_map(*[x for name, others in V.TRADE_ALIASES.items() for x in (F.lit(name), string_array(others))])
    return F.coalesce(F.try_element_at(known, trade), string_array([]))


def _meaningful(words: Column) -> Column:
    return F.filter(words, lambda w: (w != "") & ~w.isin(V.GENERIC_WORDS))


def _word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))


def _as_contractor(term: Column) -> Column:
    """``roofing`` to ``roofing contractors`` and ``roofing contractor``."""
    return F.array(F.concat(term, F.lit(" contractors")), F.concat(term, F.lit(" contractor")))


def _tidy(terms: Column) -> Column:
    double = r"\b(contractors?|constructors?)\s+(contractors?|constructors?)\b"
    return F.array_distinct(F.filter(F.transform(
        terms, lambda t: F.trim(F.regexp_replace(collapse(F.lower(t)), double, "$1"))), lambda t: t != ""))


def category_variations(category: Column) -> Column:
    """``struct(contractor, plain)``: terms worded as contractors, and bare trade terms with aliases."""
    items = F.filter(F.transform(F.split(category, "[,;]+"), lambda p: F.trim(p)), lambda p: p != "")

    none = string_array([])

    def read(raw: Column) -> Column:
        """Spelling, words and bare trade of one item."""
        spelled = F.lower(F.regexp_replace(raw, r"(?i)\ba\s*/\s*c\b", "ac"))
        halves = F.when(raw.rlike("&|/| and "), F.transform(
            F.split(spelled, r"&|/|\band\b"), lambda h: F.array_join(_meaningful(_word_list(h)), " "))).otherwise(none)
        return let(_word_list(spelled), lambda words: F.struct(
            collapse(spelled).alias("text"), F.size(words).alias("n"),
            F.exists(words, lambda w: w.isin(V.CONTRACTOR_WORDS)).alias("named"),
            F.array_join(_meaningful(words), " ").alias("base"), halves.alias("halves")))

    def item_terms(item: Column) -> Column:
        trades = F.array_distinct(F.filter(F.concat(F.array(item["base"]), item["halves"]), lambda t: t != ""))
        alias_lists = F.transform(trades, lambda t: F.struct(t.alias("trade"), _aliases(t).alias("aliases")))
        return let(alias_lists, lambda lists: _item_terms(item, lists))

    def _item_terms(item: Column, lists: Column) -> Column:
        def alias_contractors(a: Column) -> Column:
            single = a.endswith("s") & ~a.endswith("ss")
            return F.concat(_as_contractor(a), F.when(
                single, _as_contractor(a.substr(F.lit(1), F.length(a) - 1))).otherwise(none))

        from_trades = F.flatten(F.transform(lists, lambda x: F.concat(
            _as_contractor(x["trade"]), F.flatten(F.transform(x["aliases"], alias_contractors)))))
        alias_plain = F.flatten(F.transform(lists, lambda x: F.concat(F.array(x["trade"]), x["aliases"])))
        base, text = item["base"], item["text"]
        base_pair = F.when(base != "", _as_contractor(base)).otherwise(none)
        worded = F.concat(F.array(text), F.when(base != "", base_pair).otherwise(
            F.array(F.lit("contractors"), F.lit("contractor"))))
        unworded = F.concat(_as_contractor(text), F.when(base != text, base_pair).otherwise(none))
        plain_head = F.when(item["named"], F.array(base)).otherwise(F.array(text, base))
        used = item["n"] > 0
        return F.struct(
            F.when(used, F.concat(F.when(item["named"], worded).otherwise(unworded), from_trades)).otherwise(none).alias("c"),
            F.when(used, F.concat(plain_head, alias_plain)).otherwise(none).alias("p"))

    def finish(both: Column) -> Column:
        contractor = _tidy(F.flatten(F.transform(both, lambda b: b["c"])))
        bare = F.transform(F.flatten(F.transform(both, lambda b: b["p"])),
                           lambda t: F.array_join(_meaningful(F.split(t, " ")), " "))

        def with_roofers(plain: Column) -> Column:
            extra = F.when(F.exists(plain, lambda t: t.contains("roofing")), string_array(["roofer", "roofers"])
                           ).when(F.exists(plain, lambda t: t.contains("roofer")), string_array(["roofing"])).otherwise(none)
            return F.struct(contractor.alias("contractor"), F.array_distinct(F.concat(plain, extra)).alias("plain"))

        return let(_tidy(bare), with_roofers)

    return let(F.transform(F.transform(items, read), item_terms), finish)


def category_terms(category: Column) -> Column:
    parts = category_variations(category)
    return F.array_distinct(F.concat(parts["contractor"], parts["plain"]))


def search_text(record_kind: Column, industry: Column, *fields: Column) -> Column:
    """Evidence for a category. The company name is never part of it."""
    return F.lower(F.concat_ws(" ", *fields, F.when(record_kind == "company", industry)))


def any_term(text: Column, terms: Column) -> Column:
    """Some term is contained in the text; see ``plain_terms`` for what a term may hold."""
    return F.exists(terms, lambda t: F.contains(text, t))


def plain_terms(terms: Column) -> Column:
    """Terms without ``%`` and ``_``, which have no meaning of their own here; empty ones go."""
    return F.filter(F.transform(terms, lambda t: F.translate(t, "%_", "")), lambda t: t != "")


def source_key(code: Column) -> Column:
    """A source code as requests and records are compared by it."""
    return F.regexp_replace(F.lower(F.trim(code)), "[^a-z0-9]", "")


# --- requests --------------------------------------------------------------------------------
def clean_category(c: Column) -> Column:
    text = blank_to_null(collapse(c))
    return F.when(~F.lower(text).isin(V.GENERIC_WORDS), text)


def canonical_criteria(requests: DataFrame, source_aliases: dict[str, str] | None = None) -> DataFrame:
    """Requests in one canonical form, with search terms and a hash of the criteria.

    Optional columns that are absent count as unspecified. ``limit`` stands in for
    ``quantity`` and ``keyword`` for ``category``. A city that only repeats its state is
    dropped, which makes the search statewide. Unknown states and kinds land in ``problems``.
    """
    have = set(requests.columns)

    def field(name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    free_text = "location" in have
    nowhere = F.expr("cast(NULL AS struct<city: string, state: string, postal: string>)")
    staged = requests.withColumns({
        "_location": parse_location(field("location")) if free_text else nowhere,
        "_whole": normalize_state(field("location")) if free_text else F.lit(None).cast("string")})
    use_location = ~present(field("city")) & ~present(field("us_state"))
    staged = staged.withColumns({
        "_raw_state": F.coalesce(blank_to_null(field("us_state")), F.when(
            use_location, F.coalesce("_whole", "_location.state"))),
        "_city": normalize_city(F.coalesce(blank_to_null(field("city")), F.when(
            use_location & F.col("_whole").isNull(), F.col("_location.city"))))})
    staged = staged.withColumns({"_state": normalize_state(F.col("_raw_state")), "_city_state": normalize_state(F.col("_city"))})
    compact = F.replace(F.lower("_city"), F.lit(" "), F.lit(""))
    redundant = F.coalesce(F.col("_state").isNotNull() & ((F.col("_city_state") == F.col("_state")) | (compact == "newyork")),
                           F.lit(False))
    source = source_key(field("source"))
    for short, full in (source_aliases or {}).items():
        source = F.when(source == short, F.lit(full)).otherwise(source)
    source = F.coalesce(blank_to_null(F.regexp_replace(source, "(scrappers?|scrapers?)$", "")), source)
    category = clean_category(F.coalesce(blank_to_null(field("category")), field("keyword")))
    kind = field("record_kind")
    problems = F.array_compact(F.array(
        F.when(F.col("_raw_state").isNotNull() & F.col("_state").isNull(), F.lit("unknown state")),
        F.when(kind.isNotNull() & ~kind.isin("company", "opportunity"), F.lit("unknown record kind"))))
    canonical = {
        "category": category, "us_state": F.col("_state"), "city": F.when(~redundant, F.col("_city")),
        "record_kind": kind, "source": source,
        "quantity": F.coalesce(field("quantity", "int"), field("limit", "int"), F.lit(20)),
        "has_email": F.coalesce(field("has_email", "boolean"), F.lit(False)),
        "has_phone": F.coalesce(field("has_phone", "boolean"), F.lit(False)),
        "fresh_within_days": field("fresh_within_days", "int"),
        "include_expired": F.coalesce(field("include_expired", "boolean"), F.lit(False)),
        "new_only": F.coalesce(field("new_only", "boolean"), F.lit(False)),
        "status": blank_to_null(field("status")), "assigned_to": field("assigned_to", "bigint"),
        "department_id": field("department_id", "bigint"),
        "exclude_lead_ids": F.coalesce(field("exclude_lead_ids", "array<bigint>"), F.array().cast("array<bigint>")),
        "user_id": field("user_id", "bigint"),
    }
    out = staged.select("request_id", *[c.alias(n) for n, c in canonical.items()], problems.alias("problems"))
    hashed = F.sha2(F.to_json(F.struct(*[n for n in sorted(canonical) if n != "user_id"])), 256)
    none = string_array([])
    out = out.withColumns({"criteria_hash": hashed, "_terms": category_variations(F.col("category"))})
    return out.withColumns({"contractor_terms": plain_terms(F.coalesce("_terms.contractor", none)),
                            "plain_terms": plain_terms(F.coalesce("_terms.plain", none))}).drop("_terms")


# --- matching --------------------------------------------------------------------------------
def with_sources(leads: DataFrame, sightings: DataFrame) -> DataFrame:
    """``sources``: the keys of a lead's own source and of every source that has seen it."""
    own = leads.select("lead_id", source_key(F.col("source_code")).alias("key"))
    seen = sightings.select("lead_id", source_key(F.col("source_code")).alias("key")).distinct()
    keys = own.unionByName(seen.join(own.select("lead_id"), "lead_id", "left_semi")).filter("key <> ''")
    return leads.join(keys.groupBy("lead_id").agg(F.sort_array(F.collect_set("key")).alias("sources")), "lead_id", "left")


def with_contact_flags(leads: DataFrame, contacts: DataFrame, organizations: DataFrame) -> DataFrame:
    """``has_email`` and ``has_phone``: from linked contacts or, for companies, from the organisation."""
    company = F.col("record_kind") == "company"
    orgs = organizations.select("org_id", present(F.col("email")).alias("_o_email"), present(F.col("phone")).alias("_o_phone"))
    out = leads.join(orgs, "org_id", "left")
    for name in ("email", "phone"):
        out = exists_flag(out, contacts.filter(present(F.col(name).cast("string"))), ["lead_id"], f"_c_{name}")
        out = out.withColumn(f"has_{name}", F.col(f"_c_{name}") | (company & F.coalesce(f"_o_{name}", F.lit(False))))
    return out.drop("_o_email", "_o_phone", "_c_email", "_c_phone")


def with_places(leads: DataFrame, locations: DataFrame) -> DataFrame:
    """``org_places``: the distinct city and state pairs of a lead's organisation."""
    pairs = F.collect_set(F.struct(F.lower(F.trim("city")).alias("city"), F.upper("state").alias("state")))
    return leads.join(locations.groupBy("org_id").agg(pairs.alias("org_places")), "org_id", "left")


def match_requests(leads: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """All (request, lead) pairs that satisfy the criteria, with ``contractor_first``.

    ``leads`` brings ``lead_id, record_kind, city, us_state, text, due_at, last_seen_at``, the places of
    its organisation in ``org_places`` (or one place in ``org_city, org_state``), and what requests may
    ask for: ``has_email, has_phone, sources, status, assigned_to, department_id``. A flag that is
    absent counts as false, another absent column matches no request that asks for it. Leads meet
    requests by an equi-join on the state they can be found under and a salt, so that the leads of one
    state, or those that stateless requests look at, are dealt to ``SALTS`` parts.
    """
    have = set(leads.columns)

    def lead(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    places = F.col("org_places") if "org_places" in have else F.array(F.struct(
        F.lower(F.trim("org_city")).alias("city"), F.upper("org_state").alias("state")))
    asked_of = {"has_email": "boolean", "has_phone": "boolean", "sources": "array<string>", "status": "string", "assigned_to": "bigint", "department_id": "bigint"}
    incomplete = (F.col("record_kind") == "company") & (F.col("city").isNull() | F.col("us_state").isNull())
    related = F.when(incomplete, F.transform("_places", lambda p: p["state"])).otherwise(string_array([]))
    keys = F.array_distinct(F.array_compact(F.concat(F.array(F.lit(ANYWHERE), F.upper("us_state")), F.coalesce(related, string_array([])))))
    candidates = leads.withColumns({f"_lead_{n}": lead(n, k) for n, k in asked_of.items()} | {"_places": places}).drop("org_places", *(set(asked_of) & have - {"status"}))
    salt = F.pmod(F.xxhash64("lead_id"), F.lit(SALTS)).cast("int")
    candidates = candidates.withColumn("_salt", salt).withColumn("_place", F.explode(keys))
    criteria = {"_kind": "record_kind", "_email": "has_email", "_phone": "has_phone", "_fresh": "fresh_within_days", "_expired": "include_expired", "_source": "source",
                "_status": "status", "_assigned": "assigned_to", "_department": "department_id", "_excluded": "exclude_lead_ids",
                "_contractor": "contractor_terms", "_plain": "plain_terms", "_state": "us_state"}
    asked = requests.filter(F.size("problems") == 0).select(
        "request_id", "quantity", "user_id", "new_only", F.coalesce("us_state", F.lit(ANYWHERE)).alias("_place"), F.lower("city").alias("_city"),
        *[F.col(c).alias(n) for n, c in criteria.items()], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))

    def located(city: Column, state: Column) -> Column:
        return ((F.col("_city").isNull() | F.coalesce(F.lower(F.trim(city)) == F.col("_city"), F.lit(False)))
                & (F.col("_state").isNull() | F.coalesce(F.upper(state) == F.col("_state"), F.lit(False))))

    def equal(wanted: str, found: str) -> Column:
        return F.col(wanted).isNull() | F.coalesce(F.col(wanted) == F.col(found), F.lit(False))

    missing = ((F.col("_city").isNotNull() & F.col("city").isNull())
               | (F.col("_state").isNotNull() & F.col("us_state").isNull()))
    by_org = (F.col("record_kind") == "company") & missing & F.coalesce(F.exists("_places", lambda p: located(p["city"], p["state"])), F.lit(False))
    no_terms = (F.size("_contractor") == 0) & (F.size("_plain") == 0)
    unexpired = (F.col("_expired") | (F.col("record_kind") != "opportunity") | F.col("due_at").isNull()
                 | (F.col("due_at") >= as_of))
    fresh = F.col("_fresh").isNull() | F.coalesce(
        F.col("last_seen_at") >= as_of - F.make_dt_interval(F.col("_fresh")), F.lit(False))
    flag = {n: F.coalesce(F.col(f"_lead_{n}"), F.lit(False)) for n in ("has_email", "has_phone")}
    matched = (
        candidates.join(asked, ["_place", "_salt"])
        .filter(F.col("_kind").isNull() | (F.col("record_kind") == F.col("_kind")))
        .filter(located(F.col("city"), F.col("us_state")) | by_org)
        .filter(unexpired & fresh)
        .filter((~F.col("_email") | flag["has_email"]) & (~F.col("_phone") | flag["has_phone"]))
        .filter(F.col("_source").isNull() | F.coalesce(F.array_contains("_lead_sources", F.col("_source")), F.lit(False)))
        .filter(equal("_status", "_lead_status") & equal("_assigned", "_lead_assigned_to") & equal("_department", "_lead_department_id"))
        .filter(~F.array_contains("_excluded", F.col("lead_id")))
        .withColumn("contractor_first", any_term(F.col("text"), F.col("_contractor")))
        .filter(no_terms | F.col("contractor_first") | any_term(F.col("text"), F.col("_plain")))
    )
    return matched.drop("_place", "_salt", "_city", "_places", *criteria, *[f"_lead_{n}" for n in asked_of])


def rank_matches(matches: DataFrame) -> DataFrame:
    """At most ``quantity`` leads per request: contractor wording first, newest first, then id.

    The matches of one request are cut to its quantity in salted parts before they meet in one.
    """
    order = [F.when(F.col("contractor_first"), 1).otherwise(2), F.col("created_at").desc(), F.col("lead_id")]
    parts = matches.withColumn("_part", F.pmod(F.xxhash64("lead_id"), F.lit(SALTS)))
    first = top_rows(parts, ["request_id", "_part"], order, F.col("quantity")).drop("rank", "_part")
    return top_rows(first, ["request_id"], order, F.col("quantity"))


def exclude_delivered(matches: DataFrame, deliveries: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """For requests that want new leads only, drop pairs whose lead this user already got at the same version.

    Requests without ``new_only`` or without a user keep all of their pairs. With the ``requests`` behind the
    matches only the deliveries of users who want new leads are dealt.
    """
    if requests is not None:
        users = requests.filter(F.coalesce(F.col("new_only"), F.lit(False))).select("user_id").distinct()
        deliveries = deliveries.join(users, "user_id", "left_semi")
    seen = deliveries.filter(F.col("served_at").isNotNull()).select(
        F.col("user_id").alias("_user"), F.col("lead_id").alias("_seen"), F.col("record_version").alias("_version")).distinct()
    wants_new = F.coalesce(F.col("new_only"), F.lit(False)) & F.col("user_id").isNotNull()
    fresh = matches.filter(wants_new).join(
        seen, (F.col("user_id") == F.col("_user")) & (F.col("lead_id") == F.col("_seen")) & (F.col("content_version") == F.col("_version")), "left_anti")
    return matches.filter(~wants_new).unionByName(fresh)


# --- lead view -------------------------------------------------------------------------------
def primary_children(children: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One child row per parent: the first in ``order``, by aggregation instead of a window."""
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("_c")
    return children.groupBy(key).agg(best).select(key, *[F.col("_c")[c].alias(c) for c in columns])


def lead_view(leads: DataFrame) -> DataFrame:
    """Displayed contact, place and due date of leads joined with organisation and contact columns.

    Expects ``org_email, org_phone, org_city, org_state, org_location`` and ``contact_email,
    contact_phone``; metadata columns ``meta_email, meta_phone, meta_city, meta_state,
    meta_location`` win where present.
    """
    have = set(leads.columns)

    def field(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    company = F.col("record_kind") == "company"
    email = F.coalesce(blank_to_null(field("meta_email")), field("contact_email"), F.when(company, field("org_email")))
    phone = F.coalesce(blank_to_null(field("meta_phone")), field("contact_phone"), F.when(company, field("org_phone")))
    city = F.coalesce(blank_to_null(field("city")), F.when(company, field("org_city")), field("meta_city"))
    state = F.coalesce(blank_to_null(field("us_state")), F.when(company, field("org_state")), field("meta_state"))
    raw = F.coalesce(F.when(company, field("org_location")), field("meta_location"))
    return leads.withColumns({
        "view_email": email, "view_phone": phone, "view_city": city, "view_state": state,
        "view_location": F.when(city.isNotNull() & state.isNotNull(), F.concat_ws(", ", city, state))
        .otherwise(F.coalesce(raw, city, state)),
    })


def missing_requirements(slots: dict[str, Column]) -> Column:
    """What a request still leaves open; an explicit "any" or "no" counts as answered."""
    def blank(name: str) -> Column:
        return ~present(slots[name].cast("string"))

    scope = F.coalesce(slots["location_scope"], F.lit(""))
    return F.array_compact(F.array(
        F.when(blank("record_kind"), F.lit("record type")),
        F.when(blank("category") & ~F.coalesce(slots["category_specified"], F.lit(False)), F.lit("category")),
        F.when((scope == "statewide") & blank("us_state"), F.lit("state"))
        .when((scope != "any") & (scope != "statewide") & blank("us_state"), F.lit("location")),
        F.when(F.coalesce(slots["quantity"], F.lit(0)) == 0, F.lit("quantity")),
        F.when(slots["has_email"].isNull() | slots["has_phone"].isNull(), F.lit("contact requirements")),
        F.when(F.coalesce(slots["needs_record_choice"], F.lit(False)), F.lit("record choice")),
        F.when(F.coalesce(slots["source_needs_city"], F.lit(False)) & blank("city"), F.lit("city")),
    ))
