"""Raw records to the canonical record, ingest fields, validation and quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.contact import normalize_domain, normalize_email, normalize_phone
from ..functions.keys import fingerprint, lead_identity, org_key
from ..functions.place import normalize_state, parse_location
from ..functions.text import blank_to_null, cut, normalize_key, present, string_array
from ..functions.times import parse_due_date
from ..schemas import CANONICAL_FIELDS, FIELD_ALTERNATIVES, FIELD_LENGTHS


def _first_present(raw: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*[blank_to_null(F.try_element_at(raw, F.lit(n))) for n in names])


def project_with_map(records: DataFrame, field_map: Column | str = "field_map") -> DataFrame:
    """Canonical record from ``raw MAP`` with the source's own field map.

    Mapped keys come first, then the usual names of source and kind, then equally named raw
    fields. What no canonical field used is kept in ``extra``.
    """
    raw = F.col("raw")
    fmap = F.col(field_map) if isinstance(field_map, str) else field_map
    fmap = F.coalesce(fmap, F.expr("cast(map() as map<string, string>)"))
    columns, used = {}, []
    for name in CANONICAL_FIELDS:
        key = F.try_element_at(fmap, F.lit(name))
        mapped = F.try_element_at(raw, key)
        used.append(F.when(F.map_contains_key(raw, key), key))
        fallback = F.try_element_at(raw, F.lit(name))
        if name in ("source_code", "record_kind"):
            names = ["source_code", "scrapper_code", "scraper_code"] if name == "source_code" else ["record_kind", "record_type"]
            value = F.coalesce(blank_to_null(mapped), _first_present(raw, names))
            chosen = F.coalesce(*[F.when(blank_to_null(F.try_element_at(raw, F.lit(n))).isNotNull(), F.lit(n)) for n in names])
            used.append(F.when(blank_to_null(mapped).isNull(), chosen))
            default = "unknown" if name == "source_code" else "company"
            value = F.coalesce(value, F.lit(default))
            columns[name] = F.lower(F.trim(value)) if name == "source_code" else value
        else:
            columns[name] = F.coalesce(mapped, fallback)
            used.append(F.when(mapped.isNull() & F.map_contains_key(raw, F.lit(name)), F.lit(name)))
    columns["due_at"] = blank_to_null(columns["due_at"])
    staged = records.withColumn("_used", F.array_compact(F.array(*used)))
    left = F.map_filter(raw, lambda k, v: ~F.array_contains(F.col("_used"), k) & (k != "extra"))
    own = F.from_json(F.try_element_at(raw, F.lit("extra")), "map<string,string>")
    own = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(left, k))
    extra = F.map_concat(own, left)  # the record's own metadata under what no field used
    return staged.withColumns({**columns, "extra": extra}).drop("_used", "raw", *([field_map] if isinstance(field_map, str) else []))


def attach_field_maps(records: DataFrame, maps: DataFrame) -> DataFrame:
    """The stored field map of every record's source, NULL where none is stored."""
    return records.join(maps.select("source_code", "field_map"), "source_code", "left")


# Sources as data: candidate raw keys per canonical field, constants, and where an id hides in the URL.
SOURCE_LAYOUTS: dict[str, dict[str, object]] = {
    "municipal": {
        "record_kind": "opportunity", "id_from_url": r"/opportunities/(\d+)",
        "fields": {"external_id": ["ref_number", "source_id", "external_id"], "source_url": ["url", "source_url"],
                   "title": ["title"], "description": ["description"],
                   "organization_name": ["organization_name", "issuing_organization"],
                   "contact_name": ["contact_person", "contact_name"], "contact_title": ["contact_title"],
                   "email": ["contact_email", "email"], "phone": ["contact_phone", "phone"], "website": ["website"],
                   "city": ["city"], "us_state": ["us_state"], "postal_code": ["postal_code"],
                   "category": ["category"], "due_at": ["due_at", "close_date", "due_date", "due_date_raw"]},
        "defaults": {"organization_name": "City of Dallas", "city": "Dallas", "us_state": "TX"},
        "extra": ["ref_number", "status", "close_date"],
    },
    "authority": {
        "record_kind": "opportunity",
        "fields": {"external_id": ["solicitation_number", "source_url"], "source_url": ["source_url"],
                   "title": ["title"], "description": ["description"],
                   "organization_name": ["issuing_organization"], "contact_name": ["contact_name"],
                   "contact_title": ["contact_title"], "email": ["contact_email"], "phone": ["contact_phone"],
                   "city": ["location_city"], "us_state": ["location_state"], "postal_code": ["location_zip"],
                   "category": ["Type"], "due_at": ["due_date_raw"]},
        "defaults": {"us_state": "NY"}, "extra": ["location_raw", "Goals"],
    },
    "reporter": {
        "record_kind": "opportunity",
        "fields": {"external_id": ["cr_number", "opp_id", "id", "source_id", "url"], "source_url": ["url", "source_url"],
                   "title": ["title"], "description": ["description"],
                   "organization_name": ["issuing_organization"], "contact_name": ["contact_name"],
                   "contact_title": ["contact_title"], "email": ["contact_email"], "phone": ["contact_phone"],
                   "city": ["location_city"], "us_state": ["location_state"], "category": ["categories"],
                   "due_at": ["bid_deadline"]},
        "defaults": {"us_state": "NY"}, "extra": ["issue_date", "project_type"],
    },
    "directory": {
        "record_kind": "company",
        "fields": {"external_id": ["external_id", "profile_url"], "source_url": ["source_url", "profile_url"],
                   "title": ["company_name"], "organization_name": ["company_name"], "email": ["email"],
                   "phone": ["phone"], "city": ["city"], "us_state": ["state"], "category": ["category"]},
        "defaults": {}, "extra": ["lead_priority", "location_line"],
    },
    "ratings": {
        "record_kind": "company",
        "fields": {"external_id": ["id"], "source_url": ["reportUrl"], "title": ["businessName"],
                   "organization_name": ["businessName"], "phone": ["phone"], "city": ["city"],
                   "us_state": ["state"], "postal_code": ["postalcode"], "category": ["tobText"]},
        "defaults": {}, "extra": ["rating", "ratingScore", "bbbMember", "address"],
    },
    "social": {
        "record_kind": "company",
        "fields": {"external_id": ["id"], "source_url": ["profile_url"], "title": ["company_name"],
                   "organization_name": ["company_name"], "email": ["email"], "phone": ["phone"],
                   "website": ["website"], "city": ["city"], "us_state": ["state"], "postal_code": ["zip"],
                   "category": ["professional_category"]},
        "defaults": {}, "extra": ["rating", "followers", "likes"],
    },
    "profile": {
        "record_kind": "company",
        "fields": {"external_id": ["id"], "source_url": ["profile_url"], "title": ["company_name"],
                   "organization_name": ["company_name"], "phone": ["phone"], "website": ["website"],
                   "city": ["city"], "us_state": ["state"], "postal_code": ["zip"], "category": ["professional_category"]},
        "defaults": {}, "extra": ["typical_job_cost", "license_number", "socials"],
    },
}


def project_source(records: DataFrame, layouts: Mapping[str, Mapping[str, object]] = SOURCE_LAYOUTS) -> DataFrame:
    """Canonical record of rows ``(ordinal, source_code, raw MAP)`` of several sources in one pass."""
    raw = F.col("raw")

    def pick(name: str) -> Column:
        value = None
        for source, layout in layouts.items():
            fields = layout["fields"].get(name)
            v = _first_present(raw, fields) if fields else F.lit(None).cast("string")
            if name == "external_id" and layout.get("id_from_url"):
                url = _first_present(raw, layout["fields"]["source_url"])
                v = F.coalesce(v, blank_to_null(F.regexp_extract(url, layout["id_from_url"], 1)))
            if name in layout["defaults"]:
                v = F.coalesce(v, F.lit(layout["defaults"][name]))
            if name == "record_kind":
                v = F.lit(layout["record_kind"])
            if name == "us_state":
                v = F.coalesce(normalize_state(v), v)
            test = F.col("source_code") == source
            value = F.when(test, v) if value is None else value.when(test, v)
        return value

    def kept_extra(names: Sequence[str]) -> Column:
        return F.map_filter(raw, lambda k, v: k.isin(list(names)) & present(v))

    extra = None
    for source, layout in layouts.items():
        kept = kept_extra(layout["extra"])
        test = F.col("source_code") == source
        extra = F.when(test, kept) if extra is None else extra.when(test, kept)
    fields = {n: pick(n) for n in CANONICAL_FIELDS if n != "source_code"}
    return records.withColumns({**fields, "extra": extra}).drop("raw")


def reindex(df: DataFrame, columns: Sequence[str], constants: Mapping[str, str]) -> DataFrame:
    """Exactly ``columns``, missing ones NULL, constants filled in where the value is missing."""
    def column(name: str) -> Column:
        own = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        return (F.coalesce(own, F.lit(constants[name])) if name in constants else own).alias(name)

    return df.select(*[column(c) for c in columns])


def ingest_fields(records: DataFrame) -> DataFrame:
    """Trimmed, truncated and normalised ingest columns with identity, fingerprint and organisation key.

    ``records`` has one column per delivered field name. The location text is parsed only for
    rows that lack city, state or postal code.
    """
    have = set(records.columns)

    def field(name: str, whole: bool = False) -> Column:
        names = [n for n in FIELD_ALTERNATIVES.get(name, [name]) if n in have]
        if not names:
            return F.lit(None).cast("string")
        value = F.coalesce(*[blank_to_null(F.col(n).cast("string")) for n in names])
        return blank_to_null(cut(value, FIELD_LENGTHS[name])) if name in FIELD_LENGTHS and not whole else blank_to_null(F.trim(value))

    names = list(dict.fromkeys([*FIELD_LENGTHS, "record_kind", "description"]))
    passthrough = [c for c in ("ordinal", "run_id", "department_id", "dataset_id") if c in have]
    out = records.select(
        *passthrough, *[field(n).alias(n) for n in names], field("external_id", whole=True).alias("_whole_id"),
        (F.col("extra") if "extra" in have else F.expr("cast(map() as map<string, string>)")).alias("extra"),
        parse_due_date(field("due_at")).alias("due_at"))
    out = out.withColumns({
        "source_code": F.lower("source_code"), "email_type": F.coalesce("email_type", F.lit("work")),
        "phone_type": F.coalesce("phone_type", F.lit("office")), "country": F.coalesce("country", F.lit("USA"))})
    if {"location", "raw_location"} & have:
        incomplete = F.col("city").isNull() | F.col("us_state").isNull() | F.col("postal_code").isNull()
        out = out.withColumn("_place", F.when(incomplete & F.col("location").isNotNull(), parse_location(F.col("location"))))
        out = out.withColumns({"city": F.coalesce("city", "_place.city"), "us_state": F.coalesce("us_state", "_place.state"),
                               "postal_code": F.coalesce("postal_code", "_place.postal")}).drop("_place")
    out = out.withColumns({
        "norm_email": normalize_email(F.col("email")), "norm_phone": normalize_phone(F.col("phone")),
        "norm_state": normalize_state(F.col("us_state")), "norm_domain": normalize_domain(F.col("website"))})
    finger = fingerprint(F.col("organization_name"), F.col("website"), F.col("phone"), F.col("email"))
    out = out.withColumn("fingerprint", finger)
    return out.withColumns({
        "identity_key": lead_identity(F.col("record_kind"), F.col("source_code"), F.col("_whole_id"), F.col("fingerprint")),
        "org_dedup": org_key(F.col("organization_name"), F.col("website"), F.col("phone"), F.col("city"), F.col("us_state"))})


def wide_record_errors(source_code: str) -> Column:
    """Violations of a wide directory row, as an array of messages."""
    def text(name: str) -> Column:
        return F.col(name).cast("string")

    rules = [
        (present(text("company_name")), F.lit("company_name is required")),
        (F.coalesce(text("record_kind"), F.lit("company")) == "company", F.concat(F.lit("Invalid record_kind: "), text("record_kind"))),
        (F.coalesce(text("source_code"), F.lit(source_code)) == source_code, F.concat(F.lit("Invalid source_code: "), text("source_code"))),
        (~present(text("rating")) | text("rating").rlike(r"^\d+(\.\d+)?$"), F.concat(F.lit("Invalid rating: "), text("rating"))),
        (~present(text("reviews_count")) | text("reviews_count").rlike(r"^\d+$"),
         F.concat(F.lit("Invalid reviews_count: "), text("reviews_count"))),
        (~present(text("email")) | text("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.concat(F.lit("Invalid email: "), text("email"))),
        (~present(text("scraped_at")) | text("scraped_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"),
         F.concat(F.lit("Invalid scraped_at format: "), text("scraped_at"))),
    ]
    return F.array_compact(F.array(*[F.when(~ok, message) for ok, message in rules]))


def schema_errors(columns: Sequence[str]) -> list[str]:
    """Missing and unexpected columns against the wide layout; checked once per table, not per row."""
    missing = [f"Missing key: {c}" for c in V.WIDE_COLUMNS if c not in columns]
    return missing + [f"Unexpected key: {c}" for c in columns if c not in V.WIDE_COLUMNS]


def valid_company_name(name: Column, slogans: Sequence[str] = ()) -> Column:
    """Not blank, not a slogan, not a label of the page it was read from."""
    key = normalize_key(name)
    bad = key.isin(V.UI_TEXTS + [s.lower() for s in slogans]) | F.exists(string_array(V.FORBIDDEN_NAME_PARTS), lambda p: F.contains(key, p))
    return F.coalesce((key != "") & ~bad, F.lit(False))


def split_valid(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their ``errors``)."""
    checked = df.withColumn("errors", errors)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def page_state(text: Column, status: Column | None = None) -> Column:
    """``challenge`` before ``blocked`` before ``not_found``; NULL for a usable page."""
    low = F.lower(text)
    challenge = low.rlike("|".join(V.CHALLENGE_PHRASES))
    blocked = low.rlike("|".join(V.BLOCK_PHRASES))
    if status is not None:
        blocked = blocked | (status == 403)
    missing = F.contains(low, F.lit("file not found")) | low.contains("profile does not exist")
    return F.when(challenge, F.lit("challenge")).when(blocked, F.lit("blocked")).when(missing, F.lit("not_found"))
