"""Record layouts."""

from __future__ import annotations

from .functions.fixed_values import WIDE_COLUMNS

# The canonical record: seventeen scalar fields and an open ``extra`` map.
CANONICAL_FIELDS = ["source_code", "record_kind", "external_id", "source_url", "title", "description",
                    "organization_name", "contact_name", "contact_title", "email", "phone", "website", "city",
                    "us_state", "postal_code", "category", "due_at"]
CANONICAL_SCHEMA = ", ".join(f"{f} STRING" for f in CANONICAL_FIELDS) + ", extra MAP<STRING, STRING>"
RAW_SCHEMA = "ordinal BIGINT, source_code STRING, raw MAP<STRING, STRING>"
WIDE_SCHEMA = ", ".join(f"`{c}` STRING" for c in WIDE_COLUMNS)

# Greatest length kept per ingest field.
FIELD_LENGTHS = {"source_code": 50, "external_id": 255, "source_url": 1000, "title": 500, "organization_name": 255,
                 "contact_name": 255, "contact_title": 255, "email": 255, "phone": 100, "website": 500, "city": 100,
                 "us_state": 50, "postal_code": 20, "category": 255, "email_type": 50, "phone_type": 50,
                 "country": 50, "location": 255}

# Alternative names under which sources deliver a field, first non-empty one wins.
FIELD_ALTERNATIVES = {
    "record_kind": ["record_kind", "kind"], "description": ["description", "notes"],
    "organization_name": ["organization_name", "company_name", "agency", "buyer"],
    "us_state": ["us_state", "state"], "postal_code": ["postal_code", "postal"],
    "category": ["category", "industry"], "due_at": ["due_at", "due_date", "close_date"],
    "location": ["location", "raw_location"],
}
