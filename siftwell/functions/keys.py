"""Deterministic identities and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contact import normalize_domain, normalize_email, normalize_phone
from .place import normalize_state
from .text import blank_to_null, let, normalize_name, slug


def _or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def org_key(name: Column, domain: Column, phone: Column, city: Column, state: Column) -> Column:
    """SHA-256 over the normalised parts of an organisation; NULL without a usable name."""
    state_part = F.coalesce(normalize_state(state), F.upper(F.trim(state)))
    return let(normalize_name(name, unicode_fold=True), lambda norm: F.when(norm.isNotNull(), F.sha2(F.concat_ws(
        "|", norm, _or_blank(normalize_domain(domain)), _or_blank(normalize_phone(phone)), _or_blank(F.lower(F.trim(city))), _or_blank(state_part)), 256)))


def fingerprint(name: Column, domain: Column, phone: Column, email: Column) -> Column:
    """SHA-256 over normalised name, domain, phone and email; NULL when all four are blank."""
    parts = F.array(normalize_name(name, unicode_fold=True), normalize_domain(domain), normalize_phone(phone), normalize_email(email))
    return let(parts, lambda p: F.when(F.size(F.array_compact(p)) > 0, F.sha2(F.array_join(F.transform(p, _or_blank), "|"), 256)))


def lead_identity(kind: Column, source_code: Column, external_id: Column, finger: Column) -> Column:
    """``src:<source>:<id>`` for opportunities, ``fp:<fingerprint>`` for companies.

    An unknown kind takes whichever identity is available, source first.
    """
    k = F.lower(F.trim(kind))
    src = F.lower(F.trim(source_code))
    ext = F.trim(external_id.cast("string"))
    ext = F.when(F.startswith(F.lower(ext), F.concat(src, F.lit("_"))), ext.substr(F.length(src) + 2, F.length(ext))
                 ).otherwise(ext)
    by_source = F.when((src != "") & (ext != ""), F.concat(F.lit("src:"), src, F.lit(":"), ext))
    by_print = F.when(F.trim(finger) != "", F.concat(F.lit("fp:"), F.trim(finger)))
    return (
        F.when(k.isin("opportunity", "bid", "rfp"), by_source)
        .when(k.isin("company", "contractor", "business"), by_print)
        .otherwise(F.coalesce(by_source, by_print))
    )


def stable_id(name: Column, phone: Column, address: Column) -> Column:
    """Slug of the name plus six hex digits of phone and address."""
    seed = F.concat(_or_blank(phone), _or_blank(address))
    suffix = F.substring(F.md5(seed), 1, 6)
    return F.when(blank_to_null(name).isNotNull(),
                  F.when(seed != "", F.concat_ws("-", slug(name), suffix)).otherwise(slug(name)))


def fields_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON text of the given fields in name order; NULL fields are left out."""
    struct = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(struct), 256)


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
