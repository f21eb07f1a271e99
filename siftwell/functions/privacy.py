"""Masking of personal data and secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import let, replace_each


def mask_email(email: Column) -> Column:
    local, domain = F.regexp_extract(email, "^(.*)@", 1), F.substring_index(email, "@", -1)
    return F.concat(F.when(F.length(local) <= 1, F.lit("*")).otherwise(F.concat(local.substr(1, 1), F.lit("***"))),
                    F.lit("@"), domain)


def mask_phone(phone: Column) -> Column:
    """First two and last four characters stay, the digits between become stars."""
    digits = F.regexp_replace(phone, r"[^\d+]", "")
    n = F.length(digits)
    masked = F.concat(digits.substr(1, 2), F.repeat(F.lit("*"), F.greatest(n - 6, F.lit(0))), F.right(digits, F.lit(4)))
    return F.when(n < 7, phone).otherwise(masked)


def mask_text(c: Column) -> Column:
    """Emails, then phone numbers. An opening ``+`` or ``(`` before a number stays outside the mask.

    Texts without ``@`` or without a run of digits skip the costly patterns.
    """
    no_mail = F.when(c.contains("@"), replace_each(c, V.PII_EMAIL_PATTERN, mask_email)).otherwise(c)
    return let(no_mail, lambda t: F.when(t.rlike(r"[0-9]{3}[-.\s]?[0-9]{4}"), replace_each(t, V.PII_PHONE_PATTERN, mask_phone)).otherwise(t))


def hide_url_password(c: Column) -> Column:
    return F.regexp_replace(c, r"(postgresql(?:\+psycopg)?://[^:\s]+:)[^@\s]+@", "$1[redacted]@")


def mask_payload(payload: Column) -> Column:
    """Map of text values: secret-looking keys are redacted, other values masked."""
    return F.transform_values(payload, lambda k, v: F.when(k.rlike(V.SECRET_KEY_PATTERN), F.lit("[redacted]"))
                              .otherwise(mask_text(hide_url_password(v))))
