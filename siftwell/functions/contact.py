"""Domains, phones and email addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import blank_to_null, clean_glyphs, let, string_array

DIRECTORY_PHONE = V.DIRECTORY_PHONE_PATTERN + V.PHONE_EXTENSION_PATTERN
LONE_PHONE = r"(?:^|[^0-9])(" + V.DIRECTORY_PHONE_PATTERN.replace(r"\s", r" \t\n\f\r").replace("([", "(?:[").replace(r"(\d", r"(?:\d") + r")(?:[^0-9]|\z)"
GUARDED_PHONE = r"(?i)(?<!\d)" + V.DIRECTORY_PHONE_PATTERN + r"(?!\d)" + V.PHONE_EXTENSION_PATTERN


def normalize_domain(c: Column) -> Column:
    """Host of a URL or bare address: lower case, no ``www.``, at least one dot, else NULL."""
    url = F.trim(c)
    url = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host.contains("."), host)


def normalize_phone(c: Column) -> Column:
    """E.164 form, or NULL when the text as a whole is not a dialable number.

    Numbers without a country code are read as North American. Foreign numbers need their
    ``+`` prefix and are checked for length only.
    """
    text = F.trim(c)
    shape = (r"^(?:\+?1[\s.\-]*)?\(?([2-9]\d{2})\)?[\s.\-]*([2-9]\d{2})[\s.\-]*(\d{4})"
             r"(?:\s*(?i:ext\.?|x|#)\s*\d{1,6})?$")
    digits = F.regexp_replace(text, r"\D", "")
    foreign = text.rlike(r"^\+[02-9][\d\s().\-]*$") & F.length(digits).between(8, 15)
    return F.when(
        text.rlike(shape),
        F.concat(F.lit("+1"), F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2),
                 F.regexp_extract(text, shape, 3)),
    ).when(foreign, F.concat(F.lit("+"), digits))


def normalize_email(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.rlike(r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"), text)


def directory_phone(c: Column) -> Column:
    """First plausible number as ``struct(e164, pretty, ext)``; blocked numbers give NULL."""
    def parts(m: Column) -> Column:
        number = F.regexp_extract(m, "^[^A-Za-z]*", 0)
        return F.struct(F.right(F.regexp_replace(number, r"\D", ""), F.lit(10)).alias("d"),
                        F.regexp_extract(m, r"(?i)(?:ext\.?|x|extension)\s*(\d{1,6})$", 1).alias("x"))

    def build(n: Column) -> Column:
        d = n["d"]
        return F.when(~d.isin(V.BLOCKED_PHONES), F.struct(
            F.concat(F.lit("+1"), d).alias("e164"),
            F.concat(F.lit("("), d.substr(1, 3), F.lit(") "), d.substr(4, 3), F.lit("-"), d.substr(7, 4)).alias("pretty"),
            n["x"].alias("ext")))

    return let(F.regexp_extract(c, GUARDED_PHONE, 0), lambda m: F.when(m != "", let(parts(m), build)))


def display_phone(phone: Column) -> Column:
    return F.when(phone["ext"] != "", F.concat(phone["pretty"], F.lit(" ext. "), phone["ext"])).otherwise(phone["pretty"])


def phones_in_text(c: Column) -> Column:
    """All plausible numbers of a text as E.164 (with ``x`` and extension), in order, once each."""
    found = F.regexp_extract_all(c, F.lit(GUARDED_PHONE), F.lit(0))
    parsed = F.filter(F.transform(found, directory_phone), lambda p: p.isNotNull())
    return F.array_distinct(F.transform(
        parsed, lambda p: F.when(p["ext"] != "", F.concat(p["e164"], F.lit("x"), p["ext"])).otherwise(p["e164"])))


def lone_phones_in_text(c: Column) -> Column:
    """All numbers of a text as E.164, once each, none blocked and without extension.

    A number needs a character of its own (or an end of the text) before and behind it: of two numbers
    with one character between them only the first is read.
    """
    found = F.regexp_extract_all(c, F.lit(LONE_PHONE), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: F.concat(F.lit("+1"), F.right(F.regexp_replace(m, r"\D", ""), F.lit(10)))))


def labelled_phones(c: Column) -> Column:
    """Numbers that follow an explicit label such as ``phone:`` or ``office``."""
    shape = rf"(?i)\b(?:{V.PHONE_LABELS})\s*[:.\-]?\s*({V.DIRECTORY_PHONE_PATTERN}(?:\s*(?:ext\.?|x)\s*\d{{1,6}})?)"
    return phones_in_text(F.array_join(F.regexp_extract_all(c, F.lit(shape), F.lit(1)), " ; "))


def is_fax(*fragments: Column) -> Column:
    return F.lower(F.concat_ws(" ", *fragments)).contains("fax")


def loose_phone(c: Column) -> Column:
    """Labels and foreign characters stripped, first run that looks like a number."""
    text = F.regexp_replace(clean_glyphs(c), r"(?i)(call|phone|tel|telephone|contact)[\s:]*", "")
    text = F.trim(F.regexp_replace(text, r"[^\d\-()+\s]", ""))
    run = F.trim(F.regexp_extract(text, r"(\+?[(\d][\d\s\-()]{8,}\d)", 1))
    return blank_to_null(F.when(run != "", run).otherwise(text))


def loose_email(c: Column) -> Column:
    text = clean_glyphs(c)
    return F.when(text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), text)


def clean_email(c: Column, denied_domains: list[str] | None = None) -> Column:
    """Address found in a text fragment, or NULL when it belongs to a denied domain, prefix or file name."""
    domains = V.DENIED_EMAIL_DOMAINS if denied_domains is None else denied_domains
    file_like = "|".join(e.replace(".", r"\.") for e in V.IGNORED_EMAIL_EXTENSIONS)
    good = rf"^(?!(?:{'|'.join(V.DENIED_EMAIL_PREFIXES)})(?:[-_.@])).*@.*\.[a-z]{{2,}}$"

    def check(email: Column) -> Column:
        usable = email.rlike(good) & ~email.rlike(rf"(?:{file_like})$")
        if domains:
            usable = usable & ~email.rlike("[@.](?:" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")
        return F.when(usable, email)

    return let(F.lower(F.regexp_extract(c, V.EMAIL_PATTERN, 0)), check)


def emails_in_text(c: Column, denied_domains: list[str] | None = None) -> Column:
    found = F.regexp_extract_all(c, F.lit(V.EMAIL_PATTERN), F.lit(0))
    clean = F.array_distinct(F.filter(F.transform(found, lambda e: clean_email(e, denied_domains)), lambda e: e.isNotNull()))
    return F.when(c.contains("@"), clean).otherwise(F.when(c.isNotNull(), string_array([])))


def open_up_email_text(c: Column) -> Column:
    """Undo entity, percent and ``[at]`` / ``(dot)`` spellings of addresses."""
    text = F.regexp_replace(c, r"(?i)&#0*64;|&#x0*40;|\\u0040|%40|&commat;", "@")
    text = F.regexp_replace(text, r"(?i)&#0*46;|&#x0*2e;|\\u002e|%2e|&period;", ".")
    text = F.regexp_replace(text, r"(?i)\s*(?:\[at\]|\(at\))\s*", "@")
    return F.regexp_replace(text, r"(?i)\s*(?:\[dot\]|\(dot\))\s*", ".")


def decode_xor_email(hex_text: Column) -> Column:
    """Address obfuscated as hexadecimal bytes XOR-ed with the first byte."""
    def byte(low: Column, position: Column) -> Column:
        return F.conv(F.substr(low, position, F.lit(2)), 16, 10).cast("int")

    def decode(low: Column) -> Column:
        def letters(mask: Column) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(3), F.length(low) - 1, F.lit(2)),
                                            lambda p: F.char(byte(low, p).bitwiseXOR(mask).cast("bigint"))), "")

        return F.when(low.rlike(r"^(?:[0-9a-f]{2}){2,}$"), clean_email(let(byte(low, F.lit(1)), letters)))

    return let(F.lower(hex_text), decode)
