"""Names, keywords, slugs and other text normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, which keeps deep expressions small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def present(c: Column) -> Column:
    """True when a text value is neither NULL nor blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def collapse(c: Column) -> Column:
    """Runs of whitespace become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def cut(c: Column, length: int) -> Column:
    return F.substring(F.trim(c), 1, length)


def _quoted(value) -> str:
    if not isinstance(value, str):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values) -> Column:
    """Array of constants, built as one SQL expression."""
    return F.expr("array(" + ", ".join(_quoted(v) for v in values) + ")") if values else F.expr("cast(array() as array<string>)")


def constant_map(pairs: dict) -> Column:
    """Map of constants, built as one SQL expression; the optimizer folds it into a literal."""
    return F.expr("map(" + ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in pairs.items()) + ")")


def replace_each(c: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``change(match)`` in one left-to-right pass.

    The text is split at the matches and put together again, so a replacement may depend on
    its match without leaving the JVM.
    """
    def rebuilt(text: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        joined = F.array_join(
            F.zip_with(pieces, matches, lambda piece, m: F.concat(piece, F.coalesce(change(m), F.lit("")))), "")
        return F.when(text.rlike(pattern), joined).otherwise(text)

    return let(c, rebuilt)


def _unicode_form(form: str, drop_marks: bool):
    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            folded = unicodedata.normalize(form, text)
            if drop_marks:
                folded = "".join(ch for ch in folded if not unicodedata.combining(ch))
            return folded

        return values.map(one, na_action="ignore")

    return fold


def fold_unicode(c: Column, form: str = "NFKC", drop_marks: bool = False) -> Column:
    """Unicode normal form. Only rows with a non-ASCII character carry text to Python."""
    exotic = c.rlike(r"[^\x00-\x7F]")
    return F.when(exotic, _unicode_form(form, drop_marks)(F.when(exotic, c))).otherwise(c)


def normalize_name(c: Column, unicode_fold: bool = False) -> Column:
    """Company name without case, punctuation and legal suffixes; NULL when nothing is left.

    ``unicode_fold`` adds the compatibility normal form, which costs an Arrow round trip.
    """
    suffix = rf"(?U)\b({V.LEGAL_SUFFIXES})\b\.?"
    text = fold_unicode(c) if unicode_fold else c
    text = F.regexp_replace(F.lower(text), suffix, "")
    text = F.regexp_replace(text, r"(?U)[^\w\s]", " ")
    text = F.regexp_replace(text, suffix, "")
    return blank_to_null(collapse(text))


def normalize_person_name(c: Column, unicode_fold: bool = True) -> Column:
    """Person name without accents, punctuation and leading honorifics; order and suffix stay."""
    text = fold_unicode(c, "NFKD", drop_marks=True) if unicode_fold else c
    text = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))
    honorifics = "|".join(V.HONORIFICS)
    return F.trim(F.regexp_replace(text, rf"^(?:(?:{honorifics})(?:\s+|$))+", ""))


def normalize_city(c: Column) -> Column:
    clean = F.initcap(collapse(F.regexp_replace(c, r"(?U)[^\w\s-]", "")))
    compact = F.replace(F.lower(clean), F.lit(" "), F.lit(""))
    return F.when(compact.isin("newyorkcity", "nyc"), F.lit("New York")).otherwise(clean)


def clean_glyphs(c: Column) -> Column:
    """Zero-width characters and bullets removed, whitespace collapsed, empty to NULL."""
    text = F.regexp_replace(c, "[​‌‍﻿•●▪]", "")
    return blank_to_null(collapse(F.replace(text, F.lit(" "), F.lit(" "))))


def normalize_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def normalize_keyword(c: Column) -> Column:
    """Trade keyword: ``&`` is spelled out and plural tokens are made singular."""
    text = F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")
    tokens = F.filter(F.split(F.trim(text), " "), lambda t: t != "")

    def singular(t: Column) -> Column:
        return (
            F.when(t == "companies", F.lit("company"))
            .when(t == "fences", F.lit("fence"))
            .when(t.endswith("s") & (F.length(t) > 4) & ~t.isin("glass", "business"),
                  t.substr(F.lit(1), F.length(t) - 1))
            .otherwise(t)
        )

    return F.array_join(F.transform(tokens, singular), " ")


def clean_tags(c: Column) -> Column:
    """Split on ``; | ,``, drop irrelevant tags, keep the first spelling of each, join with `` | ``."""
    tags = F.transform(F.split(c, r"[;|,]"), clean_glyphs)
    kept = F.filter(tags, lambda t: t.isNotNull() & ~F.lower(t).isin(V.IRRELEVANT_TAGS))
    unique = F.filter(kept, lambda t, i: F.array_position(F.transform(kept, lambda k: F.lower(k)), F.lower(t)) == i + 1)
    return blank_to_null(F.array_join(unique, " | "))


def all_words_match(text: Column, keyword: Column) -> Column:
    """Every keyword word except filler words occurs in the text; nothing left to check is a match."""
    words = F.filter(F.split(F.lower(keyword), r"\s+"), lambda w: (w != "") & ~w.isin(V.FILLER_WORDS))
    hit = F.forall(words, lambda w: F.contains(F.lower(text), w))
    return ~present(text) | ~present(keyword) | hit


def language_blob(c: Column, language_names: list[str]) -> Column:
    """Five words or more, of which more than 35 percent are language names."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    named = F.filter(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,;:]+|[.,;:]+$", "").isin(language_names))
    enough = F.size(words) >= 5
    return F.coalesce(enough & (F.size(named) / F.greatest(F.size(words), F.lit(1)) > 0.35), F.lit(False))


def message_text(content_json: Column) -> Column:
    """Text of a message whose content is plain text or a JSON list of content blocks."""
    blocks = F.from_json(content_json, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: present(t)), " ")
    return F.when(F.ltrim(content_json).startswith("["), joined).otherwise(F.coalesce(content_json, F.lit("")))


def looks_like_person(c: Column) -> Column:
    """Two to five mostly capitalised words, no digits or colon, not made of job titles only."""
    functions = V.TITLE_WORDS + ["sales", "operations", "purchasing", "accounts", "and", "&", "senior", "chief"]

    def judge(text: Column) -> Column:
        words = F.filter(F.split(F.replace(text, F.lit("."), F.lit(" ")), " "), lambda w: w != "")
        short_form = text.rlike(r"^[A-Z][A-Za-z'’.-]+\s+(?:[A-Z]\.|\.)$")
        usual = let(words, lambda ws: F.size(ws).between(2, 5) & ~F.forall(ws, lambda w: F.lower(w).isin(functions)) & (
            F.size(F.filter(ws, lambda w: w.rlike(r"^\p{Lu}"))) >= F.greatest(F.lit(2), F.size(ws) - 1)))
        return (F.length(text) <= 60) & (text != "") & ~text.rlike(r"[0-9:]") & (short_form | usual)

    return F.coalesce(let(collapse(c), judge), F.lit(False))


def split_person_title(c: Column) -> Column:
    """``Jane Doe, President`` becomes ``struct(name, title)`` when both halves are convincing."""
    shape = r"^(.+?)\s*(?:,|[-–—]|\|)\s*(.+)$"

    def halves(text: Column) -> Column:
        return F.struct(text.alias("text"), F.regexp_extract(text, shape, 1).alias("name"), F.regexp_extract(text, shape, 2).alias("title"))

    def choose(h: Column) -> Column:
        tokens = F.transform(F.split(F.lower(h["title"]), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
        good = looks_like_person(h["name"]) & F.arrays_overlap(tokens, string_array(V.TITLE_WORDS))
        return F.when(good, F.struct(h["name"].alias("name"), h["title"].alias("title"))).otherwise(
            F.struct(h["text"].alias("name"), F.lit("").alias("title")))

    return let(let(collapse(c), halves), choose)


def department_for_role(label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(low.contains("estimat"), F.lit("Estimating"))
        .when(low.contains("project"), F.lit("Project Management"))
        .when(low.rlike("owner|principal|president|executive|founder|partner|ceo|coo|cfo"),
              F.lit("Owners, Principals & Senior Executives"))
        .when(low.contains("operat"), F.lit("Operations"))
    )
