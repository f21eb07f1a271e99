"""States, cities, ZIP codes, addresses and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import blank_to_null, clean_glyphs, collapse, constant_map, let, normalize_city

_ZIP = r"\b(\d{5}(?:-\d{4})?)\b"


_STATE_SPELLINGS = {**{code: code for code in V.US_STATES}, **{name.upper(): code for code, name in V.US_STATES.items()}}


def normalize_state(c: Column) -> Column:
    """Two-letter code from a code or a full name, NULL when neither."""
    key = F.rtrim(F.regexp_replace(F.upper(F.trim(c)), r"\.+$", ""))
    return F.try_element_at(constant_map(_STATE_SPELLINGS), key)


def state_name(code: Column) -> Column:
    return F.try_element_at(constant_map(V.US_STATES), F.upper(code))


def zip_code(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"\b(\d{5})(?:-\d{4})?\b", 1))


def _strip_end_comma(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r",+$", "")


def _city_and_state(rest: Column) -> Column:
    """City and state of a location text without postal code, as ``struct(city, state)``."""

    def by_comma(parts: Column) -> Column:
        n = F.size(parts)
        return let(normalize_state(F.get(parts, n - 1)), lambda state: F.struct(
            F.when(state.isNotNull(), F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), ", "))
            .otherwise(F.array_join(parts, ", ")).alias("city"), state.alias("state")))

    def by_words(words: Column) -> Column:
        n = F.size(words)
        found = F.struct(
            normalize_state(F.array_join(words, " ")).alias("whole"),
            F.when(n >= 3, normalize_state(F.concat_ws(" ", F.get(words, n - 2), F.get(words, n - 1)))).alias("two"),
            F.when(n >= 2, normalize_state(F.get(words, n - 1))).alias("one"))

        def first_words(k: int) -> Column:
            return F.array_join(F.slice(words, 1, F.greatest(n - k, F.lit(0))), " ")

        return let(found, lambda s: F.struct(
            F.when(s["whole"].isNotNull(), F.lit(None).cast("string"))
            .when(s["two"].isNotNull(), first_words(2)).when(s["one"].isNotNull(), first_words(1))
            .otherwise(F.array_join(words, " ")).alias("city"),
            F.coalesce(s["whole"], s["two"], s["one"]).alias("state")))

    parts = F.filter(F.transform(F.split(rest, ","), lambda p: F.trim(p)), lambda p: p != "")
    words = F.filter(F.split(rest, r"\s+"), lambda w: w != "")
    return F.when(rest.contains(","), let(parts, by_comma)).otherwise(let(words, by_words))


def parse_location(c: Column) -> Column:
    """Free text to ``struct(city, state, postal)``."""
    text = _strip_end_comma(F.regexp_replace(F.trim(c), r"(?i),?\s*(?:USA|US|United States)\b\.?$", ""))

    def split_postal(t: Column) -> Column:
        postal = blank_to_null(F.regexp_extract(t, _ZIP, 1))
        rest = F.when(postal.isNotNull(), _strip_end_comma(
            F.regexp_replace(t, r"(?s)^(.*?)\b\d{5}(?:-\d{4})?\b(.*)$", "$1$2"))).otherwise(t)
        return F.struct(postal.alias("postal"), rest.alias("rest"))

    return let(let(text, split_postal), lambda t: let(_city_and_state(t["rest"]), lambda p: F.struct(
        blank_to_null(p["city"]).alias("city"), p["state"].alias("state"), t["postal"].alias("postal"))))


def place_with_state(c: Column, default_state: Column | None = None) -> Column:
    """``Houston, TX 77002`` / ``Houston_TX`` / ``Houston Texas`` to ``struct(place, state, zip)``."""
    fallback = default_state if default_state is not None else F.lit(None).cast("string")
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"\b\d{5}(?:-\d{4})?\b", ""), r"^[ ,]+|[ ,]+$", "")

    def by_words(words: Column) -> Column:
        n = F.size(words)

        def tail(k: int) -> Column:
            return F.when(n >= k, normalize_state(F.concat_ws(" ", F.slice(words, F.greatest(n - k + 1, F.lit(1)), k))))

        def head(k: int) -> Column:
            return F.regexp_replace(F.array_join(F.slice(words, 1, F.greatest(n - k, F.lit(0))), " "), r"[ ,]+$", "")

        found = F.struct(*[tail(k).alias(f"s{k}") for k in (1, 2, 3)])
        return let(found, lambda s: F.struct(
            F.when(s["s3"].isNotNull(), head(3)).when(s["s2"].isNotNull(), head(2)).when(s["s1"].isNotNull(), head(1))
            .otherwise(F.array_join(words, " ")).alias("place"),
            F.coalesce(s["s3"], s["s2"], s["s1"], fallback).alias("state")))

    def by_mark(raw: Column) -> Column:
        marks = F.struct(
            F.when(raw.contains("_"), normalize_state(F.substring_index(raw, "_", -1))).alias("under"),
            F.when(raw.contains(","), normalize_state(F.substring_index(raw, ",", -1))).alias("comma"))
        words = F.filter(F.split(raw, r"\s+"), lambda w: w != "")
        return let(marks, lambda m: F.when(m["under"].isNotNull(), F.struct(
            F.trim(F.regexp_replace(raw, r"_[^_]*$", "")).alias("place"), m["under"].alias("state")))
            .when(m["comma"].isNotNull(), F.struct(
                F.trim(F.regexp_replace(raw, r",[^,]*$", "")).alias("place"), m["comma"].alias("state")))
            .otherwise(let(words, by_words)))

    return let(let(bare, by_mark), lambda p: F.struct(
        p["place"].alias("place"), p["state"].alias("state"), zip_code(c).alias("zip")))


def _title(c: Column) -> Column:
    return F.initcap(collapse(F.replace(c, F.lit("_"), F.lit(" "))))


def parse_city(c: Column, default_state: Column | None = None) -> Column:
    def named(p: Column) -> Column:
        return let(_title(p["place"]), lambda city: F.struct(
            city.alias("city"), p["state"].alias("state"), p["zip"].alias("zip"),
            F.when(p["state"].isNotNull() & (city != ""), F.concat_ws(", ", city, p["state"])).otherwise(city).alias("label")))

    return let(place_with_state(c, default_state), named)


def parse_county(c: Column, default_state: Column | None = None) -> Column:
    """County name with its kind, state and the ``Name(ST)`` form used in searches."""
    raw = F.trim(c)
    bracket = normalize_state(F.regexp_extract(raw, r"\(([A-Za-z]{2})\)\s*$", 1))
    own = F.trim(F.regexp_replace(raw, r"\([A-Za-z]{2}\)\s*$", ""))
    parts = let(place_with_state(raw, default_state), lambda p: F.when(
        bracket.isNotNull(), F.struct(_title(own).alias("county"), bracket.alias("state")))
        .otherwise(F.struct(_title(p["place"]).alias("county"), p["state"].alias("state"))))

    def complete(p: Column) -> Column:
        kind = p["county"].rlike(r"(?i)\b(county|parish|borough|census area)$") | (p["county"] == "")
        county = F.when(kind, p["county"]).otherwise(F.concat(p["county"], F.lit(" County")))
        facet = F.when(p["state"].isNotNull(), F.concat(county, F.lit("("), p["state"], F.lit(")"))).otherwise(county)
        return F.struct(county.alias("county"), p["state"].alias("state"), facet.alias("facet"))

    return let(parts, complete)


def parse_street_address(c: Column) -> Column:
    """``street, city, ST 12345`` to a struct; text of another shape stays in ``street``."""
    text = F.regexp_replace(clean_glyphs(c), r"(?i),\s*United States$", "")
    shape = r"^(.*?),\s*([^,]+),\s*([A-Z]{2})\s+(\d{5}(?:-\d{4})?)$"
    hit = text.rlike(shape)
    return F.struct(
        F.when(hit, F.trim(F.regexp_extract(text, shape, 1))).otherwise(text).alias("street"),
        F.when(hit, F.trim(F.regexp_extract(text, shape, 2))).alias("city"),
        F.when(hit, F.regexp_extract(text, shape, 3)).alias("state"),
        F.when(hit, F.regexp_extract(text, shape, 4)).alias("zip"),
    )


def address_with_fallback(address: Column, fallback: Column) -> Column:
    """City, state and postal code of an address, missing parts taken from the search location."""
    both = F.struct(parse_location(address).alias("own"), parse_location(fallback).alias("other"))

    def fill(b: Column) -> Column:
        own, other = b["own"], b["other"]
        city = F.when(own["city"].contains(","), F.trim(F.substring_index(own["city"], ",", -1))).otherwise(own["city"])
        need = city.isNull() | own["state"].isNull()
        return F.struct(
            F.coalesce(city, other["city"]).alias("city"),
            F.coalesce(own["state"], F.when(need, F.coalesce(other["state"], normalize_state(fallback)))).alias("state"),
            F.coalesce(own["postal"], F.when(need, other["postal"])).alias("postal"))

    return let(both, fill)


def coordinates(url: Column) -> Column:
    """Latitude and longitude from a map URL, ``/@lat,lon`` before ``!3dlat!4dlon``."""
    first, second = r"/@(-?\d+\.\d+),(-?\d+\.\d+)", r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)"

    def pick(group: int) -> Column:
        return F.coalesce(blank_to_null(F.regexp_extract(url, first, group)),
                          blank_to_null(F.regexp_extract(url, second, group))).try_cast("double")

    return F.struct(pick(1).alias("latitude"), pick(2).alias("longitude"))


def money(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"(?i)\$[\d,]+(?:\.\d+)?\s*(?:million\b|m\b|k\b|thousand\b)?", 0))


def location_matches(city: Column, state: Column, want_city: Column, want_state: Column, want_text: Column) -> Column:
    """Record against request: city and state of the request override its raw location text."""
    wanted = normalize_state(want_state)
    structured = want_city.isNotNull() | wanted.isNotNull()
    state_ok = wanted.isNull() | F.coalesce(normalize_state(state) == wanted, F.lit(False))
    city_ok = want_city.isNull() | F.coalesce(
        F.lower(normalize_city(city)) == F.lower(normalize_city(want_city)), F.lit(False))
    text_ok = (F.coalesce(F.contains(F.lower(city), F.lower(want_text)), F.lit(False))
               | F.coalesce(normalize_state(state) == normalize_state(want_text), F.lit(False)))
    return F.when(structured, state_ok & city_ok).when(want_text.isNotNull(), text_ok).otherwise(F.lit(True))
