"""Trade catalogue, keyword resolution, search plans, source choice and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.place import normalize_state, zip_code
from ..functions.text import blank_to_null, constant_map, normalize_keyword, present
from ..functions.urls import canonical_url
from .ordered import first_rows, top_rows


# --- geography -------------------------------------------------------------------------------
def regions_of_state(state: Column) -> Column:
    """Array of sales region numbers of a state."""
    lists = constant_map({s: ",".join(str(r) for r in regions) for s, regions in V.STATE_REGIONS.items()})
    text = F.try_element_at(lists, F.upper(state))
    return F.when(text != "", F.transform(F.split(text, ","), lambda r: r.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def zip_prefixes(spark: SparkSession) -> DataFrame:
    """The ZIP ranges spelled out as at most 1,000 prefixes, so the lookup is an equi-join."""
    table = spark.createDataFrame(V.ZIP3_RANGES, "low int, high int, zip_state string")
    return table.select(F.explode(F.sequence("low", "high")).alias("zip3"), "zip_state")


def state_of_zip(df: DataFrame, column: str, name: str = "zip_state") -> DataFrame:
    """Add the state a ZIP code lies in; border exceptions are not modelled."""
    prefixes = F.broadcast(zip_prefixes(df.sparkSession).withColumnRenamed("zip_state", name))  # fixed size
    prefix = F.substring(zip_code(F.col(column)), 1, 3).try_cast("int")
    return df.withColumn("zip3", prefix).join(prefixes, "zip3", "left").drop("zip3")


def parse_region(value: Column, regions: dict[int, str]) -> Column:
    """Region number from a number or a region name."""
    by_name = constant_map({normalize_region_name(n): i for i, n in regions.items()})
    number = F.trim(value).try_cast("int")
    return F.when(number.isin(list(regions)), number).otherwise(F.try_element_at(by_name, normalize_keyword(value)))


def normalize_region_name(name: str) -> str:
    import re

    words = re.sub(r"[^a-z0-9]+", " ", name.lower().replace("&", " and ")).split()
    return " ".join(w[:-1] if w.endswith("s") and len(w) > 4 and w not in ("glass", "business") else w for w in words)


# --- trade catalogue -------------------------------------------------------------------------
def merge_catalog(base: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom trades merged into the catalogue by normalised name or code; aliases and related are united.

    Both have ``position, name, code, aliases ARRAY, related ARRAY``. The custom spelling wins.
    """
    keyed = base.withColumn("_name", normalize_keyword(F.col("name")))
    fresh = custom.select(F.col("position").alias("_p"), F.col("name").alias("_n"), F.col("code").alias("_c"),
                          F.col("aliases").alias("_a"), F.col("related").alias("_r"), normalize_keyword(F.col("name")).alias("_name"))
    by_name = keyed.join(fresh, "_name").select("position", *[F.col(c) for c in ("_p", "_n", "_c", "_a", "_r")])
    by_code = keyed.join(fresh.drop("_name"), F.col("code") == F.col("_c")).select("position", *[F.col(c) for c in ("_p", "_n", "_c", "_a", "_r")])
    pairs = first_rows(by_name.unionByName(by_code), ["_p"], [F.col("position")])
    merged = first_rows(pairs, ["position"], [F.col("_p")])
    joined = base.join(merged, "position", "left")
    united = joined.select(
        "position", F.coalesce("_n", "name").alias("name"), F.coalesce("_c", "code").alias("code"),
        F.when(F.col("_a").isNotNull(), F.array_distinct(F.concat("aliases", "_a"))).otherwise(F.col("aliases")).alias("aliases"),
        F.when(F.col("_r").isNotNull(), F.array_distinct(F.concat("related", "_r"))).otherwise(F.col("related")).alias("related"))
    added = custom.join(pairs.select(F.col("_p").alias("position")), "position", "left_anti")
    last = base.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("m")).scalar()
    return united.unionByName(added.withColumn("position", F.col("position") + last + 1).select(*united.columns))


def catalog_keys(catalog: DataFrame) -> DataFrame:
    """``(key, code, position)``: normalised names and aliases; the first trade in catalogue order owns a key."""
    own = catalog.select(normalize_keyword(F.col("name")).alias("key"), "code", "position", F.lit(0).alias("_alias"))
    spelled = catalog.select(F.explode("aliases").alias("key"), "code", "position")
    other = spelled.select(normalize_keyword(F.col("key")).alias("key"), "code", "position", F.lit(1).alias("_alias"))
    return first_rows(own.unionByName(other).filter(F.col("key") != ""), ["key"], [F.col("position"), F.col("_alias")], ["key", "code", "position"])


_WEAK_TOKENS = ["commercial", "contractor", "company", "service"]


def resolve_keywords(keywords: DataFrame, catalog: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Trades of every distinct keyword, by the first stage that finds one.

    Stages: keyword group, exact name or alias, token overlap (0.82), similar spelling
    (0.75). Keywords are reduced to distinct normalised keys first; each stage is an equi-join
    against the catalogue on key, token or letter pair.
    """
    asked = keywords.select(normalize_keyword(F.col("keyword")).alias("key")).filter(F.col("key") != "").distinct()
    keys = catalog_keys(catalog)
    found: list[DataFrame] = []

    def rest(of: DataFrame, hits: DataFrame) -> DataFrame:
        return of.join(hits.select("key").distinct(), "key", "left_anti")

    open_keys = asked
    if groups is not None:
        members = groups.select(normalize_keyword(F.col("keyword")).alias("key"), F.posexplode("names").alias("_i", "_name"))
        owned = catalog.select(normalize_keyword(F.col("name")).alias("_name"), "code")
        members = members.withColumn("_name", normalize_keyword(F.col("_name"))).join(owned, "_name")
        grouped = open_keys.join(members, "key").select("key", "code", F.col("_i").alias("pos"), F.lit("group_primary").alias("relation"),
                                                        F.lit(1.0).alias("confidence"))
        found.append(grouped)
        open_keys = rest(open_keys, grouped)
    exact = open_keys.join(keys, "key").select("key", "code", F.lit(0).alias("pos"), F.lit("primary").alias("relation"), F.lit(1.0).alias("confidence"))
    found.append(exact)
    open_keys = rest(open_keys, exact)

    tokens = F.array_distinct(F.filter(F.split("key", " "), lambda t: (F.length(t) >= 4) & ~t.isin(_WEAK_TOKENS)))
    wanted = open_keys.withColumn("_tokens", tokens).select("key", F.size("_tokens").alias("_n"), F.explode("_tokens").alias("token"))
    offered = keys.select(F.col("key").alias("_cand"), "code", "position", F.explode(F.array_distinct(F.split("key", " "))).alias("token"))
    overlap = wanted.join(offered, "token").groupBy("key", "_n", "_cand", "code", "position").agg(F.count(F.lit(1)).alias("_hits"))
    best = first_rows(overlap, ["key"], [-F.col("_hits"), F.col("position"), F.col("_cand")], ["key", "_n", "code", "_hits"])
    by_token = best.filter(F.col("_hits") >= F.least(F.lit(2), F.col("_n"))).select(
        "key", "code", F.lit(0).alias("pos"), F.lit("token_match").alias("relation"), F.lit(0.82).alias("confidence"))
    found.append(by_token)
    open_keys = rest(open_keys, by_token)

    similar = similar_keys(open_keys, keys)
    fuzzy = first_rows(similar.filter(F.col("similarity") >= 0.9), ["key"], [-F.col("similarity"), F.col("position"), F.col("candidate")],
                       ["key", "code"])
    found.append(fuzzy.select("key", "code", F.lit(0).alias("pos"), F.lit("fuzzy_match").alias("relation"), F.lit(0.75).alias("confidence")))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return asked.join(result, "key", "left").withColumn("resolved", F.col("code").isNotNull())


def similar_keys(asked: DataFrame, keys: DataFrame, cutoff: float = 0.78) -> DataFrame:
    """Catalogue keys whose spelling is at least ``cutoff`` similar (one minus edit distance over length).

    Candidates share a letter pair. That loses nothing: an edit destroys at most two of the
    ``n - 1`` pairs, and a cutoff above one half leaves fewer than ``(n - 1) / 2`` edits.
    """
    def pairs(c: str) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(2))))

    left = asked.select("key", F.explode(pairs("key")).alias("pair"))
    right = keys.select(F.col("key").alias("candidate"), "code", "position")
    right = right.withColumn("pair", F.explode(pairs("candidate")))
    near = F.abs(F.length("key") - F.length("candidate")) <= F.greatest(F.length("key"), F.length("candidate")) * (1 - cutoff)
    met = left.join(right, "pair").filter(near).groupBy("key", "candidate", "code", "position").agg(F.lit(1).alias("_"))
    similarity = 1 - F.levenshtein("key", "candidate") / F.greatest(F.length("key"), F.length("candidate"))
    return met.drop("_").withColumn("similarity", similarity).filter(F.col("similarity") >= cutoff)


def related_trades(resolved: DataFrame, catalog: DataFrame, broad: bool = False, most: int = 4, most_broad: int = 10) -> DataFrame:
    """Primary trades plus their neighbours: one step and at most ``most``, or two steps and at most ``most_broad``."""
    owned = catalog.select(normalize_keyword(F.col("name")).alias("_name"), F.col("code").alias("to"))
    links = catalog.select(F.col("code").alias("from"), F.posexplode("related").alias("_order", "_name")).withColumn(
        "_name", normalize_keyword(F.col("_name"))).join(owned, "_name").select("from", "to", "_order")
    seen = resolved.filter(F.col("code").isNotNull()).select("key", "code", "pos", F.lit(0).alias("depth"))
    limit, frontier, result = (most_broad if broad else most), seen, seen
    for depth in range(1, 3 if broad else 2):
        step = frontier.join(links, frontier["code"] == links["from"]).select(
            "key", F.col("to").alias("code"), F.struct(F.col("pos"), F.col("_order")).alias("_at"))
        step = first_rows(step, ["key", "code"], [F.col("_at")]).join(result.select("key", "code"), ["key", "code"], "left_anti")
        taken = result.filter(F.col("depth") > 0).groupBy("key").agg(F.count(F.lit(1)).alias("_taken"))
        ranked = top_rows(step, ["key"], [F.col("_at")], limit, "pos").join(taken, "key", "left")
        added = ranked.filter(F.col("pos") + F.coalesce("_taken", F.lit(0)) <= limit).select("key", "code", "pos", F.lit(depth).alias("depth"))
        result, frontier = result.unionByName(added), added
    return result


# --- search plans ----------------------------------------------------------------------------
def build_plan(asked: DataFrame, trades: DataFrame, places: DataFrame, base_url: str) -> DataFrame:
    """One planned search per canonical URL.

    ``asked(request_id, keyword, key)``, ``trades(key, code, trade, relation, depth)`` and
    ``places(request_id, region, state, place_priority, label)`` meet on their keys. Searches
    with the same URL are united: keywords are collected and the best priority lends its attributes.
    """
    relation = (F.when(F.col("relation").isin("primary", "class_code"), 0).when(F.col("relation") == "group_primary", 1)
                .when(F.col("relation") == "token_match", 2).when(F.col("relation") == "fuzzy_match", 3)
                .when(F.col("relation") == "related", F.col("depth") * 5 + 15).otherwise(25))
    url = canonical_url(F.concat(F.lit(base_url), F.lit("?region="), "region", F.lit("&class="), "code"), listing=True)
    rows = asked.join(trades, "key").join(places, "request_id").select(
        url.alias("url"), "keyword", "trade", "code", "region", "state", "label", "relation",
        F.least(F.lit(95), F.col("place_priority") + relation).alias("priority"))
    best = F.struct("trade", "code", "region", "state", "label", "relation")
    united = rows.groupBy("url").agg(
        F.min_by(best, F.struct("priority", "keyword", "label")).alias("b"), F.min("priority").alias("priority"),
        F.array_sort(F.collect_set("keyword")).alias("keywords"))
    return united.select("url", "priority", "keywords", "b.*")


def plan_order() -> list[Column]:
    return [F.col("priority"), F.col("trade"), F.col("label"), F.col("url")]


# --- sources ---------------------------------------------------------------------------------
def compact_city(c: Column) -> Column:
    """Comparable form of a city; spellings of New York City fall together."""
    key = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.when(key.isin("newyork", "nyc", "newyorkcity"), F.lit("newyorkcity")).otherwise(F.regexp_replace(key, "city$", ""))


def source_violations() -> Column:
    """Why a source cannot serve a request; empty when it can. Columns of both sides are expected."""
    located = present(F.col("city")) | F.col("us_state").isNotNull()
    city_known = F.size("supported_cities") == 0
    listed = F.exists("supported_cities", lambda c: compact_city(c) == compact_city(F.col("city")))
    other_city = present(F.col("city")) & F.coalesce(F.lower("city") != F.lower("coverage_city"), F.lit(False))
    other_state = F.coalesce(F.col("us_state") != F.col("coverage_state"), F.lit(False))
    covers = F.col("coverage_city").isNotNull() | F.col("coverage_state").isNotNull()
    inside = (covers & (~present(F.col("city")) | F.coalesce(F.lower("city") == F.lower("coverage_city"), F.lit(False)))
              & (F.col("us_state").isNull() | F.coalesce(F.col("us_state") == F.col("coverage_state"), F.lit(False))))
    return F.array_compact(F.array(
        F.when(present(F.col("keyword")) & ~F.col("supports_keyword"), F.lit("keyword not supported")),
        F.when(F.col("requires_location") & ~located, F.lit("location required")),
        F.when(F.col("requires_city") & ~present(F.col("city")), F.lit("city required")),
        F.when(present(F.col("city")) & ~city_known & ~listed, F.lit("city not available")),
        F.when(located & other_city, F.lit("other city")),
        F.when(located & other_state, F.lit("other state")),
        F.when(located & ~inside & ~other_city & ~other_state & ~F.col("supports_location"), F.lit("location not supported"))))


def candidate_sources(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that can serve a request, state-specific ones first.

    Requests and sources meet on the record kind. A source with a coverage state is left out of
    requests without a state, and sources already attempted are left out.
    """
    met = requests.join(sources.filter(F.col("ready")), "record_kind").withColumn("violations", source_violations())
    fits = (F.size("violations") == 0) & ~F.array_contains("attempted", F.col("source_id")) & (
        F.col("coverage_state").isNull() | F.col("us_state").isNotNull())
    return met.filter(fits)


def recommend_sources(candidates: DataFrame, k: int = 1) -> DataFrame:
    order = [F.when(F.col("coverage_state").isNotNull(), 0).otherwise(1), F.col("source_id")]
    return top_rows(candidates, ["request_id"], order, k, "choice")


def source_catalog(sources: DataFrame, readiness: DataFrame) -> DataFrame:
    """Source metadata with readiness and the reason when a source cannot be used."""
    joined = sources.join(readiness, "source_id", "left")
    return joined.withColumns({"ready": F.coalesce("ready", F.lit(False)),
                               "reason": F.when(~F.coalesce("ready", F.lit(False)), F.coalesce("reason", F.lit("unknown source")))})


def synchronize_sources(stored: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry entries inserted or overwritten and set active; unregistered sources stay as they are."""
    new = registry.select("code", F.col("name").alias("_name"), F.col("description").alias("_description"), F.lit("Active").alias("_status"))
    joined = stored.join(new, "code", "full_outer")
    return joined.select("code", *[F.coalesce(f"_{c}", c).alias(c) for c in ("name", "description", "status")])


# --- enrichment ------------------------------------------------------------------------------
def fill_missing(base: DataFrame, extra: DataFrame, on: Sequence[str], fields: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """Fields of ``extra`` where ``base`` has none; list columns are united."""
    more = extra.select(*on, *[F.col(c).alias(f"_x_{c}") for c in [*fields, *lists]])
    joined = base.join(more, list(on), "left")
    filled = {c: F.coalesce(blank_to_null(F.col(c)), blank_to_null(F.col(f"_x_{c}"))) for c in fields}
    filled.update({c: F.array_union(F.coalesce(c, F.array().cast("array<string>")), F.coalesce(f"_x_{c}", F.array().cast("array<string>"))) for c in lists})
    return joined.withColumns(filled).drop(*[f"_x_{c}" for c in [*fields, *lists]])


def default_city(state: Column, cities: dict[str, str]) -> Column:
    return F.try_element_at(constant_map(cities), normalize_state(state))


def canonical_trade(c: Column, trades: dict[str, str]) -> Column:
    """Canonical category of a trade alias; an unknown alias stays as it is."""
    return F.coalesce(F.try_element_at(constant_map({normalize_region_name(k): v for k, v in trades.items()}), normalize_keyword(c)), c)
