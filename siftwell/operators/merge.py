"""Identity resolution, merging, upserts and run accounting.

Two merge rules exist side by side: inside one batch the first non-empty value of a field
wins, across arrivals the latest one does. Both are aggregations with map-side combine, so an
identity with very many observations is combined before it is shuffled.
"""

from __future__ import annotations

import dataclasses
import functools
import operator
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import joined_hash
from ..functions.scoring import job_outcome
from ..functions.text import blank_to_null, normalize_person_name, present
from .ordered import block_bucket, first_rows, number_rows


def filled(df: DataFrame, name: str) -> Column:
    """The column with blank text as NULL."""
    return blank_to_null(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name)


# --- merging observations --------------------------------------------------------------------
def merge_batch(df: DataFrame, keys: Sequence[str], ordinal: str, fields: Sequence[str]) -> DataFrame:
    """One row per key; for every field the first non-empty value in ordinal order."""
    picks = [F.min_by(filled(df, f), F.when(filled(df, f).isNotNull(), F.col(ordinal))).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*picks, F.count(F.lit(1)).alias("observations"))


def merge_latest(df: DataFrame, keys: Sequence[str], ordinal: str, fields: Sequence[str]) -> DataFrame:
    """One row per key; for every field the latest non-empty value in ordinal order."""
    picks = [F.max_by(filled(df, f), F.when(filled(df, f).isNotNull(), F.col(ordinal))).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*picks, F.count(F.lit(1)).alias("observations"))


def merge_maps(df: DataFrame, keys: Sequence[str], ordinal: str, column: str) -> DataFrame:
    """Union of the maps of a key; the latest value of a map key wins."""
    entries = df.select(*keys, ordinal, F.explode(column).alias("_k", "_v"))
    latest = entries.groupBy(*keys, "_k").agg(F.max_by("_v", ordinal).alias("_v"))
    return latest.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias(column))


def content_hash(fields: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def block_summaries(rows: DataFrame, key: str, hashed: Sequence[str], latest: Sequence[str], first: Sequence[str], entries: bool,
                    context: Sequence[str], also: Sequence[str]) -> DataFrame:
    """One row per key and ``_block`` of ``rows``, which are ordered by ``_at``; what earlier blocks decide stays open.

    ``_sure`` counts arrivals that changed something by what the block itself says. ``_open_<field>`` is the first
    value of a hashed field in the block, which only counts if it differs from that of the blocks before; ``_entries`` has
    the first and the last value of every name in the map ``extra`` (with ``entries``).
    """
    fields = list(dict.fromkeys([*hashed, *latest, *first]))
    inside = W.partitionBy(key, "_block").orderBy("_at")
    local = rows.select(key, "_block", "_at", *[filled(rows, f).alias(f) for f in fields], *also,
                        *([F.explode_outer(F.map_filter("extra", lambda k, v: v.isNotNull())).alias("_k", "_v")] if entries else []))
    if entries:
        named = W.partitionBy(key, "_block", "_k").orderBy("_at")
        local = local.withColumns({"_was": F.lag("_v").over(named), "_next": F.lead("_v").over(named)})
    local = local.withColumns({"_rn": (F.dense_rank() if entries else F.row_number()).over(inside),
                               **{f"_p_{f}": F.last(f, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1)) for f in hashed}})
    fresh = {f: F.col(f).isNotNull() & F.col(f"_p_{f}").isNull() for f in hashed}
    differs = [F.col(f).isNotNull() & F.col(f"_p_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_p_{f}")) for f in hashed]
    if entries:
        differs.append(F.col("_was").isNotNull() & ~F.col("_was").eqNullSafe(F.col("_v")) & ~F.col("_k").isin(list(context)))
    local = local.withColumn("_sure", functools.reduce(operator.or_, differs))
    if entries:  # an arrival is as many rows as it has entries
        local = local.withColumns({"_sure": F.bool_or("_sure").over(inside.rangeBetween(W.currentRow, W.currentRow)),
                                   "_head": ~F.lag("_rn").over(inside).eqNullSafe(F.col("_rn"))})

    def placed(f: str) -> Column:
        return F.when(F.col(f).isNotNull(), F.col("_rn"))

    told = F.struct(F.col("_k").alias("name"), F.col("_v").alias("value"), F.col("_rn").alias("rn"), F.col("_sure").alias("sure"),
                    F.col("_was").isNull().alias("first"), F.col("_next").isNull().alias("last")) if entries else None
    ends = F.col("_k").isNotNull() & (F.col("_was").isNull() | F.col("_next").isNull()) if entries else None
    return local.groupBy(key, "_block").agg(
        F.count_if(F.col("_sure") & F.col("_head") if entries else F.col("_sure")).alias("_sure"), *[F.max(c).alias(c) for c in also],
        *[F.min(F.when(t, F.struct(F.col("_rn").alias("rn"), F.col("_sure").alias("sure"), F.col(f).alias("value")))).alias(f"_open_{f}") for f, t in fresh.items()],
        *[F.max_by(f, placed(f)).alias(f"_latest_{f}") for f in dict.fromkeys([*hashed, *latest])],
        *[F.min_by(f, placed(f)).alias(f"_first_{f}") for f in first],
        *([F.collect_list(F.when(ends, told)).alias("_entries")] if entries else []))


def fold_arrivals(rows: DataFrame, key: str, hashed: Sequence[str], latest: Sequence[str], first: Sequence[str] = (), entries: bool = False,
                  context: Sequence[str] = (), also: Sequence[str] = ()) -> DataFrame:
    """State of every key of ``rows(key, _block, _at, ...)`` after its last arrival, and ``_n``, how many arrivals after the first changed it.

    Rows are shuffled once, by key and block, and one summary per block once more, by key. There the summaries of a
    key are gone through in the order of its blocks. Of the columns in ``also`` the largest value is kept.
    """
    found = block_summaries(rows, key, hashed, latest, first, entries, context, also)
    kinds = {c: found.schema[c].dataType for c in found.columns if c.startswith(("_latest_", "_first_")) and c not in also}
    blocks = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_block", *[c for c in found.columns if c not in (key, "_block", *also)]))).alias("_blocks"),
                                    *[F.max(c).alias(c) for c in also])
    nothing = F.create_map().cast("map<string,string>")
    start = F.struct(F.lit(0).cast("bigint").alias("_n"), F.lit(False).alias("_begun"), *([nothing.alias("extra")] if entries else []),
                     *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])

    def step(state: Column, block: Column) -> Column:
        def opened(f: str) -> Column:
            o = block[f"_open_{f}"]
            return F.when(o.isNotNull() & ~o["sure"] & (state["_begun"] | (o["rn"] > 1)) & ~state[f"_latest_{f}"].eqNullSafe(o["value"]), o["rn"])

        changed, extra = F.array_compact(F.array(*[opened(f) for f in hashed])), []
        if entries:
            new = F.filter(block["_entries"], lambda e: e["first"] & ~e["sure"] & (state["_begun"] | (e["rn"] > 1)) & ~e["name"].isin(list(context))
                           & ~F.try_element_at(state["extra"], e["name"]).eqNullSafe(e["value"]))
            changed = F.concat(changed, F.transform(new, lambda e: e["rn"]))
            last = F.map_from_entries(F.transform(F.filter(block["_entries"], lambda e: e["last"]), lambda e: F.struct(e["name"], e["value"])))
            extra = [F.map_zip_with(state["extra"], last, lambda k, old, now: F.coalesce(now, old)).alias("extra")]
        n = state["_n"] + block["_sure"] + F.size(F.array_distinct(changed))
        values = [F.coalesce(*([block[c], state[c]] if c.startswith("_latest_") else [state[c], block[c]])).alias(c) for c in kinds]
        return F.struct(n.alias("_n"), F.lit(True).alias("_begun"), *extra, *values)

    folded = blocks.select(key, *also, F.explode(F.array(F.aggregate("_blocks", start, step))).alias("_s"))
    return folded.select(key, *also, F.col("_s._n").alias("_n"), *([F.col("_s.extra").alias("extra")] if entries else []),
                         *[F.col(f"_s._latest_{f}").alias(f) for f in latest], *[F.col(f"_s._first_{f}").alias(f) for f in first])


def merge_arrivals(df: DataFrame, key: str, ordinal: str, bucket: Column, fields: Sequence[str]) -> DataFrame:
    """Final state of every key with its version: 1 plus the number of arrivals that changed it."""
    merged = fold_arrivals(df.withColumns({"_block": bucket.cast("bigint"), "_at": F.col(ordinal)}), key, fields, fields)
    return merged.select(key, *fields, (F.col("_n") + 1).alias("version")).withColumn("content_hash", content_hash(fields))


# --- upserts ---------------------------------------------------------------------------------
def resolve_aliases(records: DataFrame, sightings: DataFrame) -> DataFrame:
    """A known (source, external id) keeps its identity even when the computed one changed."""
    known = sightings.groupBy("source_code", "external_id").agg(F.min("identity_key").alias("_known"))
    joined = records.join(known, ["source_code", "external_id"], "left")
    return joined.withColumn("identity_key", F.coalesce("_known", "identity_key")).drop("_known")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, latest: Sequence[str], first: Sequence[str],
           hashed: Sequence[str], as_of: Column) -> DataFrame:
    """Versioned merge of ``incoming`` (one row per key) into ``existing``.

    ``latest`` fields take the new non-empty value, ``first`` fields keep the stored one. The
    version grows only when the hash over ``hashed`` fields changes. The result has an
    ``outcome`` of inserted, updated, unchanged or untouched.
    """
    old = existing.select(key, *[F.col(c).alias(f"_o_{c}") for c in
                                 [*latest, *first, "version", "content_hash", "first_seen_at", "last_seen_at"]],
                          F.lit(True).alias("_old"))
    new = incoming.select(key, *[filled(incoming, c).alias(f"_n_{c}") for c in [*latest, *first]], F.lit(True).alias("_new"))
    both = old.join(new, key, "full_outer")
    values = {c: F.coalesce(f"_n_{c}", f"_o_{c}") for c in latest}
    values.update({c: F.coalesce(f"_o_{c}", f"_n_{c}") for c in first})
    both = both.withColumns(values)
    both = both.withColumn("_hash", F.when(F.col("_new").isNull(), F.col("_o_content_hash")).otherwise(content_hash(hashed)))
    changed = F.col("_old") & F.col("_new") & ~F.col("_hash").eqNullSafe(F.col("_o_content_hash"))
    outcome = (F.when(F.col("_old").isNull(), F.lit("inserted")).when(F.col("_new").isNull(), F.lit("untouched"))
               .when(changed, F.lit("updated")).otherwise(F.lit("unchanged")))
    return both.select(
        key, *[F.col(c) for c in [*latest, *first]], F.col("_hash").alias("content_hash"),
        (F.coalesce("_o_version", F.lit(1)) + F.coalesce(changed, F.lit(False)).cast("int")).cast("bigint").alias("version"),
        F.coalesce("_o_first_seen_at", as_of).alias("first_seen_at"),
        F.when(F.col("_new").isNotNull(), as_of).otherwise(F.col("_o_last_seen_at")).alias("last_seen_at"),
        outcome.alias("outcome"))


def upsert_arrivals(existing: DataFrame, incoming: DataFrame, key: str, ordinal: str, bucket: Column, latest: Sequence[str],
                    first: Sequence[str], hashed: Sequence[str], as_of: Column, context: Sequence[str] = ()) -> DataFrame:
    """Every arrival applied to the stored row in its order, however the arrivals are cut into batches.

    ``latest`` fields follow the newest non-empty value, ``first`` fields keep the oldest, and the map
    ``extra`` takes the newest value of each of its keys. The version grows with every arrival that
    changes a ``hashed`` field or an entry of ``extra`` that is not named in ``context``. ``bucket`` must grow with ``ordinal``; no key is
    gathered. The result has an ``outcome`` of inserted, updated, unchanged or untouched.
    """
    kind = incoming.schema[ordinal].dataType
    turn = F.struct(F.col("_turn").alias("turn"), F.col(ordinal).alias("ordinal"))
    columns = [key, *latest, *first, "extra"]
    fresh = incoming.select(*columns, ordinal, F.lit(1).alias("_turn"), bucket.cast("bigint").alias("_block"),
                            F.lit(None).cast("bigint").alias("_version"), F.lit(None).cast("timestamp_ntz").alias("_first_seen"), F.lit(0).alias("_seed"))
    seeds = existing.select(*columns, F.lit(None).cast(kind).alias(ordinal), F.lit(0).alias("_turn"), F.lit(-(1 << 62)).alias("_block"),
                            F.col("version").alias("_version"), F.col("first_seen_at").alias("_first_seen"), F.lit(1).alias("_seed"))
    keys = incoming.select(key).distinct()
    rows = seeds.join(keys, key, "left_semi").unionByName(fresh).withColumn("_at", turn)

    state = fold_arrivals(rows, key, hashed, latest, first, True, context, ["_version", "_first_seen", "_seed"])
    listed = F.array_sort(F.filter(F.map_entries("extra"), lambda e: ~e["key"].isin(list(context))))
    outcome = F.when(F.col("_seed") == 0, F.lit("inserted")).when(F.col("_n") > 0, F.lit("updated")).otherwise(F.lit("unchanged"))
    merged = state.select(
        key, *latest, *first, "extra", F.sha2(F.to_json(F.struct(*sorted(hashed), listed.alias("extra"))), 256).alias("content_hash"),
        (F.coalesce("_version", F.lit(1)) + F.col("_n")).cast("bigint").alias("version"),
        F.coalesce("_first_seen", as_of).alias("first_seen_at"), as_of.alias("last_seen_at"), outcome.alias("outcome"))
    kept = existing.join(keys, key, "left_anti").withColumn("outcome", F.lit("untouched"))
    return merged.unionByName(kept.select(merged.columns))


def upsert_first_wins(existing: DataFrame, incoming: DataFrame, key: str, ordinal: str, fields: Sequence[str]) -> DataFrame:
    """Organisation rule: stored values are permanent, gaps are filled from the first new value."""
    new = merge_batch(incoming, [key], ordinal, fields).drop("observations")
    renamed = new.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields])
    joined = existing.select(key, *fields).join(renamed, key, "full_outer")
    return joined.select(key, *[F.coalesce(filled(existing, f), F.col(f"_n_{f}")).alias(f)
                                for f in fields])


def _null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return functools.reduce(operator.and_, [a[k].eqNullSafe(b[k]) for k in keys])


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows of ``incoming`` that are new: first row per key, keys not stored yet. NULL equals NULL."""
    fresh = first_rows(incoming, keys, order)
    stored = existing.select(*keys).distinct()
    return fresh.join(stored, _null_safe(fresh, stored, keys), "left_anti")


def add_members(members: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships ``(dataset_id, lead_id, added_at)`` after an insert that ignores what is there, and the number of new ones per dataset."""
    fresh = insert_absent(members, incoming, ["dataset_id", "lead_id"], [F.col("added_at")]).select(*members.columns)
    return members.unionByName(fresh), fresh.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("inserted"))


def dataset_rows(members: DataFrame, leads: DataFrame, bucket: Column) -> DataFrame:
    """The leads of each dataset, numbered by the time they were added; ``bucket`` grows with that time."""
    joined = members.join(leads, "lead_id")
    return number_rows(joined, ["dataset_id"], bucket, [F.col("added_at"), F.col("lead_id")], "position")


def upsert_sightings(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("source_code", "external_id")) -> DataFrame:
    """Latest ``seen_at`` per sighting, the newest known URL is kept, the lead stays the first one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    position = F.struct("_new", "seen_at")
    return both.groupBy(*keys).agg(
        F.min_by("lead_id", F.struct("_new", "seen_at", "lead_id")).alias("lead_id"), F.max("seen_at").alias("seen_at"),
        F.max_by("source_url", F.when(present(F.col("source_url")), position)).alias("source_url"))


def find_or_create(existing: DataFrame, wanted: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Existing rows plus one created row per wanted key that is missing."""
    created = insert_absent(existing, wanted, [key], order)
    return existing.withColumn("created", F.lit(False)).unionByName(
        created.select(*existing.columns).withColumn("created", F.lit(True)))


def valid_reference(df: DataFrame, column: str, dimension: DataFrame, code: str, target: str) -> DataFrame:
    """Replace a code by the id of a dimension, case-insensitively; an unknown code becomes NULL."""
    lookup = dimension.groupBy(F.lower(code).alias("_code")).agg(F.min(target).alias("_target"))
    joined = df.join(lookup, F.lower(df[column]) == F.col("_code"), "left")
    return joined.withColumn(column, F.col("_target")).drop("_code", "_target")


# --- accounting ------------------------------------------------------------------------------
def batch_outcomes(records: DataFrame, upserted: DataFrame, key: str, run: str) -> DataFrame:
    """Inserted, updated, unchanged and skipped per run. Repeats inside a batch count as unchanged."""
    per_key = records.groupBy(run, key).agg(F.count(F.lit(1)).alias("_n"))
    joined = per_key.join(upserted.select(key, "outcome"), key, "left")
    has_key = F.col(key).isNotNull()

    def counted(test: Column, value: Column | int = 1) -> Column:
        return F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("bigint")

    return joined.groupBy(run).agg(
        counted(F.col("outcome") == "inserted").alias("inserted"), counted(F.col("outcome") == "updated").alias("updated"),
        counted(has_key, F.col("_n") - F.when(F.col("outcome") == "unchanged", 0).otherwise(1)).alias("unchanged"),
        counted(~has_key, F.col("_n")).alias("skipped"))


def run_rollup(outcomes: DataFrame, target: Column, cancelled: Column | None = None) -> DataFrame:
    """Counters and final state of a run."""
    off = F.lit(False)
    failed = F.col("failed") if "failed" in outcomes.columns else F.lit(0)
    saved = F.col("inserted") + F.col("updated") + F.col("unchanged")
    return outcomes.withColumns({
        "verified": saved, "duplicates": F.col("updated") + F.col("unchanged"), "errors": failed + F.col("skipped"),
        "status": job_outcome(cancelled=off if cancelled is None else cancelled, captcha_timeout=off, saved=saved,
                              target=target, source_error=off, failed=failed, skipped=F.col("skipped"))})


# --- directory listings, locations, people ---------------------------------------------------
def merge_listings(rows: DataFrame, key: str, ordinal: str, fill: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """One company per id from repeated listing rows.

    Gaps are filled from later rows, the longest name wins and other spellings are kept as
    aliases, the first phone and email stay the main ones, the longest URL wins and list
    columns are united.
    """
    at = F.col(ordinal)

    def first_filled(name: str) -> Column:
        return F.min_by(F.col(name), F.when(present(F.col(name)), F.struct(at.alias("at"), F.col(name).alias("v"))))

    def longest(name: str) -> Column:
        """Of values of equal length the one listed first, then the smaller one."""
        rank = F.struct((-F.length(name)).alias("n"), at.alias("at"), F.col(name).alias("v"))
        return F.min_by(F.col(name), F.when(present(F.col(name)), rank))

    merged = rows.groupBy(key).agg(
        *[first_filled(c).alias(c) for c in fill], first_filled("phone").alias("phone"), first_filled("email").alias("email"),
        longest("name").alias("name"), longest("url").alias("url"),
        F.collect_set("name").alias("_names"), F.collect_set("phone").alias("_phones"), F.collect_set("email").alias("_emails"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists],
        F.count(F.lit(1)).alias("listed_rows"))

    def others(values: str, main: str) -> Column:
        return F.array_sort(F.filter(values, lambda v: (v != F.col(main)) & (v != "")))

    return merged.withColumns({"name_aliases": others("_names", "name"), "extra_phones": others("_phones", "phone"),
                               "extra_emails": others("_emails", "email")}).drop("_names", "_phones", "_emails")


def merge_locations(rows: DataFrame, owner: str, ordinal: str, fields: Sequence[str]) -> DataFrame:
    """Locations of an owner by normalised address, else phone, else label; the main flag is OR-ed."""
    address = blank_to_null(F.regexp_replace(F.lower("address"), "[^a-z0-9]", ""))
    keyed = rows.withColumn("location_key", F.coalesce(address, blank_to_null(F.col("phone")), F.lower("label")))
    picks = [F.min_by(F.col(f), F.when(present(F.col(f)), F.col(ordinal))).alias(f) for f in fields]
    return keyed.groupBy(owner, "location_key").agg(*picks, F.bool_or("is_main").alias("is_main"))


_PEOPLE_SCHEMA = ("company_id bigint, person_key string, name string, title string, phone string, email string, "
                  "extra_phones array<string>, extra_emails array<string>, first_seen bigint")
_PEOPLE_ARROW = pa.schema([("company_id", pa.int64()), ("person_key", pa.string()), ("name", pa.string()), ("title", pa.string()),
                           ("phone", pa.string()), ("email", pa.string()), ("extra_phones", pa.list_(pa.string())),
                           ("extra_emails", pa.list_(pa.string())), ("first_seen", pa.int64())])


def _first_fit(batches):
    """Put every candidate into the first compatible entry of its person.

    Rows arrive sorted by person and first sight, so only the entries of one person are held.
    """
    columns = ["company_id", "person_key", "name", "title", "phone", "email", "extra_phones", "extra_emails", "first_seen"]
    group, people = None, []

    def fits(entry: dict, phone: str, email: str) -> bool:
        same_phone, same_email = entry["phone"] == phone, entry["email"].lower() == email.lower()
        if (phone and same_phone) or (email and same_email):
            return True
        return not (phone and entry["phone"] and not same_phone) and not (email and entry["email"] and not same_email)

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if (row["company_id"], row["person_key"]) != group:
                done += people
                group, people = (row["company_id"], row["person_key"]), []
            new = {"phone": row["phone"] or "", "email": row["email"] or ""}
            home = next((p for p in people if fits(p, **new)), None)
            if home is None:
                people.append({**row, **new, "extra_phones": [], "extra_emails": []})
                continue
            home["title"] = home["title"] or row["title"]
            for field, value in new.items():
                known = home[f"extra_{field}s"]
                if not home[field]:
                    home[field] = value
                elif value and value.lower() != home[field].lower() and value not in known:
                    known.append(value)
        if done:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in done], schema=_PEOPLE_ARROW)
    if people:
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in people], schema=_PEOPLE_ARROW)


def merge_people(candidates: DataFrame) -> DataFrame:
    """Entries per company and person name; only compatible contact data is put together.

    Which entry a candidate joins depends on the order, so the last step goes through the
    candidates of a person one by one. An exact repeat belongs to the entry of its first copy,
    so equal (name, phone, email) candidates are combined by an aggregation before that, and
    what is left per person is its distinct contact data, however many rows there were.
    """
    at = F.col("ordinal")
    spelled = candidates.filter(present(F.col("name"))).groupBy("company_id", "name", "phone", "email").agg(
        F.min("ordinal").alias("ordinal"), F.min_by("title", F.when(present(F.col("title")), at)).alias("title"))
    keyed = spelled.withColumn("person_key", normalize_person_name(F.col("name")))
    distinct = keyed.groupBy("company_id", "person_key", "phone", F.lower("email").alias("_mail")).agg(
        F.min("ordinal").alias("first_seen"), F.min_by("name", at).alias("name"), F.min_by("email", at).alias("email"),
        F.min_by("title", F.when(present(F.col("title")), at)).alias("title")).drop("_mail")
    columns = ["company_id", "person_key", "name", "title", "phone", "email", "first_seen"]
    ordered = distinct.select(*columns).repartition("company_id", "person_key").sortWithinPartitions("company_id", "person_key", "first_seen")
    return ordered.mapInArrow(_first_fit, _PEOPLE_SCHEMA)


def person_rows(companies: DataFrame, people: DataFrame) -> DataFrame:
    """One row per (company, person): direct phone before company phone; the company email stands in
    only where the company has one person. A company without people keeps one blank-person row."""
    single = people.groupBy("company_id").agg(F.count(F.lit(1)).alias("_people"))
    merged = people.groupBy("company_id", "person_key").agg(
        F.min_by("name", "first_seen").alias("person"), F.min_by("title", F.when(present(F.col("title")), F.col("first_seen"))).alias("title"),
        F.min_by("phone", F.when(present(F.col("phone")), F.col("first_seen"))).alias("direct_phone"),
        F.min_by("email", F.when(present(F.col("email")), F.col("first_seen"))).alias("direct_email"))
    joined = companies.join(merged, "company_id", "left").join(single, "company_id", "left")
    return joined.select(
        "company_id", "person", "title",
        F.coalesce(blank_to_null(F.col("direct_phone")), F.col("company_phone")).alias("phone"),
        F.when(present(F.col("direct_phone")), F.lit("direct")).when(present(F.col("company_phone")), F.lit("company")).alias("phone_source"),
        F.coalesce(blank_to_null(F.col("direct_email")), F.when(F.coalesce("_people", F.lit(0)) <= 1, F.col("company_email"))).alias("email"))


# --- the whole store -------------------------------------------------------------------------
@dataclasses.dataclass
class LeadStore:
    """The canonical tables one ingest run reads and writes."""

    leads: DataFrame
    organizations: DataFrame
    contacts: DataFrame
    emails: DataFrame
    phones: DataFrame
    locations: DataFrame
    lead_sources: DataFrame
    dataset_records: DataFrame


STORE_SCHEMAS: Mapping[str, str] = {
    "leads": "identity_key string, record_kind string, title string, description string, category string, city string, "
             "us_state string, email string, phone string, website string, organization_name string, contact_name string, "
             "due_at timestamp_ntz, contact_id string, run_id string, source_url string, org_id string, source_code string, "
             "department_id string, dataset_id string, extra map<string,string>, content_hash string, version bigint, "
             "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz",
    "organizations": "dedup_key string, name string, website string, domain string, industry string",
    "contacts": "org_id string, full_name_key string, full_name string, title string",
    "emails": "email string, org_id string, contact_key string, email_type string",
    "phones": "phone string, org_id string, contact_key string, phone_type string",
    "locations": "org_id string, city string, state string, postal_code string, country string",
    "lead_sources": "source_code string, external_id string, identity_key string, source_url string, seen_at timestamp_ntz",
    "dataset_records": "dataset_id string, identity_key string",
}
CONTENT_FIELDS = ["title", "description", "category", "city", "us_state", "email", "phone", "website", "organization_name", "contact_name", "due_at"]
# The links of a lead to its contact and to the last run follow the newest arrival; organisation, source, department and
# dataset stay those of the first that has one.
LATEST_FIELDS = ["record_kind", *CONTENT_FIELDS, "contact_id", "run_id", "source_url"]
FIRST_FIELDS = ["org_id", "source_code", "department_id", "dataset_id"]
# Search context, links and the URL do not make a record a different one.
HASHED_FIELDS = CONTENT_FIELDS
CONTEXT_ENTRIES = ["search_keyword", "search_location", "source_url"]
LINKS = ["run_id", "department_id", "dataset_id"]  # columns that the caller of an ingest may add


STORE_KEYS: Mapping[str, Sequence[str]] = {
    "leads": ["identity_key"], "organizations": ["dedup_key"], "contacts": ["org_id", "full_name_key"],
    "emails": ["email", "org_id", "contact_key"], "phones": ["phone", "org_id", "contact_key"],
    "locations": ["org_id", "city", "state"], "lead_sources": ["source_code", "external_id"],
    "dataset_records": ["dataset_id", "identity_key"]}


def contact_link(org_id: Column, full_name_key: Column) -> Column:
    """How a lead names a row of the contacts."""
    return joined_hash(F.coalesce(org_id, F.lit("")), full_name_key)


def resolved_rows(sightings: DataFrame, records: DataFrame) -> DataFrame:
    """All ingest rows with their identity, organisation and links. ``sightings`` needs the known ones of these records only."""
    known = sightings.select("source_code", "external_id", "identity_key")
    contact_key = F.lower(F.trim("contact_name"))
    return resolve_aliases(records, known).withColumns({
        "org_id": F.col("org_dedup"), "email": F.coalesce("norm_email", "email"),
        "phone": F.coalesce("norm_phone", "phone"), "us_state": F.coalesce("norm_state", "us_state"),
        "contact_id": F.when(present(F.col("contact_name")), contact_link(F.col("org_dedup"), contact_key)),
        **{c: F.col(c).cast("string") if c in records.columns else F.lit(None).cast("string") for c in LINKS}})


def arriving_rows(rows: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """For each table of the store the resolved rows that arrive, with its keys."""
    identified = rows.filter(F.col("identity_key").isNotNull())
    contact_key = F.lower(F.trim("contact_name"))
    placed = F.coalesce("city", "us_state", "postal_code").isNotNull()
    return {
        "leads": identified,
        "organizations": identified.filter(F.col("org_id").isNotNull()).select(
            F.col("org_id").alias("dedup_key"), F.col("organization_name").alias("name"), "website",
            F.col("norm_domain").alias("domain"), F.col("category").alias("industry"), "ordinal"),
        "contacts": identified.filter(present(F.col("contact_name"))).select(
            "org_id", contact_key.alias("full_name_key"), F.trim("contact_name").alias("full_name"), F.col("contact_title").alias("title"), "ordinal"),
        "emails": identified.filter(F.col("norm_email").isNotNull()).select(
            F.col("norm_email").alias("email"), "org_id", contact_key.alias("contact_key"), "email_type", "ordinal"),
        "phones": identified.filter(F.col("norm_phone").isNotNull()).select(
            F.col("norm_phone").alias("phone"), "org_id", contact_key.alias("contact_key"), "phone_type", "ordinal"),
        "locations": identified.filter(placed).select(
            "org_id", "city", F.col("us_state").alias("state"), "postal_code", "country", "ordinal"),
        "lead_sources": identified.filter(F.col("source_code").isNotNull() & F.col("external_id").isNotNull()).select(
            "source_code", "external_id", F.col("identity_key").alias("lead_id"), "source_url", as_of.alias("seen_at")),
        "dataset_records": identified.filter(F.col("dataset_id").isNotNull()).select("dataset_id", "identity_key", "ordinal")}


def upsert_store(store: LeadStore, records: DataFrame, as_of: Column, merge: str = "arrival") -> tuple[LeadStore, DataFrame]:
    """Upsert ingest rows (see ``ingest_fields``) into all tables; returns the new tables and outcomes.

    ``merge`` says how repeated observations inside this batch are combined: ``batch`` keeps the
    first non-empty value, ``arrival`` the latest. The tables may be parts of a larger store, if they
    hold all rows stored under the keys of the records.
    """
    rows = resolved_rows(store.lead_sources, records)
    leads, new_store = upsert_arriving(store, arriving_rows(rows, as_of), as_of, merge)
    return new_store, batch_outcomes(rows.withColumn("run", F.lit("run")), leads, "identity_key", "run")


def upsert_arriving(store: LeadStore, arriving: Mapping[str, DataFrame], as_of: Column, merge: str = "arrival") -> tuple[DataFrame, LeadStore]:
    """The same for rows that ``arriving_rows`` has made; returns the leads with their outcomes, and the new tables."""
    identified = arrivals = arriving["leads"]
    if merge == "batch":  # the batch is one arrival, made of the first non-empty values
        fields = [*LATEST_FIELDS, *FIRST_FIELDS]
        extra = merge_maps(identified, ["identity_key"], "ordinal", "extra")
        arrivals = merge_batch(identified, ["identity_key"], "ordinal", fields).join(extra, "identity_key", "left").select(
            "identity_key", *fields, F.coalesce("extra", F.create_map().cast("map<string,string>")).alias("extra"), F.lit(0).cast("bigint").alias("ordinal"))
    leads = upsert_arrivals(store.leads, arrivals, "identity_key", "ordinal", block_bucket(F.col("ordinal")), LATEST_FIELDS, FIRST_FIELDS, HASHED_FIELDS, as_of, CONTEXT_ENTRIES)
    organizations = upsert_first_wins(store.organizations, arriving["organizations"], "dedup_key", "ordinal", ["name", "website", "domain", "industry"])

    def grown(name: str) -> DataFrame:
        table = getattr(store, name)
        fresh = insert_absent(table, arriving[name], STORE_KEYS[name], [F.col("ordinal")])
        return table.unionByName(fresh.select(*table.columns))

    seen = arriving["lead_sources"]
    stored = store.lead_sources.withColumnRenamed("identity_key", "lead_id").select(*seen.columns)
    sightings = upsert_sightings(stored, seen).withColumnRenamed("lead_id", "identity_key")
    return leads, LeadStore(leads.drop("outcome"), organizations, grown("contacts"), grown("emails"), grown("phones"), grown("locations"),
                            sightings.select(*store.lead_sources.columns), grown("dataset_records"))
