"""Frozen deliveries, fulfilment, completions and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import joined_hash
from ..functions.scoring import FINISHED
from .govern import root_ancestors
from .ordered import number_rows


def delivery_ranks(records: DataFrame, request: str, lead: str, position: Column, bucket_of) -> DataFrame:
    """Zero-based rank of every delivered record.

    A record that occurs twice keeps its first position and its last values. ``bucket_of`` maps
    the first position to an increasing bucket, so one very large delivery is ranked in pieces.
    """
    rest = [c for c in records.columns if c not in (request, lead)]
    unique = records.groupBy(request, lead).agg(
        F.min(position).alias("_first"), F.max_by(F.struct(*rest), position).alias("_row"))
    ranked = number_rows(unique, [request], bucket_of(F.col("_first")), [F.col("_first"), F.col(lead)], "rank")
    return ranked.select(request, lead, (F.col("rank") - 1).alias("rank"), *[F.col("_row")[c].alias(c) for c in rest])


def new_deliveries(requests: DataFrame, ranked: DataFrame, request: str) -> DataFrame:
    """Rows to append: only requests that were not served yet."""
    return ranked.join(requests.filter(F.col("served_at").isNotNull()).select(request), request, "left_anti")


def stale_rows(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of an unserved earlier attempt that the new attempt no longer contains."""
    return previous.join(current.select(*keys).distinct(), list(keys), "left_anti")


def completion_target(quantity: Column, new_only: Column, served_at: Column, returned: Column) -> Column:
    """Wanted rows, less what a served new-only request already returned."""
    initial = F.when(new_only & served_at.isNotNull(), F.coalesce(returned, F.lit(0))).otherwise(F.lit(0))
    return F.greatest(F.lit(0), quantity - initial)


def fulfilment(requests: DataFrame, matches: DataFrame, request: str) -> DataFrame:
    """Matching count, target, remaining and whether the request is fulfilled."""
    counts = matches.groupBy(request).agg(F.count_distinct("lead_id").alias("matching"))
    target = completion_target(F.col("quantity"), F.col("new_only"), F.col("served_at"), F.col("records_returned"))
    joined = requests.join(counts, request, "left").withColumns(
        {"matching": F.coalesce("matching", F.lit(0)), "target": target.cast("bigint")})
    cancelled = F.coalesce(F.col("cancelled"), F.lit(False)) if "cancelled" in requests.columns else F.lit(False)
    return joined.withColumns({
        "remaining": F.greatest(F.lit(0), F.col("target") - F.col("matching")).cast("bigint"),
        "fulfilled": ~cancelled & (F.col("matching") >= F.col("target"))})


def completion_events(jobs: DataFrame, requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Exactly one event per finished job and subscribed request; a rerun adds nothing."""
    done = jobs.filter(F.col("status").isin(*FINISHED)).select(
        "job_id", F.col("status").alias("job_status"))
    asked = requests.filter(F.coalesce("kind", F.lit("request")).isin("confirmation", "event") == F.lit(False))
    events = asked.join(done, "job_id")
    if existing is not None:  # by what the id is made of, which is shorter than the id
        there = existing.select(F.col("job_id").alias("_job"), F.col("request_id").alias("_request"))
        events = events.join(there, (F.col("job_id") == F.col("_job")) & F.col("request_id").eqNullSafe(F.col("_request")), "left_anti")
    return events.withColumn("event_id", joined_hash(F.col("job_id"), F.col("request_id")))


def resolved_completions(jobs: DataFrame, requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``(request_id, job_id, status, event_id)``: one completion per finished job and original request.

    ``requests(session_id, request_id, parent_id, follow_up, job_id)``: a follow-up that subscribes to a
    job speaks for the request at the root of its chain; requests without session and chains without an
    original give nothing. Completions in ``existing`` are not repeated.
    """
    roots = root_ancestors(requests.withColumn("_original", ~F.col("follow_up")), "request_id", "parent_id", "_original")
    done = jobs.filter(F.col("status").isin(*FINISHED)).select("job_id", "status")
    asked = requests.filter(F.col("job_id").isNotNull() & F.col("session_id").isNotNull()).select("request_id", "job_id")
    found = asked.join(roots.filter(F.col("root_id").isNotNull()), "request_id").join(done, "job_id").select(
        F.col("root_id").alias("request_id"), "job_id", "status").distinct()
    events = found.withColumn("event_id", joined_hash(F.col("job_id"), F.col("request_id")))
    return events.join(existing.select("event_id"), "event_id", "left_anti").select(events.columns) if existing is not None else events


def completion_rows(requests: DataFrame, matches: DataFrame, served: DataFrame, bucket: Column) -> DataFrame:
    """The rows a completion delivers: ``(request_id, lead_id, position)``.

    ``requests(request_id, quantity, new_only, served_at, records_returned)``, ``matches(request_id,
    lead_id, place)``. A request for new records only leaves out the rows it was served before
    (``served(request_id, lead_id)``), also if they have changed since, and asks for what is still wanted.
    ``bucket`` must grow with ``place``.
    """
    target = completion_target(F.col("quantity"), F.col("new_only"), F.col("served_at"), F.col("records_returned"))
    wanted = requests.select("request_id", "new_only", target.alias("_target"))
    before = served.select("request_id", "lead_id").distinct().withColumn("_served", F.lit(True))
    fresh = matches.join(wanted, "request_id").join(before, ["request_id", "lead_id"], "left").filter(
        (F.col("_target") > 0) & ~(F.col("new_only") & F.col("_served").isNotNull()))
    numbered = number_rows(fresh, ["request_id"], bucket, [F.col("place"), F.col("lead_id")], "position")
    return numbered.filter(F.col("position") <= F.col("_target")).select("request_id", "lead_id", "position")


def user_deliveries(requests: DataFrame, bucket: Column, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of deliveries per user, newest first, with the user's total.

    ``bucket`` must grow with age, for instance the negated day.
    """
    shown = requests.filter(F.col("served_at").isNotNull() & ~F.coalesce("cancelled", F.lit(False))
                            & ((F.col("records_returned") > 0) | F.coalesce(F.col("kind") == "event", F.lit(False))))
    totals = shown.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    shown = shown.withColumn("_back", -F.unix_micros(F.col("served_at").cast("timestamp")))
    numbered = number_rows(shown, ["user_id"], bucket, [F.col("_back"), F.col("request_id")], "position")
    first = (page - 1) * page_size
    return numbered.filter((F.col("position") > first) & (F.col("position") <= first + page_size)).join(totals, "user_id").drop("_back")


def spreadsheet_safe(c: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets a leading apostrophe; NULL becomes empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def export_columns(df: DataFrame, columns: dict[str, Column], safe: bool = False) -> DataFrame:
    """Fixed export columns as text, NULL as empty."""
    def cell(c: Column) -> Column:
        return spreadsheet_safe(c) if safe else F.coalesce(c.cast("string"), F.lit(""))

    return df.select(*[cell(c).alias(n) for n, c in columns.items()])
