"""Visibility, account purges, retention and ancestor chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def visible_ids(paths: Sequence[DataFrame]) -> DataFrame:
    """Distinct union of the (owner, id) pairs of several link paths."""
    result = paths[0]
    for path in paths[1:]:
        result = result.unionByName(path)
    return result.distinct()


def scope_rows(rows: DataFrame, visible: DataFrame, key: str, user: object, is_admin: bool = False) -> DataFrame:
    """Rows a user may see. Administrators see all, without a user nothing is visible."""
    if is_admin:
        return rows
    if user is None:
        return rows.filter(F.lit(False))
    return rows.join(visible.filter(F.col("user_id") == F.lit(user)).select(key).distinct(), key, "left_semi")


def exclusive_ids(candidates: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """Candidate ids that nothing retained refers to."""
    return candidates.select(key).distinct().join(shared.select(key).distinct(), key, "left_anti")


def purge_closure(users: DataFrame, requests: DataFrame, jobs: DataFrame, datasets: DataFrame, members: DataFrame,
                  deliveries: DataFrame, removed: DataFrame) -> dict[str, DataFrame]:
    """Ids that disappear with the removed users, per table. What a retained user shares stays."""
    gone_users = users.join(removed, "user_id", "left_semi").select("user_id")
    gone_requests = requests.join(gone_users, "user_id", "left_semi").select("request_id", "job_id")
    kept_requests = requests.join(gone_users, "user_id", "left_anti").select("request_id", "job_id")
    linked = jobs.join(gone_users.withColumnRenamed("user_id", "created_by"), "created_by", "left_semi").select("job_id").unionByName(
        gone_requests.select("job_id").filter(F.col("job_id").isNotNull()))
    gone_jobs = exclusive_ids(linked, kept_requests.filter(F.col("job_id").isNotNull()), "job_id")
    owned = datasets.join(gone_users.withColumnRenamed("user_id", "created_by"), "created_by", "left_semi").select("dataset_id")
    by_job = jobs.join(gone_jobs, "job_id", "left_semi").select("dataset_id").filter(F.col("dataset_id").isNotNull())
    kept_jobs = jobs.join(kept_requests.select("job_id"), "job_id", "left_semi").filter(F.col("dataset_id").isNotNull())
    gone_datasets = exclusive_ids(owned.unionByName(by_job), kept_jobs, "dataset_id")
    candidates = members.join(gone_datasets, "dataset_id", "left_semi").select("lead_id")
    elsewhere = members.join(gone_datasets, "dataset_id", "left_anti").select("lead_id")
    delivered = deliveries.join(gone_requests.select("request_id"), "request_id", "left_anti").select("lead_id")
    gone_leads = exclusive_ids(candidates, elsewhere.unionByName(delivered), "lead_id")
    return {"users": gone_users, "requests": gone_requests.select("request_id"), "jobs": gone_jobs,
            "datasets": gone_datasets, "leads": gone_leads}


def purge_report(closure: dict[str, DataFrame]) -> DataFrame:
    """Dry run: how many rows of each table would go."""
    from .reports import entity_totals

    return entity_totals(closure)


def survivors(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone, key, "left_anti")


def root_ancestors(nodes: DataFrame, node: str = "id", parent: str = "parent_id", is_root: str = "is_root") -> DataFrame:
    """Nearest root above every node, NULL when the chain ends without one or runs in a circle.

    Pointer doubling: after ``n`` rounds every chain of up to ``2**n`` steps is resolved. Each
    round is one equi-join; its result is checkpointed, so neither plan nor lineage grows. A
    round that resolves nothing means that only circles are left.
    """
    state = nodes.select(
        F.col(node).alias("n"), F.when(F.col(is_root), F.col(node)).alias("root"),
        F.when(~F.col(is_root), F.col(parent)).alias("up"))
    state = cut_lineage(state)
    open_before = None
    while True:
        pending = state.filter(F.col("root").isNull() & F.col("up").isNotNull()).count()
        if pending == 0 or pending == open_before:
            break
        open_before = pending
        above = state.select(F.col("n").alias("up"), F.col("root").alias("_root"), F.col("up").alias("_up"))
        waiting = F.col("root").isNull() & F.col("up").isNotNull()
        done = state.filter(~waiting)
        moved = state.filter(waiting).join(above, "up", "left").select(
            "n", F.col("_root").alias("root"), F.when(F.col("_root").isNull(), F.col("_up")).alias("up"))
        state = cut_lineage(done.select("n", "root", "up").unionByName(moved))
    return state.select(F.col("n").alias(node), F.col("root").alias("root_id"))


def retain_since(rows: DataFrame, ts: str, cutoff, dependents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows not older than the cutoff, and the dependent rows that still have one of them."""
    kept = rows.filter(F.col(ts) >= cutoff)
    return kept, dependents.join(kept.select(key).distinct(), key, "left_semi")
