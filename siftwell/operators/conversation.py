"""Conversation windows: bounded history, complete tool exchanges, carried criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import block_bucket, carry_forward, running_sum


def message_size(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 3)).cast("bigint")


def bounded_history(messages: DataFrame, key: str, turn: str, role: str, text: str, budget: int) -> DataFrame:
    """Newest messages whose sizes fit the budget, beginning with a user turn.

    When nothing fits, the last user message is kept, cut to its last ``budget * 3`` characters.
    """
    spoken = messages.filter(F.col(role) != "system")
    back = -F.col(turn)
    used = running_sum(spoken, [key], block_bucket(back), [back], {"_used": message_size(F.col(text))})
    fits = used.filter(F.col("_used") <= budget)
    starts = fits.groupBy(key).agg(F.min(F.when(F.col(role) == "user", F.col(turn))).alias("_start"))
    kept = fits.join(starts, key).filter(F.col(turn) >= F.col("_start"))
    users = spoken.filter(F.col(role) == "user")
    last_user = users.groupBy(key).agg(F.max_by(F.struct(turn, role, text), F.col(turn)).alias("m"))
    empty = last_user.join(starts.filter(F.col("_start").isNotNull()).select(key), key, "left_anti").select(
        key, F.col(f"m.{turn}"), F.col(f"m.{role}"), F.right(F.col(f"m.{text}"), F.lit(budget * 3)).alias(text))
    return kept.select(key, turn, role, text).unionByName(empty)


def summary_candidates(messages: DataFrame, history: DataFrame, key: str, turn: str, text: str, trigger: int,
                       last: int = 30, cut: int = 1000) -> DataFrame:
    """Messages to summarise: older than the kept history, at most the last ``last``, each cut short,
    in conversations longer than ``trigger``."""
    counts = messages.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    begin = history.groupBy(key).agg(F.min(turn).alias("_begin"))
    older = messages.join(counts.filter(F.col("_n") > trigger), key).join(begin, key).filter(F.col(turn) < F.col("_begin"))
    back = -F.col(turn)
    numbered = running_sum(older, [key], block_bucket(back), [back], {"_back": F.lit(1)})
    return numbered.filter(F.col("_back") <= last).select(key, turn, F.substring(F.col(text), 1, cut).alias(text))


def complete_exchanges(messages: DataFrame, key: str, position: str, is_result: Column, calls: Column, call_id: Column) -> DataFrame:
    """Drop tool results without their call, and calls whose results are not complete.

    ``calls`` is the array of call ids a message makes (empty for plain messages), ``call_id``
    the id a result row answers. Results directly follow their call.
    """
    marked = messages.withColumns({"_result": is_result, "_calls": calls, "_answer": F.when(is_result, call_id)})
    head = F.when(F.col("_result"), 0).otherwise(1)
    segments = running_sum(marked, [key], block_bucket(F.col(position)), [F.col(position)], {"_segment": head})
    verdict = segments.groupBy(key, "_segment").agg(
        F.max_by("_calls", F.when(~F.col("_result"), F.col(position))).alias("_asked"),
        F.collect_set("_answer").alias("_answers"))
    complete = F.array_sort("_answers").eqNullSafe(F.array_sort("_asked"))
    plain = F.size("_asked") == 0
    judged = segments.join(verdict, [key, "_segment"])
    keep = F.when(plain, ~F.col("_result")).otherwise(complete)
    return judged.filter(F.coalesce(keep, F.lit(False))).select(*messages.columns)


def carry_criteria(turns: DataFrame, key: str, order: Column, bucket: Column, category: str, kind: str, others: list[str]) -> DataFrame:
    """Criteria of follow-up turns: unspecified values are taken from the turns before.

    A different category or record kind starts anew. The text ``any`` clears a value.
    """
    fields = [category, kind, *others]
    before = carry_forward(turns, [key], bucket, [order], {f"_c_{f}": F.col(f) for f in (category, kind)}, before="_p")

    def switched(name: str) -> Column:
        return F.coalesce(F.col(name) != F.col("_p")[f"_c_{name}"], F.lit(False))

    flagged = before.withColumn("_switch", (switched(category) | switched(kind)).cast("int"))
    segments = running_sum(flagged, [key], bucket, [order], {"segment": F.col("_switch")})
    merged = carry_forward(segments, [key, "segment"], bucket, [order], {f: F.col(f) for f in fields})
    return merged.withColumns({f: F.nullif(F.col(f), F.lit("any")) for f in fields}).select(*turns.columns, "segment")


def carry_label(lines: DataFrame, key: str, position: str, label: Column, name: str) -> DataFrame:
    """The latest heading at or above every line."""
    return carry_forward(lines, [key], block_bucket(F.col(position)), [F.col(position)], {name: label})
