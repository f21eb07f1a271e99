"""Lead priority, completion percentages, decisions and outcome rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import constant_map, present

FINISHED = ("Completed", "Partial", "Failed", "Cancelled")  # states that a job ends in


def lead_priority(email: Column, phone: Column, city: Column, profile_url: Column) -> Column:
    score = (F.when(present(email), 2).otherwise(0) + F.when(present(phone), 2).otherwise(0)
             + F.when(present(city), 1).otherwise(0) + F.when(present(profile_url), 1).otherwise(0))
    return F.when(score >= 5, F.lit("High")).when(score >= 3, F.lit("Medium")).otherwise(F.lit("Low"))


def completion_percentage(found: Column, wanted: Column) -> Column:
    return F.least(F.lit(100), F.floor(found * 100 / F.greatest(F.coalesce(wanted, F.lit(1)), F.lit(1)))).cast("int")


def job_progress(found: Column, limit: Column) -> Column:
    return F.least(F.lit(99), F.floor(found * 100 / F.greatest(F.coalesce(limit, F.lit(1)), F.lit(1)))).cast("int")


def decision(explicit: Column, search_sufficient: Column, has_search: Column, has_hits: Column, has_trace: Column) -> Column:
    return (
        F.when(present(explicit), explicit)
        .when(F.coalesce(search_sufficient, F.lit(False)), F.lit("DB"))
        .when(has_hits & ~has_search, F.lit("KB"))
        .when(has_trace, F.lit("CLARIFY"))
        .otherwise(F.lit("NONE"))
    )


def canonical_decision(code: Column) -> Column:
    """Upper case, older spellings folded into the current codes; blank is NULL."""
    upper = F.upper(code)
    return F.when(present(code), F.coalesce(F.try_element_at(constant_map(V.OLD_DECISION_CODES), upper), upper))


def job_outcome(*, cancelled: Column, captcha_timeout: Column, saved: Column, target: Column,
                source_error: Column, failed: Column, skipped: Column) -> Column:
    """Final state of a collection job; the first rule that applies decides."""
    return (
        F.when(cancelled, F.lit("Cancelled"))
        .when(captcha_timeout, F.lit("Failed"))
        .when(saved == 0, F.lit("Failed"))
        .when((F.coalesce(target, F.lit(0)) > 0) & (saved < target) & ~source_error, F.lit("Partial"))
        .when((failed > 0) | (skipped > 0) | source_error, F.lit("Partial"))
        .otherwise(F.lit("Completed"))
    )
