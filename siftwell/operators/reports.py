"""Counts, funnels, roll-ups and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import DECISION_CODES
from ..functions.scoring import canonical_decision


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def decision_histogram(requests: DataFrame, column: str = "decision") -> DataFrame:
    """All known codes, zero where unused, older spellings folded in, unknown codes added."""
    counted = requests.groupBy(canonical_decision(F.col(column)).alias("decision")).agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("decision").isNotNull())
    frame = requests.sparkSession.createDataFrame([(c, 0) for c in DECISION_CODES], "decision string, n bigint")
    return counted.unionByName(frame).groupBy("decision").agg(F.sum("n").alias("n"))


def entity_totals(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in tables.items()]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def top_groups(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    return counts_by(df, column).orderBy(F.col("n").desc(), F.col(column)).limit(k)


def percent_half_up(part: Column, whole: Column) -> Column:
    """Whole percent rounded half up, in integer arithmetic; NULL for an empty whole."""
    return F.when(whole > 0, F.floor((part * 200 + whole) / (whole * 2))).cast("bigint")


def kpi_cards(leads: DataFrame, status: str = "status") -> DataFrame:
    s = F.col(status)
    return leads.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "New").alias("generated"), F.count_if(s == "Called").alias("called"),
        F.count_if(s == "Emailed").alias("emailed"), F.count_if(s == "Interested").alias("interested"), F.count_if(s == "Pending").alias("pending"))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Stage counts with their share of all rows and of the stage before. Empty stages stay zero."""
    counted = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(test).alias(f"s{i}") for i, (_, test) in enumerate(stages)])
    rows = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"s{i}").alias("n"))
                     for i, (name, _) in enumerate(stages)])
    table = counted.select("_total", F.inline(rows))
    before = F.lag("n").over(W.orderBy("stage_no"))  # a handful of stage rows
    return table.select("stage_no", "stage", "n", percent_half_up(F.col("n"), F.col("_total")).alias("percent_of_total"),
                        percent_half_up(F.col("n"), before).alias("percent_of_previous"))


def department_rollup(leads: DataFrame, department: str, status: str = "status") -> DataFrame:
    s = F.col(status)
    table = leads.groupBy(department).agg(
        F.count(F.lit(1)).alias("assigned"), F.count_if(s == "Called").alias("called"), F.count_if(s == "Emailed").alias("emailed"),
        F.count_if(s == "Interested").alias("interested"), F.count_if(s == "Pending").alias("pending"))
    done = F.least(F.lit(100), percent_half_up(F.col("called") + F.col("emailed"), F.col("assigned")))
    return table.withColumn("completion_percent", done)


def coverage(rows: DataFrame, group: str, identity: Column, advertised: Column, page: Column, fields: dict[str, Column]) -> DataFrame:
    """Advertised total, raw rows, distinct companies, repeats, skipped rows, pages and fill rate per mille."""
    table = rows.groupBy(group).agg(
        F.max(advertised).alias("advertised"), F.count(F.lit(1)).alias("raw_rows"), F.count_distinct(identity).alias("companies"),
        F.count_if(identity.isNull()).alias("skipped_rows"), F.max(page).alias("max_page"),
        *[F.floor(F.count_if(c.isNotNull() & (c != "")) * 1000 / F.count(F.lit(1))).cast("bigint").alias(f"fill_{n}") for n, c in fields.items()])
    return table.withColumn("duplicate_rows", F.col("raw_rows") - F.col("skipped_rows") - F.col("companies"))


def masked_log_rows(df: DataFrame, masked: dict[str, Column]) -> DataFrame:
    """One JSON text line per row, NULL fields left out."""
    return df.select(F.to_json(F.struct(*[c.alias(n) for n, c in masked.items()])).alias("value"))
