"""Displayed rows and export layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from .deliver import export_columns
from .ordered import number_rows

# --- fixed values: column titles of the exports and the view column behind each ---------------
LEAD_EXPORT = {"ID": "lead_id", "Name": "name", "Company": "company", "Title": "title", "Email": "email", "Phone": "phone",
               "Location": "location", "City": "city", "State": "state", "Source Code": "source_code", "Due At": "due_at",
               "Status": "status", "Website": "website", "Industry": "industry", "Created At": "created_at"}
REQUEST_EXPORT = {"ID": "request_id", "User ID": "user_id", "User Name": "user_name", "Decision": "decision", "Status": "status",
                  "Job ID": "job_id", "Records Returned": "records_returned", "Records New": "records_new",
                  "Records Updated": "records_updated", "Served At": "served_at", "Created At": "created_at"}
DELIVERY_EXPORT = {"User": "user", "Query ID": "request_id", "Request": "request", "Served At": "served_at", "Record ID": "lead_id",
                   "Company": "company", "Title": "title", "Category": "category", "City": "city", "State": "state", "Email": "email",
                   "Phone": "phone", "Source": "source_code", "Source URL": "source_url", "Record Version": "record_version",
                   "Historical Snapshot": "has_snapshot", "Request Fulfilled": "fulfilled", "Delivery Kind": "delivery_kind",
                   "Matching Records": "matching", "Requested Records": "requested", "Understood Request": "criteria"}
SHEET_EXPORT = {"#": "position", "Contact Name": "contact", "Company": "company", "Title": "title", "Email": "email", "Phone": "phone",
                "Location": "location", "Status": "status", "Website": "website", "Industry": "industry", "Source": "source_code",
                "Source URL": "source_url", "Notes": "notes"}


def iso(c: Column) -> Column:
    """Time as ISO text."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def laid_out(rows: DataFrame, layout: dict[str, str], safe: bool = False) -> DataFrame:
    """Rows in an export layout: columns the rows do not have stay empty, times become ISO text."""
    kinds = dict(rows.dtypes)

    def cell(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string")
        return iso(F.col(name)) if kinds[name].startswith("timestamp") else F.col(name)

    return export_columns(rows, {title: cell(name) for title, name in layout.items()}, safe)


def sheet_rows(rows: DataFrame, bucket: Column, order: list[Column]) -> DataFrame:
    """Sheet layout: numbered rows, the company stands in for a missing contact name."""
    numbered = number_rows(rows, [], bucket, order, "position")
    place = F.coalesce(blank_to_null(F.col("location")), blank_to_null(F.concat_ws(", ", "city", "state")))
    shown = numbered.withColumns({"contact": F.coalesce(blank_to_null(F.col("name")), F.col("company")), "location": place,
                                  "status": F.coalesce(blank_to_null(F.col("status")), F.lit("New"))})
    return laid_out(shown, SHEET_EXPORT)


def dataset_view(datasets: DataFrame) -> DataFrame:
    """Counters default to zero, blank texts to NULL, tags to an empty list."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("records_count", "verified_count", "duplicates_count")}
    blank = {c: blank_to_null(F.col(c)) for c in ("status", "description", "created_by")}
    return datasets.withColumns({**zero, **blank, "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def session_view(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("title", F.coalesce(blank_to_null(F.col("title")), F.lit("Untitled Session")))


def message_view(messages: DataFrame) -> DataFrame:
    return messages.withColumns({"role": F.coalesce(blank_to_null(F.col("role")), F.col("sender")),
                                 "suggestions": F.coalesce("suggestions", F.array().cast("array<string>"))})


def json_safe(*columns: str) -> Column:
    """Nested values as JSON text with ISO times."""
    return F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})
