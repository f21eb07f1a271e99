"""Scans: record files, wide exports, catalogues, pages, canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_keyword
from ..schemas import CANONICAL_SCHEMA, WIDE_SCHEMA


def read_records(spark: SparkSession, path: str, schema: str | None = None, form: str = "lines") -> DataFrame:
    """Records with a fixed schema from JSON lines, which Spark splits, or from files that hold one JSON array each.

    ``form`` is ``lines`` or ``array``. Text that is not of this form raises; an array that is read as
    lines would lose rows otherwise, and so would lines that are read as an array.
    """
    wanted = T._parse_datatype_string(schema or CANONICAL_SCHEMA)
    if form not in ("lines", "array"):
        raise ValueError("form is lines or array")
    if form == "array":
        whole = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", "^[\\s\\uFEFF]+|\\s+$", "")).alias("value"))
        checked = F.when(F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.raise_error(F.lit("a file is not a JSON array")))
        rows = whole.select(F.explode(F.from_json(checked, T.ArrayType(wanted), {"mode": "FAILFAST"})).alias("r"))
        return rows.select("r.*")
    return spark.read.schema(wanted).option("mode", "FAILFAST").json(path)


def read_wide_export(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Wide directory export: 63 text columns, header, quoted values.

    Files are split among tasks unless ``line_breaks`` says that quoted values hold line breaks.
    """
    return spark.read.csv(path, schema=WIDE_SCHEMA, header=True, quote='"', escape='"', multiLine=line_breaks)


def as_raw(df: DataFrame, source_code: Column, ordinal: Column) -> DataFrame:
    """Wide rows as ``(ordinal, source_code, raw MAP)``; empty values are left out of the map."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in df.columns])
    filled = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))
    return df.select(ordinal.alias("ordinal"), source_code.alias("source_code"), F.map_from_entries(filled).alias("raw"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Trade catalogue from CSV (``keyword, name or trade, code or class_code, aliases, related``) or JSON lines."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True)
    else:
        rows = read_records(spark, path, "keyword string, trade string, name string, code string, class_code string, aliases string, related string")
    rows = rows.toDF(*[c.lower().strip() for c in rows.columns])

    def field(*names: str) -> Column:
        have = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    def split(c: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;|]"), lambda p: F.trim(p)), lambda p: p != "")
        return parts

    keyword, name = field("keyword"), field("trade", "name", "keyword")
    code = F.regexp_replace(field("class_code", "class", "code"), r"^0+(\d)", "$1")
    own = F.when(keyword.isNotNull() & (normalize_keyword(keyword) != normalize_keyword(name)), F.array(keyword)).otherwise(F.expr("cast(array() as array<string>)"))
    return rows.select(F.monotonically_increasing_id().alias("position"), name.alias("name"), code.alias("code"),
                       F.concat(own, split(field("aliases", "alias"))).alias("aliases"), split(field("related")).alias("related")
                       ).filter(F.col("name").isNotNull() & F.col("code").isNotNull())


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages, one file per page, or a Parquet table with ``page_id, url, html``."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    return files.withColumn("page_id", F.xxhash64("url"))


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int = 64) -> DataFrame:
    """Canonical table from a database, read in parallel by key ranges."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
            .option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions).load())
