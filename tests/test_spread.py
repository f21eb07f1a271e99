"""Work per row is dealt by rows, not by files."""

import pytest
from pyspark.sql import functions as F

from siftwell.plans import bindings as B
from siftwell.plans import document_queries as Q
from siftwell.plans import load_plans


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """Customers and parts in one file of one row group each."""
    folder = str(tmp_path_factory.mktemp("one"))
    k = F.col("id")
    spark.range(20_000).coalesce(1).select(k.alias("c_custkey"), F.concat(F.lit("Firm "), k).alias("c_name"), F.lit("MACHINERY").alias("c_mktsegment"),
                                           (k % 25).cast("int").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal")).write.parquet(f"{folder}/customer.parquet")
    spark.range(20_000).coalesce(1).select(k.alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("T").alias("p_type")).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("pages", [Q.profile_pages, Q.listing_pages, Q.people_pages, Q.section_pages, Q.structured_pages])
def test_pages_of_one_file_are_many_tasks(spark, one_file, pages):
    sizes = pages(B.Entities(spark, one_file)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20_000 // B.ROWS_PER_TASK and sum(r["count"] for r in sizes) == 20_000
    assert max(r["count"] for r in sizes) < 2 * B.ROWS_PER_TASK


def test_parts_of_one_file_are_many_tasks(spark, one_file):
    kinds = load_plans()["url_kinds"].run(spark, one_file)
    assert len(kinds.groupBy(F.spark_partition_id()).count().collect()) == 20_000 // B.ROWS_PER_TASK
