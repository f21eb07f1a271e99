"""Queries against their SQL on inputs that the given tables lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwell.functions import contact
from siftwell.plans import load_plans
from tests.compare import differences

TEXTS = ["212.555.1234, 213.555.1234", "212-555-1234 ext. 7", "888-720-1710", "212-555-1234 212-555-9999", "212\x0b555\x0b1234", "x 212 555 1234 x212 555 1235",
         "Vi.24@Mail4.example.com", "x@y.9 ok@firm.com", "http://site.org/a ok@firm.com", "noreply@firm.com x@firm.com", "a@b.com.Und", "a@b.com_x", "a@b.co1.com", "a@b.comé", "u@h.com-", None, ""]

BARE = ["", " ", "\n\t ", "\u2003", "\xa0", "\x0b", None, "token", "a token = ", "token = x", "token  = x", "token =\nx", "token\xa0= x", "a\xa0b c", "a\x0bb\x85c d", "xTOKEN", "To\u212aen", "That wh\u017ft", "THAT WHST", "that", "x y", "w " * 119 + "token = x"]


def same(spark, folder, name, table, rows):
    rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    plan = load_plans()[name]
    return differences(plan.run(spark, str(folder)), con, plan.sql)


@pytest.mark.parametrize("name", ["phones_in_text", "contact_info"])
def test_odd_texts(spark, tmp_path, name):
    assert same(spark, tmp_path, name, "documents", spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")) == []


def bare_documents(spark):
    """Texts without words and with odd blanks, each three times under languages of its own, and a row without a key."""
    rows = [(3 * i + k, text, (["en", "de", "fr"] * 3)[i % 3 + k * (i % 4)]) for i, text in enumerate(BARE) for k in range(3)]
    return spark.createDataFrame(rows + [(None, "no key", "fr")], "doc_id long, text string, lang string")


def test_blank_texts_hold_no_words_asked_for(spark, tmp_path):
    assert same(spark, tmp_path, "all_words_match", "documents", bare_documents(spark)) == []


def test_blank_texts_are_hashed_like_others(spark, tmp_path):
    assert same(spark, tmp_path, "doc_dedup", "documents", bare_documents(spark)) == []


@pytest.mark.parametrize("name", ["document_ingest", "chunk_documents"])
def test_odd_blanks_cut_words_as_in_sql(spark, tmp_path, name):
    assert same(spark, tmp_path, name, "documents", bare_documents(spark)) == []


def test_jobs_that_start_after_the_view(spark, tmp_path):
    k = F.col("id")
    rows = spark.range(3000).select(k.alias("event_id"), k.alias("user_id"), F.lit("view").alias("event_type"), F.concat(F.lit('{"k": '), k % 100, F.lit("}")).alias("props"),
                                    (F.lit("2024-01-25").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * 617).cast("decimal(18,6)"))).alias("ts"), F.lit(1.0).alias("value"))
    assert same(spark, tmp_path, "job_view", "events", rows) == []


def test_last_digits_of_a_dotted_number_are_no_extension(spark):
    got = spark.createDataFrame([("212.555.1234, 213.555.1234 ext. 9",)], "t string").select(contact.phones_in_text(F.col("t"))).first()[0]
    assert got == ["+12125551234", "+12135551234x9"]
