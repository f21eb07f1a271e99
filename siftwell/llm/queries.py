"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import chat, decontaminate, divergence, html_template, line_rules, oracles, packing, passages, pii, quality_model, ranked_search, simhash, substring_dedup, token_counts

PII_KEY = "surrogates"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    done = pii.replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.withColumn("n_entities", F.size("pii_spans").cast("long"))


def op2_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are full of marks, formatted and read back."""
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.conversation_digests(chat.prefix_examples(turns))


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that share a passage of 50 words or more, with their class."""
    return passages.passage_classes(_table(spark, sf_dir, "documents"))


def op4_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents."""
    counted = token_counts.prefix_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op5_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4,096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_template_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = html_template.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents, the source taken as host."""
    return line_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op8_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of all documents."""
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents, learned from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return quality_model.scores(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources of a language by divergence, and the terms each source prefers."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the bytes that repeated strings of 400 bytes cover, and a digest of the rest."""
    done = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_surrogates, op2_prefix_target, op3_compact_windows, op4_prefix_counts, op5_complement_packing, op6_template_classes,
                            op7_line_frequency, op8_simhash_vantage, op9_attention_quality, op10_string_tiling, op11_source_divergence,
                            op12_suffix_dedup, op13_ranked_search)
}

SQL: dict[str, str] = {"op2_prefix_target": oracles.PREFIX_TARGET, "op7_line_frequency": oracles.LINE_FREQUENCY,
                       "op11_source_divergence": oracles.SOURCE_DIVERGENCE, "op13_ranked_search": oracles.RANKED_SEARCH}
