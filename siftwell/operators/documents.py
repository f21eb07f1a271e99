"""Document store: chunking, ingest with exact de-duplication, readiness, deletion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


BLANKS = r"(?U)\s+"


def words_of(text: Column, blanks: str = BLANKS) -> Column:
    return F.filter(F.split(text, blanks), lambda w: w != "")


def chunk_array(text: Column, size: int = 500, overlap: int = 50, blanks: str = BLANKS) -> Column:
    """Sliding windows of ``size`` words between ``blanks``; consecutive windows share ``overlap`` words.

    Array of ``struct(chunk_index, content, token_count)``, empty for a text without words.
    """
    step = max(1, size - overlap)

    def windows(words: Column) -> Column:
        n = F.size(words)
        last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: let(
            F.slice(words, i * step + 1, size), lambda w: F.struct(
                i.alias("chunk_index"), F.array_join(w, " ").alias("content"), F.size(w).alias("token_count")))))

    return let(words_of(text, blanks), windows)


def chunk_documents(docs: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50, blanks: str = BLANKS, beside: Sequence[str] = ()) -> DataFrame:
    """One row per chunk with its SHA-256 and the columns ``beside`` it. No shuffle: a document is split where it was read."""
    rows = docs.select(key, *beside, F.inline(chunk_array(F.col(text), size, overlap, blanks)))
    return rows.withColumn("content_hash", F.sha2("content", 256))


def ingest_documents(incoming: DataFrame, stored_hashes: DataFrame, key: str, text: str, refuse_empty: bool = True) -> DataFrame:
    """``status`` per document: ``already_exists``, ``empty`` or ``ingested``, with the hash and the
    document that stands for the content.

    Without ``refuse_empty`` a text without words is treated like any other. Of equal texts the lowest
    key is ingested. It is found by an aggregation over the hash, so many copies of one text are
    combined before they are shuffled.
    """
    words = F.col(text).rlike(r"(?U)\S") if refuse_empty else F.lit(True)
    hashed = incoming.select(key, F.sha2(text, 256).alias("content_hash"), words.alias("_words"))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("document"))
    stored = stored_hashes.groupBy("content_hash").agg(F.min("document").alias("_stored"))
    owners = first.join(stored, "content_hash", "left").select(
        "content_hash", F.coalesce("_stored", "document").alias("document"), F.col("_stored").isNotNull().alias("_known"))
    joined = hashed.join(owners, "content_hash")
    known = F.col("_known") | (F.col("document") != F.col(key))
    status = F.when(~F.col("_words"), F.lit("empty")).when(known, F.lit("already_exists")).otherwise(F.lit("ingested"))
    return joined.select(key, "content_hash", "document", status.alias("status"))


def embed(chunks: DataFrame, text: str, embedder: Callable[..., pd.Series], name: str = "embedding", beside: Sequence[str] = ()) -> DataFrame:
    """Vectors from an embedder that maps a batch of texts, and of the columns ``beside`` them, to a batch of vectors."""

    @F.pandas_udf("array<float>")
    def run(*columns: pd.Series) -> pd.Series:
        return embedder(*columns)

    return chunks.withColumn(name, run(text, *beside))


def check_vectors(chunks: DataFrame, dimension: int, model: Column | None = None, expected_model: str | None = None) -> DataFrame:
    """Add ``problem``: wrong dimension or wrong model; NULL for a usable vector."""
    wrong_model = F.lit(False) if model is None or expected_model is None else F.coalesce(model != expected_model, F.lit(False))
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    return chunks.withColumn("problem", F.when(wrong_model, F.lit("model mismatch")).when(size != dimension, F.lit("dimension mismatch")))


def add_chunks(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Documents with ``chunk_count`` raised by the usable new chunks."""
    counts = chunks.filter(F.col("problem").isNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return documents.join(counts, key, "left").withColumn("chunk_count", F.col("chunk_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def store_documents(incoming: DataFrame, stored_hashes: DataFrame, key: str, text: str, embedder: Callable[..., pd.Series], dimension: int,
                    size: int = 500, overlap: int = 50, blanks: str = BLANKS, beside: Sequence[str] = (), refuse_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """Ingest in one go: find what is new, cut it, embed it, check it.

    Returns the documents with ``status`` and ``chunk_count`` and the usable chunks. A document whose
    vectors have another dimension is ``failed`` and brings no chunks. The columns ``beside`` the text
    go to the embedder with each of its chunks.
    """
    statuses = ingest_documents(incoming, stored_hashes, key, text, refuse_empty)
    fresh = incoming.join(statuses.filter("status = 'ingested'").select(key), key, "left_semi")
    pieces = chunk_documents(fresh, key, text, size, overlap, blanks, beside)
    chunks = check_vectors(embed(pieces, "content", embedder, beside=beside), dimension)
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_chunks"), F.count_if(F.col("problem").isNotNull()).alias("_bad"))
    joined = statuses.join(counts, key, "left")
    status = F.when(F.col("_bad") > 0, F.lit("failed")).otherwise(F.col("status"))
    documents = joined.select(key, "content_hash", "document", status.alias("status"), F.when(F.col("_bad") == 0, F.col("_chunks")).otherwise(0).alias("chunk_count"))
    usable = chunks.join(counts.filter("_bad > 0").select(key), key, "left_anti").drop("problem")
    return documents, usable


def readiness(documents: DataFrame, chunks: DataFrame, dimension: int, model: str | None = None) -> DataFrame:
    """One row: counts and the state ``empty``, ``dimension_mismatch``, ``model_mismatch`` or ``ready``."""
    sizes = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.min(F.size("embedding")).alias("_low"), F.max(F.size("embedding")).alias("_high"))
    own = documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if(
        F.col("embedding_model").isNotNull() & (F.col("embedding_model") != F.lit(model)) if model else F.lit(False)).alias("_foreign"))
    both = own.withColumns({c: sizes.select(c).scalar() for c in ("chunks", "_low", "_high")})
    state = (F.when((F.col("documents") == 0) | (F.col("chunks") == 0), F.lit("empty"))
             .when((F.col("_low") != dimension) | (F.col("_high") != dimension), F.lit("dimension_mismatch"))
             .when(F.col("_foreign") > 0, F.lit("model_mismatch")).otherwise(F.lit("ready")))
    return both.select("documents", "chunks", state.alias("state"))


def delete_documents(documents: DataFrame, chunks: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without the doomed ones."""
    keys = doomed.select(key).distinct()
    return documents.join(keys, key, "left_anti"), chunks.join(keys, key, "left_anti")


def excerpts(hits: DataFrame, text: str, length: int = 300) -> DataFrame:
    return hits.withColumn(text, F.substring(F.col(text), 1, length))


__all__ = ["BLANKS", "add_chunks", "check_vectors", "chunk_array", "chunk_documents", "delete_documents", "embed", "excerpts",
           "ingest_documents", "readiness", "store_documents", "words_of"]
