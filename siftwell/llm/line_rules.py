"""Quality rules: counts per document, and the frequency of lines across the documents of a host.

Lines are compared after lower-casing and joining white space. A line is above the limit if more
than ``most_documents`` documents of a host have it, where copies, documents with the same set of
lines, count once: they are left to the duplicate stage. A document is depleted if less than ``least_left`` of its words are outside such lines.

Results for odd input: null and empty texts have no words and fail the base rules; a null host is a
host of its own; repeated rows count as one document in line frequencies and are all returned; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, WHITE_SPACE, let, row_key, shingles, stored, words

HAS_WORD = "[^\\x20\\x09-\\x0D]"
MARK = "line_rules_mark"


def repeated_words(tokens: Column, size: int = 3) -> Column:
    """Words inside runs of ``size`` words that the text has more than once."""

    def starts(runs: Column) -> Column:
        """Places of the runs that occur again, found as neighbours with equal hash in sorted order."""
        ordered = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda o: F.sort_array(F.transform(
            F.filter(o, lambda x, k: F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False))
                     | ((k > 0) & F.coalesce(F.get(o, F.greatest(k - 1, F.lit(0)))["h"] == x["h"], F.lit(False)))),
            lambda x: x["i"])))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(size)), F.lit(size)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def counted(runs: Column) -> Column:
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0).cast("long")).otherwise(let(starts(runs), covered))

    return let(tokens, lambda t: F.when(F.size(t) < size, F.lit(0).cast("long")).otherwise(let(shingles(t, size), counted)))


def text_counts(text: Column) -> dict[str, Column]:
    """The base counts of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))
    tokens = words(text)
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, WHITE_SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(tokens),
    }


def base_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    counts = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), *[c.alias(n) for n, c in text_counts(F.col(text)).items()])
    return counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_hash(line: Column) -> Column:
    """The first 60 bits of the MD5 digest: a hash that other systems have as well."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def line_table(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One row per line with words: document key, host, hash, words, and the mark of the document's set of lines."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09\\x0B-\\x0D]+", " "))
    parts = F.filter(F.split(plain, " ?\n ?"), lambda x: x != "")
    hashed = F.transform(parts, lambda x: F.struct(line_hash(x).alias("line"), F.size(F.split(x, " ")).alias("words")))
    rows = docs.select(*row_key(doc_id, text), F.col(host).alias("host"), hashed.alias("lines"))
    mark = F.xxhash64(F.sort_array(F.array_distinct(F.transform("lines", lambda x: x["line"]))))
    rows = rows.select(*KEY, "host", "lines", mark.alias("mark"))
    return rows.select(*KEY, "host", "mark", F.explode("lines").alias("x")).select(*KEY, "host", F.col("x.line").alias("line"), F.col("x.words").alias("words"), "mark")


def frequent_lines(lines: DataFrame, most_documents: int) -> DataFrame:
    """``(host, line)`` above the limit."""
    once = lines.groupBy("host", "line", "mark").agg(F.lit(1).alias("one"))
    totals = once.groupBy("host", "line").agg(F.count("*").alias("documents"))
    return totals.filter(F.col("documents") > most_documents).select("host", "line")


def depleted(docs: DataFrame, doc_id: str, text: str, host: str, most_documents: int, least_left: float) -> DataFrame:
    """Keys of the documents that lose too many of their words with the frequent lines."""
    lines = stored(line_table(docs, doc_id, text, host), "lines")  # read twice: to count, and to judge by the counts
    frequent = frequent_lines(lines, most_documents).select(F.col("host").alias("h"), F.col("line").alias("l"), F.lit(True).alias("above"))
    marked = lines.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left")
    left = marked.groupBy(KEY).agg(F.sum("words").alias("all_words"), F.sum(F.when(F.col("above").isNull(), F.col("words")).otherwise(0)).alias("left_words"))
    return left.filter(F.col("left_words") < least_left * F.col("all_words")).select(KEY)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                  most_documents: int = 20, least_left: float = 0.2) -> DataFrame:
    """Counts and verdict of every row."""
    counts = base_counts(docs, doc_id, text)
    emptied = depleted(docs, doc_id, text, host, most_documents, least_left).withColumn("depleted", F.lit(True))
    return counts.join(emptied, KEY, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("depleted").isNull()).alias("kept"))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
              most_documents: int = 20, least_left: float = 0.2) -> DataFrame:
    """The documents that the rules accept, all columns unchanged."""
    emptied = depleted(docs, doc_id, text, host, most_documents, least_left).select(F.concat_ws("/", *KEY).alias(MARK))
    counts = text_counts(F.col(text))
    n, repeated = counts["n_words"], counts["n_repeat_words"]
    good = docs.filter(let(n, lambda c: (c >= 50) & (100 * repeated <= 50 * c)))
    return good.withColumn(MARK, F.concat_ws("/", *row_key(doc_id, text))).join(emptied, MARK, "left_anti").select(docs.columns)
