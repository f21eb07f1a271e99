"""Audit of how the sources of a language differ in their terms, by three-dimensional cube partitioning.

Groups are the pairs of language and source. A pair of groups differs by the sum, over all terms the
language keeps, of a divergence of their two shares. The work is a cube with two axes of groups and one
of terms, cut into cells of (group block, group block, term block). Every cell gets its two slices of
shares, replicated to all cells that need them, and returns partial sums for its pairs; the partial sums
are added along the axis of terms. A cell holds some ``group_block`` groups on either side and
``term_block`` terms, however large the corpus or one of its groups is.

Shares are integers: ``1 + floor(10^9 * (count + 2) / (total + 2 * terms))``, and all arithmetic is exact.
Terms absent from both groups of a pair contribute the divergence of two known shares, so cells hold only
terms that occur in one of their groups, and the others are counted.

Results for odd input: null text, language and source are read as empty; a group without terms has the
share of an absent term throughout; a language that keeps no term has divergence 0 everywhere; repeated
rows count as documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .terms import LETTERS, Numbers, split_terms


def _div(value: Column, by: Column) -> Column:
    return F.call_function("div", value, by)


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """``1 + floor(10^9 * (count + 2) / (total + 2 * n_terms))`` by long division in base 1000, so nothing overflows."""
    divisor, rest, value = F.greatest(total + 2 * n_terms, F.lit(1).cast("long")), count + 2, F.lit(0).cast("long")
    for _ in range(3):
        value, rest = value * 1000 + _div(rest * 1000, divisor), F.pmod(rest * 1000, divisor)
    return value + 1


def divergence(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))`` for positive whole numbers."""
    return _div((p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term in a group, and documents of the group that hold it.

    Terms are counted per Arrow batch before they are dealt, so a hot group sends one row per batch and term.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            groups = pd.MultiIndex.from_arrays([part.column(0).to_pylist(), part.column(1).to_pylist()])
            group, names = groups.factorize()
            numbers, texts = Numbers(), part.column(2)
            found = [numbers.of(split_terms(t.as_py(), LETTERS)) for t in texts]
            width = max(1, len(numbers.known))
            pair, n = np.unique(np.concatenate([f + k * width for k, f in enumerate(found)] or [np.empty(0, np.int64)]), return_counts=True)
            doc, term = np.divmod(pair, width)
            key, at = np.unique(group[doc] * width + term, return_inverse=True)
            code, term = np.divmod(key, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in names], pa.string()).take(pa.array(code)) for k in (0, 1)]
                + [pa.array([t.decode() for t in numbers.known], pa.string()).take(pa.array(term)),
                   pa.array(np.bincount(at, n, len(key)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(key)))],
                names=["lang", "source", "term", "n", "docs"])

    counts = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def cell_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of all pairs of groups of one cell.

    Rows without term name the groups of the cell and the share of an absent term; the others have the
    share of a term in a group. ``n_terms`` is the number of terms of the block that the cell has seen.
    """
    named = frame[frame["term"].isna()]
    row = dict(zip(named["source"], range(len(named))))
    there = frame[frame["term"].notna()]
    term, terms = pd.factorize(there["term"])
    shares = np.repeat(named["p"].to_numpy(dtype=np.int64)[:, None], len(terms), axis=1)
    shares[there["source"].map(row).to_numpy(dtype=np.int64), term] = there["p"].to_numpy(dtype=np.int64)
    low, high = frame["low"].iat[0], frame["high"].iat[0]
    sources, block = named["source"].to_numpy(), named["block"].to_numpy()
    out: list[tuple[str, str, int]] = []
    for i in np.flatnonzero(block == low):
        others = np.flatnonzero(block == high)
        others = others[others > i] if low == high else others
        apart, both = shares[i] - shares[others], shares[i] + shares[others]
        sums = (apart * apart // both).sum(axis=1)
        out += zip([sources[i]] * len(others), sources[others], sums.tolist())
    pairs = pd.DataFrame(out, columns=["source", "item", "part_sum"])
    return pairs.assign(lang=frame["lang"].iat[0], n_terms=len(terms))[["lang", "source", "item", "part_sum", "n_terms"]]


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10,
                      top_terms: int = 10, group_block: int = 32, term_block: int = 4096) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair`` ranks the other sources of the language by divergence, all of them; part ``term`` ranks
    the terms a source has more often than its language, the ``top_terms`` first.
    """
    counts = stored(term_counts(docs, lang, source, text), "counts")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs)
                  .select("lang", "term", "lang_n"), "kept")
    terms = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups")).join(
        kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    blocks = F.ceil(F.col("n_groups") / group_block).cast("int")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").na.fill(0, ["total", "v", "lang_total"]).select(
        "lang", "source", "total", "v", "lang_total", blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"),
        share(F.lit(0).cast("long"), F.col("total"), F.col("v")).alias("absent"))
    groups = stored(groups, "groups")
    shares = stored(terms.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"), "v", "block", "blocks"), "shares")

    term_blocks = F.greatest(F.ceil(F.col("v") / term_block), F.lit(1)).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner")
    slices = shares.select("lang", "source", "term", "p", "block", F.pmod(F.xxhash64("term"), term_blocks).cast("int").alias("term_block"), partner)
    names = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), "block", "blocks",
                          F.explode(F.sequence(F.lit(0), term_blocks - 1)).alias("term_block"))
    names = names.select("lang", "source", "term", "p", "block", "term_block", partner)
    cells = slices.unionByName(names).select("lang", "source", "term", "p", "block", "term_block",
                                             F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"))
    partial = cells.groupBy("lang", "low", "high", "term_block").applyInPandas(
        cell_sums, "lang string, source string, item string, part_sum long, n_terms long")
    sums = partial.groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("part_sum"), F.sum("n_terms").alias("n_terms"))
    ends = groups.select("lang", "source", "v", "absent")
    sums = sums.join(ends, ["lang", "source"]).join(
        ends.select("lang", F.col("source").alias("item"), F.col("absent").alias("item_absent")), ["lang", "item"])
    value = F.col("part_sum") + (F.col("v") - F.col("n_terms")) * divergence(F.col("absent"), F.col("item_absent"))
    pairs = sums.select("lang", "source", "item", value.alias("value")).select("lang", F.inline(F.array(
        F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(above)
