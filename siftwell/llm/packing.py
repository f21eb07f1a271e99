"""Packing of token sequences into windows of fixed size by exact complements.

Documents are tokenised once; only those longer than a window are cut. The plan needs nothing but
how many pieces there are of each length, a table of at most ``window`` rows whatever the corpus.
Going from long to short, the gap a length leaves is filled by one piece, else a pair, else a triple
of pieces whose lengths add up to it exactly, as often as pieces are left; sums are looked up in hash
tables of single and pair sums. What has no exact complement is then packed best fit, decreasing.
The plan consists of ranges: "pieces number r to r + n of length l lie at offset o of sequences s to
s + n". Spark numbers the pieces of every length and joins them with these ranges.

Results for odd input: null and empty texts are documents that consist of the end token alone; rows
that repeat are packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
REMEMBERED = 400_000  # a worker keeps the ids of up to twice as many distinct words
# Characters whose splitting is plain: ASCII without rare controls, and Latin-1 letters.
PLAIN = re.compile("[\\t\\n\\x0b\\x0c\\r\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
# Fixed value: the tokenizer's own splitting rule, for these characters in lower case.
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
SPACES = re.compile("[ \\t\\n\\r\\f\\v]+")


class Memory:
    """Ids of words in two generations: what was not asked for during the last one is forgotten."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> list[str]:
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        unknown = words.difference(self.new)
        again = unknown.intersection(self.old)
        self.new.update((w, self.old[w]) for w in again)
        return list(unknown - again)


class Encoder:
    """Ids of whole texts, as the tokenizer gives them.

    The tokenizer splits texts before it merges anything, so a text's ids are those of its parts in
    order, and ids of parts seen before are remembered. Texts of plain characters are split by the
    tokenizer's rule; others, and those with the strings of special tokens, only at white space,
    which the tokenizer drops.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.parts, self.words = Tokenizer.from_file(path), Memory(), Memory()
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Many parts as one text: every part ends with a piece that is marked as a word's end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts):
            return self._encode_words(parts)
        return [x.tobytes() for x in np.split(ids, ends[:-1])]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split: list[tuple[Memory, list[str]]] = []
        for t in texts:
            plain = PLAIN.fullmatch(t) and "<|" not in t
            split.append((self.parts, SPLIT.findall(t.lower())) if plain else (self.words, SPACES.split(t)))
        for memory, encode in ((self.parts, self._encode_parts), (self.words, self._encode_words)):
            new = memory.missing(set().union(*[words for m, words in split if m is memory]))
            for at in range(0, len(new), 2000):
                part = new[at:at + 2000]
                memory.new.update(zip(part, encode(part)))
        return [np.frombuffer(b"".join(map(m.new.__getitem__, words)), dtype="<u4") for m, words in split]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, window: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` and, if asked for, the ids of every piece."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for part in parts:
            for at in range(0, len(part), 256):  # a few texts at a time bound the worker's memory
                some, rows = part.iloc[at:at + 256], []
                for i, ids in zip(some["doc_id"], encode(some["text"].tolist())):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for start in range(0, len(ids), window):
                        own = ids[start:start + window]
                        rows.append((i, start // window, start, len(own), zlib.crc32(own.tobytes())) + ((own.astype(np.int64),) if with_ids else ()))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
                yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, PIECES + ", ids array<long>" * with_ids)


def plan_ranges(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges ``(length, first rank, pieces, first sequence, offset)`` from the number of pieces per length."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    ranges, sequence = [], 0
    lengths = sorted(left)
    there = np.zeros(2 * window + 2, dtype=bool)  # lengths with pieces left
    there[lengths] = True

    def take(pattern: tuple[int, ...], times: int) -> None:
        nonlocal sequence
        offset = 0
        for n in pattern:
            # Equal lengths in one pattern get rank ranges one behind the other.
            ranges.append((n, used[n], times, sequence, offset))
            used[n] += times
            left[n] -= times
            there[n] = left[n] > 0
            offset += n
        sequence += times

    def times(pattern: tuple[int, ...]) -> int:
        return min(left.get(n, 0) // pattern.count(n) for n in set(pattern))

    def pair(total: int, *others: int) -> tuple[int, int] | None:
        """Two lengths that add up to ``total`` and are left beside ``others``; the longer one as long as possible."""
        low = (total + 1) // 2
        for k in np.flatnonzero(there[low:total] & there[total - low:0:-1])[::-1].tolist():
            if times((*others, low + k, total - low - k)):
                return low + k, total - low - k
        return None

    def triple(total: int, first: int) -> tuple[int, ...] | None:
        """Three lengths; the sums of all pairs come from a convolution of the lengths that are left."""
        spectrum = np.fft.rfft(there, 4 * window + 4)
        pairs = np.fft.irfft(spectrum * spectrum, 4 * window + 4) > 0.5
        for a in (np.flatnonzero(there[1:total] & pairs[total - 1:0:-1])[::-1] + 1).tolist():
            if two := pair(total - a, first, a):
                return a, *two
        return None

    for n in reversed(lengths):
        while left[n]:
            gap = window - n
            if gap == 0:
                fill: tuple[int, ...] | None = ()
            elif left.get(gap) and times((n, gap)):
                fill = (gap,)
            else:
                fill = pair(gap, n) or triple(gap, n)
            if fill is None:
                break
            take((n, *fill), times((n, *fill)))

    # Best fit, decreasing, over groups of equal bins: (room, first sequence, bins, filled so far).
    open_bins: list[tuple[int, int, int]] = []
    for n in reversed(lengths):
        while left[n]:
            at = bisect_left(open_bins, (n, -1, -1))
            if at < len(open_bins):
                room, first, bins = open_bins.pop(at)
                now = min(bins, left[n])
                ranges.append((n, used[n], now, first, window - room))
                if now < bins:
                    insort(open_bins, (room, first + now, bins - now))
            else:
                # As many new bins as hold what is left of this length.
                each = window // n
                now = max(1, left[n] // each)
                room, first = window, sequence
                sequence += now
                ranges.append((n, used[n], now, first, 0))
            used[n] += now
            left[n] -= now
            if room - n:
                insort(open_bins, (room - n, first, now))
    return ranges


def assign(cut: DataFrame, window: int = 4096, parts: int = 16) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset`` for every piece.

    Pieces of one length are numbered in ``parts`` blocks, so that a length which a third of all
    pieces have is not numbered by one task.
    """
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    numbered = cut.withColumn("block", block)
    sizes = numbered.groupBy("length", "block").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(
        Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "block", "before")
    totals = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``window`` rows
    ranges = plan_ranges(totals, window)
    spark = cut.sparkSession
    plan = spark.createDataFrame(pd.DataFrame(ranges, columns=["length", "first", "pieces", "sequence", "offset"], dtype="int64"),
                                 "length long, first long, pieces long, sequence long, offset long")
    lists = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "offset"))).alias("ranges"))
    ranked = numbered.withColumn("number", F.row_number().over(order)).join(F.broadcast(before), ["length", "block"]).withColumn(
        "rank", F.col("before") + F.col("number") - 1)
    placed = ranked.join(F.broadcast(lists), "length").withColumn(
        "range", F.element_at(F.filter("ranges", lambda r: r["first"] <= F.col("rank")), -1))
    return placed.select(*cut.columns, (F.col("range.sequence") + F.col("rank") - F.col("range.first")).alias("sequence_id"),
                         F.col("range.offset").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Pieces with their place in packed sequences: ``sequence_id`` and ``offset``, gapless from 0."""
    return assign(stored(pieces(docs, tokenizer, window, end, doc_id, text, with_ids), "pieces"), window)
