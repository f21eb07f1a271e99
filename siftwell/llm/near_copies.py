"""Groups of near copies: texts whose sets of word runs have a Jaccard similarity of at least 4/5.

Candidates come from two sketches of a text's set of runs, both taken in one pass. SimHash fingerprints
that differ by at most ``radius`` bits are met through the vantage-point tree (``simhash.close_links``);
they settle copies and most near copies, but a pair at a similarity of 0.8 differs by some ten bits, where no
tree over 64 bits can prune. So the texts meet in bands of min-hashes as well: 24 bands of 4 functions each
miss a pair of similarity 0.8 with a probability of 3 in a million, nearer ones less. Every link is
verified on the whole sets.

Most texts that share a band by chance or by a lesser likeness are told apart without their sets: a parity
bitmap has a bit turned over by every run, so two of them differ in at most as many bits as the sets differ
in runs, and a pair whose bitmaps differ in more than a ninth of both sizes cannot be similar.

In a band leads are compared with members that come later in the order of a hash, twice as many leads in
each round. Only pairs whose ends are linked already are left out, so a family of copies is mostly settled
after the first ones, and once the pairs left are few per row all of them are compared, but not before some
leads were: so a large family makes pairs in proportion to its size, not to the square of it. Nothing is done
per band in one task but joins, which split.

Texts without words form one group; fewer words than a run's size are one run. Rows with one key are one
text; a null key is a text of its own and linked to nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, components, shingles, stored, with_bitmap, words
from .simhash import close_links, majority_bits, text_key

BANDS, FUNCTIONS, PAIRS_PER_ROW, LEADS = 24, 4, 100, 3
PARITY = [f"parity_{k}" for k in range(8)]  # a bitmap of 512 bits
SLICE = 1 << 20  # runs sketched at once
MARK, FLAG = "near_copies_row_mark", "near_copies_row_flag"


def run_sets(texts: DataFrame, size: int) -> DataFrame:
    """``(key, runs)``: the distinct hashes of each text's runs of ``size`` words, never empty."""
    runs = F.array_distinct(shingles(words(F.translate(F.col("text"), UPPER, LOWER)), size))
    return texts.select("key", runs.alias("runs")).select("key", F.when(F.size("runs") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("runs")).alias("runs"))


def _mixed(x: np.ndarray, seed: np.uint64, factor: np.uint64) -> np.ndarray:
    x = (x ^ seed) * factor
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xFF51AFD7ED558CCD)


def min_hash_bands(runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``(text, band)``: for each band a hash of the min-hashes of its functions."""
    seeds = np.random.default_rng(20240).integers(1, 1 << 63, size=(BANDS * FUNCTIONS, 2), dtype=np.uint64)
    out = np.empty((len(starts), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        together = np.full(len(starts), band + 1, dtype=np.uint64)
        for seed, factor in seeds[band * FUNCTIONS:(band + 1) * FUNCTIONS]:
            least = np.minimum.reduceat(_mixed(runs, seed, factor | np.uint64(1)), starts)
            together = _mixed(together ^ least, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC4CEB9FE1A85EC53))
        out[:, band] = together
    return out


def parity_bitmaps(runs: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each text a bitmap in which every run turns one bit over, as one array per 64 bits."""
    place = _mixed(runs, np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(55)
    bit, word = np.uint64(1) << (place & np.uint64(63)), place >> np.uint64(6)
    return [np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), starts) for k in range(len(PARITY))]


def sketches(texts: DataFrame, size: int) -> DataFrame:
    """``(key, n, bits, bands)`` and a parity bitmap: number of runs, SimHash fingerprint and bands of every text."""
    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists, at = part.column("runs"), 0
            ends = lists.offsets.to_numpy()
            while at < part.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
                some = lists.slice(at, stop - at)
                n = np.diff(ends[at:stop + 1]).astype(np.int64)
                runs, starts = some.flatten().to_numpy().view(np.uint64), np.cumsum(n) - n
                bands, parity = min_hash_bands(runs, starts), parity_bitmaps(runs, starts)
                bits = majority_bits(pa.ListArray.from_arrays(pa.array(ends[at:stop + 1] - ends[at], pa.int32()), some.flatten()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").slice(at, stop - at), pa.array(n), pa.array(bits.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(stop - at + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel())),
                     *[pa.array(p.view(np.int64)) for p in parity]],
                    names=["key", "n", "bits", "bands", *PARITY])
                at = stop

    return run_sets(texts, size).mapInArrow(sketch, "key long, n long, bits long, bands array<long>, " + ", ".join(f"{p} long" for p in PARITY))


def similar_links(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The ``(a, b)`` among the pairs whose sets are similar, counted exactly; only texts of pairs are dealt."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    likely = with_bitmap(texts, ends, "key").filter("there").drop("there").join(ends, "key")
    sets = stored(run_sets(likely.dropDuplicates(["key"]), size), "sets")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("runs").alias("x")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("runs").alias("y")), "b")
    return both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def fingerprint_pairs(sketched: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: one text for each fingerprint with the others of it, and with those of close fingerprints."""
    lead = stored(sketched.groupBy("bits").agg(F.min("key").alias("lead")), "leads")
    same = sketched.join(lead, "bits").filter("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    links = close_links(lead.select("bits"), radius).toDF("x", "y")
    close = links.join(lead.select(F.col("bits").alias("x"), F.col("lead").alias("a")), "x").join(
        lead.select(F.col("bits").alias("y"), F.col("lead").alias("b")), "y").select("a", "b").filter("a <> b")
    return same.union(close)


def near_copy_roots(texts: DataFrame, size: int = 5, radius: int = 2) -> DataFrame:
    """``(node, root)`` for the keys of ``(key, text)`` that have a near copy; rows of one key have one text."""
    texts = texts.filter(F.col("key").isNotNull())
    sketched = stored(sketches(texts, size).dropDuplicates(["key"]), "sketches")
    pairs = stored(fingerprint_pairs(sketched, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    roots = stored(components(similar_links(pairs, texts, size)), "roots")

    rows = sketched.select("key", "n", *PARITY, F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    order = (F.shiftrightunsigned(F.xxhash64("key"), 1) / F.lit(float(1 << 63))).alias("order")  # even in [0, 1)
    met = stored(rows.join(sizes, "band").select("band", "key", "n", "size", order, *PARITY), "meetings")
    n_rows, largest = met.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    start, width = 0, 1
    place = F.col("order") * F.col("size")  # about the place in the band's order
    while True:
        known = roots.withColumnRenamed("node", "key")
        members = stored(met.join(known, "key", "left").withColumn("root", F.coalesce("root", "key")), "members")
        apart = members.filter(place >= start).groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("c"))
        left = (apart.agg(F.sum("c")).first()[0] or 0) // 2
        last = left <= n_rows or start + width >= largest or (start >= LEADS and left <= PAIRS_PER_ROW * n_rows)
        if left:
            lead = members.filter(place >= start).filter(F.lit(True) if last else place < start + width).select(
                "band", *[F.col(c).alias(f"lead_{c}") for c in ("key", "n", "order", "root", *PARITY)])
            apart_bits = functools.reduce(operator.add, [F.bit_count(F.col(p).bitwiseXOR(F.col(f"lead_{p}"))) for p in PARITY])
            pairs = members.join(lead, (members.band == lead.band) & (F.struct("order", "key") > F.struct("lead_order", "lead_key")) & (F.col("root") != F.col("lead_root"))
                                 & (5 * F.col("n") >= 4 * F.col("lead_n")) & (5 * F.col("lead_n") >= 4 * F.col("n"))
                                 & (9 * apart_bits <= F.col("n") + F.col("lead_n")))
            pairs = stored(pairs.select(F.least("key", "lead_key").alias("a"), F.greatest("key", "lead_key").alias("b")).distinct(), "pairs")
            found = stored(similar_links(pairs, texts, size), "found")
            # A component so far is its members' links to the root.
            roots = stored(components(found.union(roots.select("node", "root"))), "roots")
        if last:
            return roots
        start, width = start + width, 2 * width


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """The document with the smallest id of each group of near copies, all columns unchanged.

    Of rows that repeat this id with the same text one stays. Rows without an id stay, as no id
    can name them.
    """
    key = ["doc_id", "key_text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key_text"), "text")
    roots = near_copy_roots(rows.select(F.col("key_text").alias("key"), "text"), size)
    groups = rows.select(key).join(roots.withColumnRenamed("node", "key_text"), "key_text", "left").withColumn("root", F.coalesce("root", "key_text"))
    groups = stored(groups.filter("doc_id IS NOT NULL").groupBy("root", *key).agg(F.count("*").alias("copies")), "groups")
    groups = groups.join(groups.groupBy("root").agg(F.min("doc_id").alias("first")), "root")
    surplus = groups.filter("first <> doc_id").select(key)
    repeated = groups.filter("first = doc_id AND copies > 1").select(key)

    def marks(side: DataFrame) -> DataFrame:
        return side.select(F.xxhash64(*key).alias(MARK))

    rows = docs.withColumn(MARK, F.xxhash64(F.col("doc_id").cast("long"), text_key("text")))
    rows = with_bitmap(rows, marks(surplus.union(repeated)), MARK, FLAG)
    once = rows.filter(FLAG).join(marks(surplus.union(repeated)), MARK, "left_anti")
    first = rows.filter(FLAG).join(marks(repeated), MARK, "left_semi").dropDuplicates([MARK])
    return rows.filter(f"NOT {FLAG}").select(docs.columns).union(once.select(docs.columns)).union(first.select(docs.columns))
