"""Repeated byte strings, found by deep-shallow sorting of sampled suffixes, and their removal.

A byte is removed if a string of ``length`` bytes covers it that also starts anywhere else. Every such
string has, among its first ``window`` bytes, one place whose eight bytes have the smallest hash (the
leftmost of these). These places, the anchors, depend on content only, so both occurrences of a repeated
string have an anchor at the same offset: only suffixes that start at anchors need to be sorted, one in
some ``window / 2`` bytes.

An anchor's context is the bytes before it (less than ``window``) and after it (``length`` of them). Two
anchors share repeated strings as far as their contexts agree: strings that start ``o`` bytes before the
anchor need ``o`` equal bytes on the left and ``length - o`` on the right. Anchors with the same context
are one class; a class of two or more is settled at once, and so is a class that no other resembles on the
right. The rest is dealt by the bytes that all strings through an anchor share, the texts are sorted to the
right and, reversed, to the left (``deep_shallow``), and for every ``o`` the classes of both orders that
meet in more than one anchor are repeats. All strings through an anchor cover it, so the first and the last
offset say what is removed.

A group of very many different contexts is not sorted in one task: its strings are counted one by one,
which spreads them evenly.

Results for odd input: null and empty texts and texts shorter than ``length`` lose nothing; rows that
repeat are repeats of each other; rows without id are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_bitmap
from .deep_shallow import deep_shallow

GRAM = 8
PIECE = 1 << 18  # bytes looked at together
SORTED_ROWS, HOT_CLASSES = 20_000, 50_000  # rows sorted together; contexts of one key that one task takes, some 35 MB
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:len(values) - (width - size)], values[width - size:])


class Anchors:
    """Finds anchors and the hashes of their contexts in a run of texts."""

    def __init__(self, length: int, window: int):
        self.length, self.window, self.reach = length, window, window - GRAM
        self.margin = self.reach + length + GRAM
        steps = np.full(PIECE + 3 * self.margin, BASE, dtype=np.uint64)
        steps[0] = 1
        self.powers = np.cumprod(steps)
        steps[1:] = np.uint64(pow(int(BASE), -1, 1 << 64))
        self.inverse = np.cumprod(steps)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the texts, places in them, and the hashes of what follows and of the whole context."""
        found = [self._piece(data, offsets, at) for at in range(int(offsets[0]), max(int(offsets[-1]) - self.length + 1, int(offsets[0])), PIECE)]
        place, key, context = (np.concatenate([f[k] for f in found] or [np.empty(0, t)]) for k, t in enumerate((np.int64, np.uint64, np.uint64)))
        fresh = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.empty(0, dtype=bool)
        place, key, context = place[fresh], key[fresh], context[fresh]
        doc = np.searchsorted(offsets, place, "right") - 1
        # Of many equal contexts in one text (it repeats itself) the first, the last and some between cover the same bytes.
        order = np.lexsort((place, context, doc))
        d, c, block = doc[order], context[order], place[order] // ((self.length + self.reach) // 2)
        alike = (d[1:] == d[:-1]) & (c[1:] == c[:-1])
        none = np.zeros(min(len(d), 1), dtype=bool)
        between = np.concatenate([none, alike & (block[1:] == block[:-1])]) & np.concatenate([alike, none])
        keep = order[~between]
        return doc[keep], place[keep] - offsets[doc[keep]], key[keep], context[keep]

    def _piece(self, data: np.ndarray, offsets: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of the strings that start in ``[at, at + PIECE)``."""
        length, reach = self.length, self.reach
        low, high = max(at - self.margin, 0), min(at + PIECE + 2 * self.margin, len(data))
        n = high - low - GRAM + 1
        grams = np.empty(n, dtype=np.uint64)
        raw = data[low:high].tobytes()
        for k in range(min(GRAM, n)):
            grams[k::GRAM] = np.frombuffer(raw, dtype="<u8", offset=k, count=-(-(n - k) // GRAM))
        grams = _mixed(grams)
        first, last = at - low, min(at + PIECE, len(data) - length + 1) - low
        # The place is in the low bits, so of equal hashes the leftmost is the smallest.
        numbered = (grams[first:last + reach] & ~np.uint64((1 << 22) - 1)) | np.arange(first, min(last + reach, n), dtype=np.uint64)
        least = (_sliding_min(numbered, reach + 1) & np.uint64((1 << 22) - 1)).astype(np.int64)
        # Strings that would run over the end of their text don't count.
        ends = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, low + last, "left") + 1]
        starts = offsets[np.searchsorted(offsets, ends, "left") - 1]
        over = np.zeros(len(least) + 1, dtype=np.int64)
        stop = np.minimum(ends - low - first, len(least))
        begin = np.clip(np.maximum(starts, ends - length + 1) - low - first, 0, len(least))
        np.add.at(over, begin, 1)
        np.add.at(over, np.maximum(stop, begin), -1)
        least = least[np.cumsum(over)[:-1] == 0]
        place = least[np.concatenate([[True], least[1:] != least[:-1]])] if len(least) else least
        total = np.concatenate([[np.uint64(0)], np.cumsum(grams * self.powers[:n], dtype=np.uint64)])

        def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return _mixed((total[b] - total[a]) * self.inverse[a])

        doc = np.searchsorted(offsets, place + low, "right") - 1
        left = np.minimum(place + low - offsets[doc], reach)
        right = np.minimum(offsets[doc + 1] - place - low, length)
        key = hashed(place, place + (length - reach - GRAM + 1))
        context = _mixed(hashed(place - left, place + right - GRAM + 1) + (left * (1 << 20) + right).astype(np.uint64))
        return place + low, key, context


def anchor_rows(docs: DataFrame, length: int, window: int) -> DataFrame:
    """``(key, context, doc, place)`` for ``(doc, text)``: every anchor with the hashes of what it is dealt by."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, window)
        for part in parts:
            text = part.column("text").cast(pa.large_binary())
            buffers = text.buffers()
            offsets = np.frombuffer(buffers[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(buffers[2], dtype=np.uint8)[:offsets[-1]] if len(text) and buffers[2] is not None else np.empty(0, np.uint8)
            doc, place, key, context = anchors.of(data, offsets) if len(text) else (np.empty(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), part.column("doc").take(pa.array(doc)),
                                              pa.array(place.astype(np.int32))], names=["key", "context", "doc", "place"])

    return docs.select("doc", "text").filter(F.octet_length("text") >= length).mapInArrow(rows, "key long, context long, doc long, place int")


def repeated_offsets(keys: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of many different contexts the first and the last offset of a string it shares, -1 where there is none.

    ``lefts`` are read from the anchor backwards.
    """
    n = len(keys)
    orders = [deep_shallow(strings, keys, -(-most // 8) * 8) for strings, most in ((rights, length), (lefts, reach))]
    most = []
    for order, common in orders:
        best = np.empty(n, dtype=np.int64)
        best[order] = np.maximum(common, np.append(common[1:], -1))
        most.append(best)
    first, last = np.full(n, -1), np.full(n, -1)
    for o in range(reach + 1):
        near = np.flatnonzero((most[0] >= length - o) & (most[1] >= o))
        if len(near) < 2:
            continue
        label = np.empty((2, n), dtype=np.int64)
        for k, depth in enumerate((length - o, o)):
            order, common = orders[k]
            label[k, order] = np.cumsum(common < depth)
        pair = label[0, near] * (n + 1) + label[1, near]
        _, code, count = np.unique(pair, return_inverse=True, return_counts=True)
        shared = near[count[code] > 1]
        first[shared] = np.where(first[shared] < 0, o, first[shared])
        last[shared] = o
    return first, last


def contexts_of(members: DataFrame, docs: DataFrame, length: int, window: int) -> DataFrame:
    """``(key, context, single, before, after)``: the bytes around the anchors of ``members``, those before it backwards."""
    lists = members.groupBy("doc").agg(F.collect_set(F.struct("key", "context", "single", "place")).alias("anchors"))
    lists = stored(lists, "anchors_by_text")
    texts = with_bitmap(docs, lists, "doc").filter("there").dropDuplicates(["doc"])
    reach = window - GRAM

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        kinds = pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "context", "single", "before", "after"])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for text, anchors in zip(part.column("text"), part.column("anchors")):
                data = text.as_py().encode()
                for a in anchors.as_py():
                    at = a["place"]
                    out.append((a["key"], a["context"], a["single"], data[max(at - reach, 0):at][::-1], data[at:at + length]))
                if len(out) >= 5000:
                    yield table(out)
                    out = []
            yield table(out)

    return texts.join(lists, "doc").select("text", "anchors").mapInArrow(cut, "key long, context long, single boolean, before binary, after binary")


def sorted_repeats(contexts: DataFrame, length: int, window: int) -> DataFrame:
    """``(context, first, last)``: shared offsets of contexts, found by sorting each group of one key in a task."""
    reach = window - GRAM

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        keys = rows.column("key").to_numpy()
        first, last = repeated_offsets(keys, rows.column("before").to_pylist(), rows.column("after").to_pylist(), length, reach)
        there = (first >= 0) & rows.column("single").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(rows.column("context").to_numpy()[there]), pa.array(first[there].astype(np.int32)),
                                           pa.array(last[there].astype(np.int32))], names=["context", "first", "last"])

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in parts:
            held, n = held + [part], n + part.num_rows
            if n < SORTED_ROWS:
                continue
            keys = part.column("key").to_numpy()
            cut = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1]) if len(keys) else 0
            if cut:  # the last key may go on in the next batch
                yield settle(held[:-1] + [part.slice(0, cut)])
                held = [part.slice(cut)]
                n = held[0].num_rows
        if n:
            yield settle(held)

    dealt = contexts.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(search, "context long, first int, last int")


def counted_repeats(contexts: DataFrame, length: int, window: int) -> DataFrame:
    """The same for groups too large for one task: every string through an anchor is a row, and equal ones are counted.

    Only strings with one offset are compared, as two anchors of one place in a text have some in common.
    """
    reach = window - GRAM

    def strings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 200):
                rows = []
                for key, context, before, after in zip(*[part.slice(at, 200).column(c).to_pylist() for c in ("key", "context", "before", "after")]):
                    around, n = before[::-1] + after, len(before)
                    rows += [(key, xxhash.xxh3_64_intdigest(around[n - o:n - o + length]) - (1 << 63), context, o)
                             for o in range(max(0, length - len(after)), min(n, reach) + 1)]
                columns = list(zip(*rows)) or [()] * 4
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "string", "context", "offset"])

    rows = stored(contexts.mapInArrow(strings, "key long, string long, context long, offset int"), "strings")
    repeated = rows.groupBy("key", "string", "offset").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(repeated, ["key", "string", "offset"]).groupBy("context").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """``(doc, spans)`` for ``(doc, text)``: per text with repeats the ranges ``(start, end)`` that they cover, in bytes.

    Ranges may overlap, and may run over the end of the text. Rows of one ``doc`` must have one text.
    """
    window = max(3 * length // 4, GRAM)
    reach = window - GRAM
    anchors = stored(anchor_rows(docs, length, window), "anchors")
    shared = anchors.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    anchors = stored(anchors.join(shared, "key"), "shared_anchors")
    classes = stored(anchors.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("at")), "classes")
    groups = classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("n").alias("least")).filter("classes > 1 AND least = 1")
    members = classes.join(groups, "key").select(
        "key", "context", (F.col("n") == 1).alias("single"), "at.doc", "at.place", (F.col("classes") > HOT_CLASSES).alias("hot"))
    members = stored(members, "members")
    found = sorted_repeats(contexts_of(members.filter("NOT hot"), docs, length, window), length, window)
    found = found.union(counted_repeats(contexts_of(members.filter("hot"), docs, length, window), length, window))
    copies = classes.filter("n > 1").select("context", F.lit(0).alias("first"), F.lit(reach).alias("last"))
    spans = anchors.select("context", "doc", "place").join(copies.union(found), "context").select(
        "doc", F.struct(F.greatest(F.col("place") - F.col("last"), F.lit(0)).alias("start"), (F.col("place") + length - F.col("first")).alias("end")).alias("span"))
    return spans.groupBy("doc").agg(F.collect_set("span").alias("spans"))


def merged_spans(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], min(s["end"], size)) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for every row: the removed ranges ``(start, end)`` and the bytes that are left."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(doc_id).isNull(), body).alias("doc"), body.alias("text"))
    spans = stored(repeated_spans(rows.select("doc", "text"), length), "spans")
    kind = "array<struct<start: int, end: int>>"

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            merged, kept = [], []
            for text, found in zip(part.column("text"), part.column("spans")):
                data = text.as_py().encode()
                runs = merged_spans(found.as_py() or [], len(data))
                merged.append([{"start": s, "end": e} for s, e in runs])
                edges = [0, *[x for run in runs for x in run], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.compute.binary_length(part.column("text")).cast(pa.int64()),
                 pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    # Only texts that may have spans are dealt.
    flagged = with_bitmap(rows, spans, "doc")
    likely = flagged.filter("there").join(spans, "doc", "left").select("doc_id", "text", "spans")
    changed = likely.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans {kind}, kept binary")
    return changed.union(flagged.filter("NOT there").select(
        "doc_id", F.octet_length("text").cast("long"), F.array().cast(kind), F.col("text").cast("binary")))
