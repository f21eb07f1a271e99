"""Ranked lexical search over a length-stratified index.

A document's normaliser ``m`` grows with its length; documents with equal ``m`` form a stratum. Inside a
stratum an occurrence count decides a posting's impact, so impacts are computed once per stratum and
count, and the largest count of a term bounds what the stratum can add to a score. A query visits the
strata by falling bound and stops when its last place can no longer be reached.

The index is a table of documents (terms that any query may want, with their counts), dealt by ranges of
``m``; where many documents share one ``m``, a hash of the document splits the stratum. Every task keeps
the best documents per query and passes its places on from batch to batch, so visits get fewer as it
goes. Queries are shipped in blocks of bounded size. Which words queries may want is known from a bitmap
of fixed size; a word that is in it by chance costs a posting and changes nothing.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case.
Results for odd input: null and empty texts have no term, are not counted and match nothing; rows of one
item id are one query, a null id is one as well; rows without document id count in the statistics but are
not returned; repeated rows are documents of their own; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored
from .terms import LETTERS_AND_DIGITS, split_terms

SLOTS = 1 << 23  # bits of the bitmap of wanted words: one megabyte
QUERY_TERMS = 200_000  # pairs of query and term in a block of queries, about
SEED = 42  # of the hash of words, as xxhash64 has it
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``(item_id, term)``: the distinct terms of every item as hashes."""
    found = F.expr(f"regexp_extract_all(lowered, '{TERM.replace(chr(92), chr(92) * 2)}', 0)")
    rows = items.select(F.col(item_id).alias("item_id"), F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER).alias("lowered"))
    return rows.select("item_id", F.explode(F.array_distinct(found)).alias("word")).select("item_id", F.xxhash64("word").alias("term")).distinct()


def wanted_words(terms: DataFrame) -> np.ndarray:
    """The bitmap of the terms' hashes, as bytes."""
    slot = F.pmod(F.col("term"), F.lit(SLOTS)) + 1
    rows = terms.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    bitmap = np.zeros(SLOTS // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        start = (r["bucket"] - 1) * len(part)
        bitmap[start:start + len(part)] |= part
    return bitmap


def document_terms(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``(doc_id, n, terms, counts)`` for ``(doc_id, text)``: all terms are counted in ``n``, only wanted ones are listed."""

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}  # number of a word, -1 for unwanted ones
        hashes: list[int] = []
        for part in parts:
            if len(known) > 1_000_000:
                known.clear()
                hashes.clear()
            n, ends, terms, counts = [], [0], [], []
            for text in part.column(1):
                words = split_terms(text.as_py(), LETTERS_AND_DIGITS)
                for w in set(words).difference(known):
                    h = xxhash.xxh64_intdigest(w, SEED)
                    slot = h % SLOTS
                    if bitmap[slot >> 3] >> (slot & 7) & 1:
                        known[w] = len(hashes)
                        hashes.append(h - (1 << 64) if h >> 63 else h)
                    else:
                        known[w] = -1
                ids = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
                term, count = np.unique(ids[ids >= 0], return_counts=True)
                n.append(len(words))
                ends.append(ends[-1] + len(term))
                terms.append(term)
                counts.append(count)
            names = np.array(hashes or [0], dtype=np.int64)
            flat = np.concatenate(terms or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names[flat])),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(counts or [np.empty(0, np.int64)])))],
                names=["doc_id", "n", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n long, terms array<long>, counts array<long>")


def normaliser(n: Column, n_docs: int, length: int) -> Column:
    """``100 - 90 + (90 * n * N) div L``: 100 for a document of mean length."""
    return F.lit(10).cast("long") + F.call_function("div", n * F.lit(90).cast("long") * F.lit(n_docs).cast("long"), F.lit(max(length, 1)).cast("long"))


class Strata:
    """The postings of one batch of documents by stratum and term, most frequent first."""

    def __init__(self, m: np.ndarray, term: np.ndarray, doc: np.ndarray, count: np.ndarray, weight: np.ndarray):
        self.levels, stratum_of = np.unique(m, return_inverse=True)
        stratum, self.width = stratum_of[doc], len(weight)
        # One impact per stratum and count.
        key, at = np.unique(np.stack([stratum, count]), axis=1, return_inverse=True)
        impact = (1_000_000_000 * key[1]) // (1000 * key[1] + 8 * self.levels[key[0]])
        order = np.lexsort((doc, -count, stratum * self.width + term))
        self.lists = (stratum * self.width + term)[order]
        self.doc, self.gain = doc[order], (weight[term] * impact[at.ravel()])[order]
        self.starts = np.flatnonzero(np.concatenate([[True], self.lists[1:] != self.lists[:-1]])) if len(self.lists) else np.empty(0, np.int64)
        self.ends = np.append(self.starts[1:], len(self.lists))
        # What the most frequent posting of a term gives bounds its stratum.
        self.heads, self.bounds = self.lists[self.starts], self.gain[self.starts]

    def search(self, terms: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents and scores, stratum by stratum by falling bound; send the score of the last place to go on."""
        wanted = (np.arange(len(self.levels))[:, None] * self.width + terms).ravel()
        at = np.minimum(np.searchsorted(self.heads, wanted), max(len(self.heads) - 1, 0))
        there = self.heads[at] == wanted if len(self.heads) else np.zeros(len(wanted), dtype=bool)
        bounds = np.where(there, self.bounds[at] if len(self.heads) else 0, 0).reshape(len(self.levels), -1)
        at, there = at.reshape(bounds.shape), there.reshape(bounds.shape)
        total = bounds.sum(axis=1)
        for s in np.argsort(-total, kind="stable"):
            if total[s] < max(least, 1):
                return
            lists = at[s][there[s]]
            places = np.concatenate([np.arange(a, b) for a, b in zip(self.starts[lists], self.ends[lists])])
            doc, back = np.unique(self.doc[places], return_inverse=True)
            score = np.zeros(len(doc), dtype=np.int64)
            np.add.at(score, back, self.gain[places])
            least = yield doc, score


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` first by falling score and rising id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def block_tops(index: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """``(query, doc_id, score)``: for every task the ``k`` best documents of each query of one block.

    ``queries`` has a row per query and term with the term's weight; ``index`` rows come with ``m``.
    """
    words, code = np.unique(queries["term"].to_numpy(dtype=np.int64), return_inverse=True)
    weight = np.zeros(len(words), dtype=np.int64)
    weight[code] = queries["weight"].to_numpy(dtype=np.int64)
    number = queries["query"].to_numpy(dtype=np.int64)
    order = np.argsort(number, kind="stable")
    names, first = np.unique(number[order], return_index=True)
    of_query = np.split(code[order], first[1:])

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {int(q): (np.empty(0, np.int64), np.empty(0, np.int64)) for q in names}
        for part in parts:
            lists = part.column("terms")
            term, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            at = np.minimum(np.searchsorted(words, term), len(words) - 1)
            wanted = words[at] == term
            doc = np.repeat(np.arange(len(size)), size)[wanted]
            ids = part.column("doc_id").to_numpy()
            strata = Strata(part.column("m").to_numpy(), at[wanted], doc, part.column("counts").flatten().to_numpy()[wanted], weight)
            for q, terms in zip(names.tolist(), of_query):
                top, scores = held[q]
                visit = strata.search(terms, int(scores[-1]) if len(top) == k else 0)
                least = None
                while True:
                    try:
                        found, gained = visit.send(least)
                    except StopIteration:
                        break
                    top, scores = best(np.concatenate([top, ids[found]]), np.concatenate([scores, gained]), k)
                    least = int(scores[-1]) if len(top) == k else 0
                held[q] = top, scores
        out = [(q, t, s) for q, (top, scores) in held.items() for t, s in zip(top.tolist(), scores.tolist()) if s > 0]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["query", "doc_id", "score"])

    return index.mapInArrow(search, "query long, doc_id long, score long")


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int, int]:
    """The stored table ``(doc_id, n, terms, counts)``, the number of documents with terms and their length in all."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index = stored(document_terms(rows, wanted_words(terms)), "index")
    n_docs, length = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return index, n_docs, length


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents with the highest scores above 0 for every item."""
    terms = stored(query_terms(items, item_id, item_text), "query_terms")
    index, n_docs, length = build_index(docs, terms, doc_id, text)
    found = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    query = F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("item_id").isNull())
    weighted = stored(terms.join(found, "term").select("item_id", query.alias("query"), "term", weight.alias("weight")), "weighted")

    blocks = max(1, -(-weighted.count() // QUERY_TERMS))
    dealt = index.filter("n > 0 AND size(terms) > 0 AND doc_id IS NOT NULL").withColumn("m", normaliser(F.col("n"), n_docs, length))
    dealt = dealt.withColumn("salt", F.xxhash64("doc_id")).repartitionByRange("m", "salt").sortWithinPartitions("m")
    dealt = dealt.select("doc_id", "m", "terms", "counts")
    dealt = stored(dealt, "strata") if blocks > 1 else dealt  # dealt once, read by every block
    tops = None
    for block in range(blocks):
        part = weighted.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "term", "weight").toPandas()
        if len(part):
            found = block_tops(dealt, part, k)
            tops = found if tops is None else tops.union(found)
    named = weighted.groupBy("query").agg(F.first("item_id").alias("item_id"))
    if tops is None:
        tops = docs.sparkSession.createDataFrame([], "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    ranked = tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(named, "query").select("item_id", "rank", "doc_id", "score")
