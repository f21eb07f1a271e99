"""Repeated strings against a count of all of them, and the sorter against Python's sort."""

import hashlib
import os.path
import random
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import deep_shallow, substring_dedup
from siftwell.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(hashlib.md5(d[k:k + length]).digest() for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=int)
        for k in range(len(d) - length + 1):
            if count[hashlib.md5(d[k:k + length]).digest()] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        covered = np.cumsum(gone)[:-1] > 0 if len(d) else np.zeros(0, dtype=bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        spans = [tuple(x) for x in edges.reshape(-1, 2).tolist()]
        out.append((len(d), spans, bytes(np.frombuffer(d, np.uint8)[~covered])))
    return out


def test_sorter():
    pick = random.Random(1)
    stem = bytes(pick.randrange(97, 99) for _ in range(400))
    strings = [stem[:pick.randrange(401)] + bytes(pick.randrange(97, 99) for _ in range(pick.randrange(6))) for _ in range(1500)]
    strings = [s[:400] for s in strings] + [b"", b"", stem, stem, b"a\0", b"a", b"a\0\0"]
    classes = np.array([pick.randrange(3) for _ in strings])
    order, common = deep_shallow.deep_shallow(strings, classes, 400)
    want = sorted(range(len(strings)), key=lambda k: (classes[k], strings[k]))
    assert [(classes[k], strings[k]) for k in order] == [(classes[k], strings[k]) for k in want]
    assert common.tolist() == [-1] + [len(os.path.commonprefix([strings[a], strings[b]])) if classes[a] == classes[b] else -1 for a, b in zip(order, order[1:])]


def made_texts():
    """Shared passages at every length about the limit, edits, repeats inside a text, periods, and copies."""
    pick = random.Random(5)

    def noise(n):
        return "".join(pick.choices("abcdefgh é日", k=n))

    passages = [noise(n) for n in (15, 16, 17, 20, 30, 31, 60, 200)]
    texts = [noise(pick.randrange(40)) + p + noise(pick.randrange(40)) for p in passages for _ in range(4)]
    texts += [p[:-1] for p in passages] + [p[1:] for p in passages] + [p[3:20] + noise(3) + p[18:] for p in passages]
    texts += ["a" * 90, "ab" * 60, "abc" * 400, noise(10) + "a" * 40 + noise(10), "x" * 15, "x" * 16, "x" * 17, "", None, passages[0]]
    copied = noise(300)
    for _ in range(120):
        at = pick.randrange(300)
        texts.append(copied[:at] + pick.choice("abcdefgh") + copied[at + 1:])
    return texts + [noise(50)] * 2 + [noise(3000)]


@pytest.mark.parametrize("hot", [2000, 5])
def test_same_as_counting_all_strings(spark, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_CLASSES", hot)
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    monkeypatch.setattr(substring_dedup, "SORTED_ROWS", 300)
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in substring_dedup.remove_repeats(docs, length=16).collect()}
    want = dict(enumerate(brute(texts, 16)))
    assert got == want


def test_query_on_the_smallest_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = {(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
            for (i, _), (n, spans, kept) in zip(docs, brute([t for _, t in docs], 400))}
    got = QUERIES["op12_suffix_dedup"](spark, FOLDER)
    assert {tuple(r) for r in got.collect()} == want and sum(r[2] for r in want) > 0


def test_odd_input(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 60))), key=repr)
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in substring_dedup.remove_repeats(odd_docs, length=60).collect()]
    assert sorted(got, key=repr) == want
    assert substring_dedup.remove_repeats(no_docs).count() == 0
