"""Ranked search against a scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest

from siftwell.llm import ranked_search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    tokens = lambda t: PATTERN.findall((t or "").translate(LOWER))
    counted = [(i, Counter(tokens(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, length = len(counted), sum(x for _, _, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(tokens(t))
    out = []
    for item, terms in queries.items():
        scores = []
        for i, c, size in counted:
            m = 10 + 90 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0 and i is not None:
                scores.append((i, score))
        out += [(item, r + 1, i, s) for r, (i, s) in enumerate(sorted(scores, key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [200_000, 25])
def test_same_as_scoring_all(spark, block, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_TERMS", block)
    pick = random.Random(7)
    words = ["Straße", "STRASSE", "x1", "X1", "mid-way", "日本語", "a", "b_c", "\x00n"] + [f"t{k}" for k in range(60)]
    docs = [(k, " ".join(pick.choices(words, weights=range(len(words), 0, -1), k=pick.choice([3, 8, 8, 8, 30, 200])))) for k in range(700)]
    docs += [(k, docs[5][1]) for k in range(700, 900)] + [(7, "t59"), (7, "t59"), (None, "t59 t58"), (901, None), (902, " .,; ")]
    items = [(k, " ".join(pick.choices(words, k=pick.randrange(1, 12)))) for k in range(30)] + [(3, "t59 t59"), (None, "a t40"), (40, "nothing here"), (41, None), (42, docs[5][1])]
    found = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                 spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, 10)


def test_strata_far_below_the_last_place_are_not_visited(spark):
    import numpy as np

    m = np.repeat([10, 500, 5000], 20)
    doc = np.arange(60)
    strata = ranked_search.Strata(m, np.zeros(60, np.int64), doc, np.full(60, 3), np.array([700]))
    visit, visited = strata.search(np.array([0]), 0), []
    try:
        found, scores = next(visit)
        while True:
            visited.append(found.tolist())
            found, scores = visit.send(int(scores.min()))
    except StopIteration:
        pass
    assert visited == [list(range(20))]


def test_odd_input(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "river mill two"), (2, "word5x5"), (3, None)], "item_id int, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = sorted(map(tuple, ranked_search.search(odd_docs, items).collect()), key=repr)
    assert found == brute(rows, [tuple(r) for r in items.collect()], 10)
    assert ranked_search.search(no_docs, items).count() == 0
    assert ranked_search.search(odd_docs, items.filter("false")).count() == 0
