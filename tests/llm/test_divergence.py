"""The audit of sources against a brute force from its definition."""

import random
import re
from collections import Counter
from itertools import product

from siftwell.llm.divergence import source_divergence

PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs = [(lang, source, Counter(PATTERN.findall(text.translate(LOWER)))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in docs}:
        own = [(s, c) for x, s, c in docs if x == lang]
        df = Counter(t for _, c in own for t in c)
        kept = [t for t in df if df[t] >= least_docs]
        count = {s: Counter() for s, _ in own}
        for s, c in own:
            count[s].update({t: c[t] for t in kept if c[t]})
        everything = sum(count.values(), Counter())

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(everything)
        for s in count:
            others = [(x, sum((p[s][t] - p[x][t]) ** 2 // (p[s][t] + p[x][t]) for t in kept)) for x in count if x != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", others, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_cells_give_the_divergence_of_whole_sources(spark):
    pick = random.Random(3)
    words = ["Über", "ÜBER", "a", "B", "b", "c7d", "e-f", "ж", "日本", "zz", "\x00q", "tie", "bound"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(pick.choices(words, k=pick.randrange(40))), lang, f"s{k}") for lang, k in product(["de", "en", None], range(9)) for _ in range(5)]
    rows += [(None, "de", "empty"), ("", "fr", "alone"), ("one two", "fr", None), ("tie", None, None)] + [(" ".join(words), "en", "hot")] * 60
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for blocks in ({"group_block": 2, "term_block": 5}, {}):
        found = source_divergence(docs, least_docs=4, top_terms=6, **blocks)
        assert sorted(map(tuple, found.collect())) == brute(rows, 4, 6)
    assert source_divergence(docs, least_docs=1000).filter("value <> 0 OR part <> 'pair'").count() == 0


def test_odd_input(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert sorted(map(tuple, source_divergence(odd_docs, least_docs=2).collect())) == brute(rows, 2, 10)
    assert source_divergence(no_docs).count() == 0
