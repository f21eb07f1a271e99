"""The number of pairs that a large family of near copies makes."""

import random

from siftwell.llm import near_copies


def test_a_family_makes_pairs_in_proportion_to_its_size(spark, monkeypatch):
    pick, n = random.Random(5), 160
    base, rows = [f"w{i}" for i in range(150)], []
    for key in range(n):
        text = list(base)
        for at in pick.sample(range(5, 145), 2):
            text[at] = f"x{key}y{at}"
        rows.append((key, " ".join(text)))
    texts = spark.createDataFrame(rows, "key long, text string").repartition(2)
    made, roots = {}, {}
    exact = near_copies.similar_links

    for leads in (near_copies.LEADS, 0):  # without leads all pairs of the family are compared at once
        counts = []

        def counted(pairs, *args, counts=counts):
            counts.append(pairs.count())
            return exact(pairs, *args)

        monkeypatch.setattr(near_copies, "similar_links", counted)
        monkeypatch.setattr(near_copies, "LEADS", leads)
        roots[leads] = sorted(tuple(r) for r in near_copies.near_copy_roots(texts).collect())
        made[leads] = sum(counts)
    assert roots[3] == roots[0] == [(k, 0) for k in range(n)]
    assert made[3] < 12 * n < made[0]
