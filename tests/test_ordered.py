"""Bucketed windows against plain Python on data where one key holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.choice([None, "a", "b", "c"]), rng.randrange(9)) for i in rng.sample(range(3000), 1500)]
    return data, spark.createDataFrame(data, "k string, o long, v string, n int").repartition(7).cache()


def per_key(data):
    groups = {}
    for row in sorted(data, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups



def bucket():
    return O.block_bucket(F.col("o"), 100)


def test_number_rows(rows):
    data, df = rows
    got = {(r.k, r.o): r.p for r in O.number_rows(df, ["k"], bucket(), [F.col("o")], "p").collect()}
    assert got == {(k, r[1]): i + 1 for k, g in per_key(data).items() for i, r in enumerate(g)}


def test_number_rows_without_key(rows):
    data, df = rows
    got = {r.o: r.p for r in O.number_rows(df, [], bucket(), [F.col("o")], "p").collect()}
    assert got == {r[1]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: r[1]))}


def test_running_sum(rows):
    data, df = rows
    got = {(r.k, r.o): r.s for r in O.running_sum(df, ["k"], bucket(), [F.col("o")], {"s": F.col("n")}).collect()}
    expected = {}
    for k, group in per_key(data).items():
        total = 0
        for r in group:
            total += r[3]
            expected[k, r[1]] = total
    assert got == expected


def test_carry_forward_and_before(rows):
    data, df = rows
    got = {(r.k, r.o): (r.c, r.b.c if r.b else "first") for r in O.carry_forward(df, ["k"], bucket(), [F.col("o")], {"c": F.col("v")}, before="b").collect()}
    expected = {}
    for k, group in per_key(data).items():
        known, before = None, "first"
        for r in group:
            known = r[2] or known
            expected[k, r[1]] = (known, before)
            before = known
    assert got == expected


def test_previous_values(rows):
    data, df = rows
    got = {(r.k, r.o): r.p for r in O.previous_values(df, ["k"], bucket(), [F.col("o")], {"p": F.col("o")}).collect()}
    assert got == {(k, r[1]): (g[i - 1][1] if i else None) for k, g in per_key(data).items() for i, r in enumerate(g)}


def test_first_last_top(rows):
    data, df = rows
    groups = per_key(data)
    assert {r.k: r.o for r in O.first_rows(df, ["k"], [F.col("o")]).collect()} == {k: g[0][1] for k, g in groups.items()}
    assert {r.k: r.o for r in O.last_rows(df, ["k"], [F.col("o")]).collect()} == {k: g[-1][1] for k, g in groups.items()}
    top = O.top_rows(df, ["k"], [F.col("o").desc()], 3)
    assert {(r.k, r.o) for r in top.collect()} == {(k, r[1]) for k, g in groups.items() for r in g[-3:]}
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
