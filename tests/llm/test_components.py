"""Connected components against a plain union-find, with a hub whose rows go by broadcast."""

import random

import pytest

from palimpsest.llm import components as C


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hot", [1000, 5])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(C, "HOT_LEAST", hot)
    monkeypatch.setattr(C, "HOT_SHARE", 20)
    random.seed(hot)
    hub = [(500, random.randrange(501, 900)) for _ in range(300)] + [(k, 499) for k in range(900, 1000)]
    path = [(k, k + 1) for k in range(2000, 2040)]
    pairs = [(random.randrange(3000, 3400), random.randrange(3000, 3400)) for _ in range(150)]
    edges = [*hub, (499, 500), *path, *pairs, (7, 7), path[0]]
    got = C.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()
    want = plain([(a, b) for a, b in edges if a != b])
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["root"] for r in got} == want
    assert C.components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


def test_hot_keys_meet_the_same_values(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_LEAST", 2)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 1), (3, 2), (4, 9)], "k long, x long")
    values = spark.createDataFrame([(1, 10, 50), (2, 20, 1), (3, 30, 2), (5, 50, 0)], "key long, value long, n long")
    got = sorted(tuple(r) for r in C.with_value(rows, "k", values, 54).collect())
    assert got == sorted([(1, i, 10) for i in range(50)] + [(2, 0, 20), (3, 1, 30), (3, 2, 30)])
