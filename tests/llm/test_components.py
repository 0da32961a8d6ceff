"""Components against a plain union of sets."""

import random

import numpy as np
import pytest

from latticeflow.llm.components import components, stars


def plain(edges):
    low = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            low.setdefault(a, a)
            low.setdefault(b, b)
    while True:
        before = dict(low)
        for a, b in edges:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return sorted(low.items())


def test_stars():
    u, v = np.array([5, 5, 9, 3, 7, -2]), np.array([3, 2, 7, 1, 9, -5])
    assert sorted(zip(*map(np.ndarray.tolist, stars(u, v)), strict=True)) == [(-2, -5), (2, 1), (3, 1), (5, 1), (9, 7)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, kind):
    g = random.Random(5)
    edges = [(g.randrange(-400, 400), g.randrange(-400, 400)) for _ in range(350)]
    edges += [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)] + [(None, 1), (2, 2), (1000, 1001)]
    if kind == "string":
        edges = [(None if a is None else f"k{a:06d}", f"k{b:06d}") for a, b in edges]
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(5)
    assert sorted(map(tuple, components(df, "a", "b").collect())) == plain(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()
