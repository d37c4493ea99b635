"""Components against a plain union of edges, and the number of rounds."""

import random

import pytest

from groundloom.llm import components as module
from groundloom.llm.components import components


def brute(edges):
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            i, j = sorted((top(a), top(b)))
            above[j] = i
    return sorted((x, top(x)) for x in list(above))


@pytest.mark.parametrize("shape", ["random", "star", "odd", "empty"])
def test_against_union(spark, shape):
    rng = random.Random(shape)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "star": [(500, k) for k in range(400)] + [(k, 900 + k) for k in range(50)],
        "odd": [(1, 1), (2, None), (None, 3), (4, 5), (4, 5), (5, 4), (-7, 5), (8, 9)],
        "empty": [],
    }[shape]
    df = spark.createDataFrame([(a, b, 0, 0) for a, b in edges], "a long, b long, node long, n long")
    assert sorted(tuple(r) for r in components(df, "a", "b").collect()) == brute(edges)


def test_rounds_of_a_chain(spark, monkeypatch):
    """A chain of versions, each linked to the next, takes rounds by the logarithm of its length."""
    rounds = []
    monkeypatch.setattr(module, "stored", lambda df, purpose, inner=module.stored: (rounds.append(purpose), inner(df, purpose))[1])
    for n in (1000, 4000):
        rounds.clear()
        out = components(spark.range(n).selectExpr("id as a", "id + 1 as b"), "a", "b").collect()
        assert len(out) == n + 1 and all(r.component == 0 for r in out)
        assert rounds.count("edges") <= 25
