"""Near-duplicate vectors against comparing all pairs."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd

from groundloom.llm import embedding_dedup as ed
from groundloom.llm.hnsw import Graph


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(data):
    least = {k: k for k, _ in data if k is not None}
    links = [0] * len(data)

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if sound(v) else None for _, v in data]
    for i, (a, _) in enumerate(data):
        for j in range(i):
            b = data[j][0]
            if a is None or b is None or units[i] is None or units[j] is None or len(units[i]) != len(units[j]):
                continue
            if units[i] @ units[j] >= 0.95:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(a), top(b)))
                least[y] = x
    return sorted(((k, n, None if k is None else top(k), k is None or top(k) == k) for (k, _), n in zip(data, links, strict=True)), key=str)


def test_links(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(ed, "LEAST_SHARDS", 3)
    walks = []
    monkeypatch.setattr(ed, "audited_beam", lambda *a, inner=ed.audited_beam: (walks.append(inner(*a)), walks[-1])[1])
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=16) for _ in range(300)]
    center = rng.normal(size=16)
    vectors += [center + 0.08 * rng.normal(size=16) for _ in range(150)]
    vectors += [vectors[5]] * 6 + [2 * vectors[6], -vectors[6], np.zeros(16), np.full(16, -0.0)]
    data = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    data += [(9001, None), (9002, [None] + [1.0] * 15), (9003, [math.nan] * 16), (9004, [math.inf] + [0.0] * 15), (9005, []), (9006, [1.0, 2.0]), (9007, [1.0, 2.0001]), (None, data[5][1]), (3, data[3][1]), (9008, [0.0, 1.0]), (9009, [-0.0, 1.0])]
    random.Random(1).shuffle(data)
    rows = spark.createDataFrame([(k, v, "clash", 1) for k, v in data], "vec_id long, embedding array<double>, n_links string, kept int").repartition(4)
    got = sorted((tuple(r) for r in ed.near_vectors(rows).collect()), key=str)
    assert got == brute(data)
    assert walks and walks[0] in ed.BEAMS


def sparse(n, dim=24, every=100):
    """One vector in ``every`` has one partner, all others none."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(n, dim))
    for i in range(0, n, every):
        vectors[i + 1] = vectors[i] + 0.03 * rng.normal(size=dim)
    return vectors


def test_recall_where_links_are_rare(spark, monkeypatch):
    """Graphs are walked, the audit counts links of other vectors only, and goes on until it holds enough of them."""
    monkeypatch.setattr(ed, "AUDIT", 256)
    monkeypatch.setattr(ed, "AUDIT_LINKS", 60)
    sizes, shards = [], []
    monkeypatch.setattr(ed, "_met", lambda q, g, s, b, fn, schema, inner=ed._met: (sizes.append(q.count()), shards.append(s), inner(q, g, s, b, fn, schema))[2])
    vectors = sparse(6000)
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    found = {r.vec_id for r in ed.near_vectors(rows).collect() if r.n_links}
    truth = {k for i in range(0, 6000, 100) for k in (i, i + 1)}
    assert found <= truth and len(found) >= 0.99 * len(truth)
    # Each shard is larger than four of the widest beams' quarter, so it is walked; the audit grew from 256 queries.
    assert 6000 / shards[0] > 4 * ed.BEAMS[0] and sizes[0] < 400 and sizes[-2] > 1000


def test_self_hits_are_no_links():
    own = np.array([5, 6, 7])
    slices = [(np.array([0, 0, 1]), np.array([0, 1, 1])), (np.array([2]), np.array([2]))]
    assert ed._links(slices, own, np.array([5, 6, 7]), np.array([1, 3, 1])).tolist() == [3, 0, 0]


def test_rows_of_a_graph_are_small(monkeypatch):
    """A graph is kept in rows of bounded size, and a task gets it back whole whatever their order."""
    monkeypatch.setattr(ed, "PIECE_BYTES", 1000, raising=False)
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"place": rng.permutation(700), "rep": np.arange(700), "n": 2, "shard": 3, "vec": list(rng.normal(size=(700, 16)))})
    kept = ed._build(rows)
    assert max(sum(len(x) for x in row if isinstance(x, bytes)) for row in kept.itertuples(index=False)) <= 1000
    graph, vectors, reps, weights, own, units = ed._cell(rows, kept.sample(frac=1, random_state=1))
    order = rows.sort_values(["place", "rep"])
    assert reps.tolist() == order["rep"].tolist() and set(weights) == {2} and own.tolist() == list(range(700))
    want = Graph(units[order["rep"].to_numpy()])
    assert np.array_equal(vectors, units[reps]) and all((a.links == b.links).all() for a, b in zip(graph.layers, want.layers, strict=True))


def test_blocks_of_many_queries():
    """Every block meets a copy of every graph, so blocks grow before more of them are made."""
    assert [ed._blocks(n) for n in (0, 1, 51_282, 120_000, 615_384)] == [1, 1, 4, 8, 10]


def test_small_tables_walk_graphs():
    """The smallest test tables give shards of more vectors than four of the narrowest beam."""
    for count in (500, 1000, 2000, 60_000):
        shards = max(1, min(ed.LEAST_SHARDS, count // ed.LEAST_VECTORS))
        assert count / shards >= 8 * ed.BEAMS[0] - 1


def test_empty(spark):
    assert ed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(4000, 32))
    near = vectors[:500] + 0.05 * rng.normal(size=(500, 32))
    every = np.concatenate([vectors, near])
    every /= np.linalg.norm(every, axis=1)[:, None]
    order = rng.permutation(len(every))
    graph = Graph(every[order])
    queries = every[:500]
    truth = queries @ every[order].T >= 0.95
    ids, sims = graph.search(queries, 32)
    assert (sims >= 0.95).sum() >= 0.99 * truth.sum()
    q, p = (np.concatenate(x) for x in zip(*ed._walked(graph, queries, every[order], 0.95, 32), strict=True))
    assert len(q) >= 0.99 * truth.sum() and truth[q, p].all()


def test_memory_of_a_large_group(monkeypatch):
    """A group of near copies has all its pairs counted, but they are never held at once."""
    monkeypatch.setattr(ed, "CELLS", 1 << 16, raising=False)
    rng = np.random.default_rng(4)
    n = 1200
    vectors = rng.normal(size=16) + 0.01 * rng.normal(size=(n, 16))
    queries = pd.DataFrame({"rep": np.arange(n), "vec": list(vectors)})
    shard = ed._build(queries.assign(place=rng.permutation(n), n=1, shard=0))
    tracemalloc.start()
    got = ed._search(0.95, ed.BEAMS[0])(queries, shard)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = got[got["other"].isna()]
    assert sorted(counts["rep"]) == list(range(n)) and (counts["links"] == n - 1).all()
    assert len(got) == 2 * n - 1
    print(f"peak {peak / 1e6:.1f} MB")
    assert peak < 50e6
