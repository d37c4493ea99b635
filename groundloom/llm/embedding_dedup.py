"""Near-duplicate vectors: graphs per shard, every shard searched for every vector, links verified, components united."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .components import components
from .hnsw import Graph

#: Bytes of a shard's vectors at most, shards at least and the vectors that each of these should have.
SHARD_BYTES, LEAST_SHARDS, LEAST_VECTORS = 1 << 26, 8, 128
#: Vectors per block of queries; from this number of blocks on, blocks grow up to so many times that before more are made, as every block
#: meets a copy of every graph.
BLOCK_VECTORS, BLOCKS, BLOCK_GROWTH = 1 << 14, 8, 4
#: Bytes of one row of a graph at most.
PIECE_BYTES = 1 << 19
GRAPH_SCHEMA = "dim int, shard int, kind int, piece int, data binary"
#: Beams to choose from, and the share of the audited links that the chosen one has to find.
BEAMS, RECALL = (16, 32, 64, 128, 256), 0.99
#: Queries that are audited at first, and links that an audit has to hold; with fewer, four times as many queries are audited.
AUDIT, AUDIT_LINKS = 2048, 200

#: Similarities that a slice of queries compares or finds at once, so that memory follows vectors and not pairs.
CELLS = 1 << 22


def _pieces(arrays: list[np.ndarray]) -> pd.DataFrame:
    """Arrays as rows of bounded size, by kind (the array's number) and piece."""
    rows = []
    for kind, a in enumerate(arrays):
        data = memoryview(np.ascontiguousarray(a).reshape(-1).view(np.uint8))
        rows += [(kind, piece, bytes(data[at : at + PIECE_BYTES])) for piece, at in enumerate(range(0, len(data), PIECE_BYTES))]
    return pd.DataFrame(rows, columns=["kind", "piece", "data"])


def _whole(pieces: pd.DataFrame) -> list[bytes]:
    """The arrays' bytes, by kind."""
    held = pieces.sort_values(["kind", "piece"])
    return [b"".join(own) for _, own in held.groupby("kind")["data"]]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard, in an order of insertion given by the vectors' hashes: classes, their weights, unit vectors, and links by layer."""
    pdf = pdf.sort_values(["place", "rep"])
    vectors = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    graph = Graph(vectors)
    rows = _pieces([pdf["rep"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), vectors, *(layer.links for layer in graph.layers)])
    rows.insert(0, "dim", vectors.shape[1])
    rows.insert(1, "shard", pdf["shard"].iloc[0])
    return rows


def _exact(queries: np.ndarray, vectors: np.ndarray, threshold: float):
    """All pairs (query, point) that reach the threshold, by comparing with the whole shard in slices."""
    step = max(1, CELLS // len(vectors))
    for at in range(0, len(queries), step):
        q, p = np.nonzero(queries[at : at + step] @ vectors.T >= threshold)
        yield q + at, p


def _walked(graph: Graph, queries: np.ndarray, vectors: np.ndarray, threshold: float, beam: int):
    """Verified pairs (query, point) in slices of up to about ``CELLS`` pairs. Beams are widened for single queries whose beam holds
    nothing but links; beams as wide as a quarter of the shard give way to comparing with the whole shard."""
    todo, width, near = np.arange(len(queries)), beam, threshold - 1e-4
    while len(todo) and width * 4 <= len(vectors):
        step, wider = max(1, CELLS // width), []
        for at in range(0, len(todo), step):
            own = todo[at : at + step]
            ids, sims = graph.search(queries[own], width)
            full = sims[:, -1] >= near
            q, c = np.nonzero((sims >= near) & ~full[:, None])
            q, p = own[q], ids[q, c].astype(np.int64)
            for i in range(0, len(q), 65536):
                x, y = q[i : i + 65536], p[i : i + 65536]
                sure = np.einsum("nd,nd->n", queries[x], vectors[y]) >= threshold
                yield x[sure], y[sure]
            wider.append(own[full])
        todo, width = np.concatenate(wider), width * 4
    for q, p in _exact(queries[todo], vectors, threshold):
        yield todo[q], p


def _links(slices, own: np.ndarray, reps: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Links per query, without a query's hit on itself."""
    total = np.zeros(len(own), np.int64)
    for q, p in slices:
        other = own[q] != reps[p]
        total += np.bincount(q[other], weights[p[other]], len(own)).astype(np.int64)
    return total


class _Forest:
    """Edges among those given that connect what all of them connect."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def _top(self, x: int) -> int:
        above = self.above
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = above[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), 65536):
            for x, y in zip(a[at : at + 65536].tolist(), b[at : at + 65536].tolist(), strict=True):
                if (i := self._top(x)) != (j := self._top(y)):
                    self.above[i] = j
                    self.edges.append((x, y))


def _cell(queries: pd.DataFrame, pieces: pd.DataFrame):
    """The graph, its vectors, classes and weights, and the queries' classes and units."""
    reps, weights, vectors, *links = _whole(pieces)
    reps, weights = np.frombuffer(reps, np.int64), np.frombuffer(weights, np.int64)
    vectors = np.frombuffer(vectors).reshape(len(reps), -1)
    graph = Graph(vectors, [np.frombuffer(x, np.int32).reshape(-1, 32) for x in links])
    units = np.stack(queries["vec"].to_numpy()).astype(np.float64)
    units /= np.linalg.norm(units, axis=1)[:, None]
    return graph, vectors, reps, weights, queries["rep"].to_numpy(np.int64), units


def _audit(threshold: float):
    def run(queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        """Links of audited queries to one shard by comparing with all of it, and how many of them each beam finds. Wider beams than the
        first that finds enough are not tried; they find no fewer."""
        if queries.empty or shards.empty:
            return pd.DataFrame({"beam": [], "found": [], "links": []})
        graph, vectors, reps, weights, own, units = _cell(queries, shards)
        ones = np.ones_like(weights)
        truth = _links(_exact(units, vectors, threshold), own, reps, ones)
        some, found = np.flatnonzero(truth), []
        for beam in BEAMS:
            if not found or found[-1] < RECALL * truth.sum():
                found.append(int(np.minimum(_links(_walked(graph, units[some], vectors, threshold, beam), own[some], reps, ones), truth[some]).sum()))
            else:
                found.append(found[-1])
        return pd.DataFrame({"beam": BEAMS, "found": found, "links": [int(truth.sum())] * len(BEAMS)})

    return run


def _search(threshold: float, beam: int):
    def run(queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        """Links from one block of queries to one shard: their number per query, and edges that connect what the links connect."""
        if queries.empty or shards.empty:
            return pd.DataFrame({"rep": [], "links": [], "other": []})
        graph, vectors, reps, weights, own, units = _cell(queries, shards)
        links, forest = np.zeros(len(own), np.int64), _Forest()
        for q, p in _walked(graph, units, vectors, threshold, beam):
            other = own[q] != reps[p]
            q, p = q[other], p[other]
            links += np.bincount(q, weights[p], len(own)).astype(np.int64)
            forest.add(own[q], reps[p])
        some, edges = np.flatnonzero(links), forest.edges
        counts = pd.DataFrame({"rep": own[some], "links": links[some], "other": pd.array([None] * len(some), dtype="Int64")})
        return pd.concat([counts, pd.DataFrame({"rep": [e[0] for e in edges], "links": [0] * len(edges), "other": pd.array([e[1] for e in edges], dtype="Int64")})])

    return run


def _blocks(count: int) -> int:
    return max(1, min(BLOCKS, math.ceil(count / BLOCK_VECTORS)), math.ceil(count / (BLOCK_VECTORS * BLOCK_GROWTH)))


def _met(queries: DataFrame, graphs: DataFrame, shards: int, blocks: int, fn, schema: str) -> DataFrame:
    """Every block of queries with every shard of its length."""
    keys = ["dim", "block", "shard"]
    asked = queries.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.select(*keys, "rep", "vec").groupBy(keys).cogroup(spread.groupBy(keys)).applyInPandas(fn, schema)


def audited_beam(queries: DataFrame, graphs: DataFrame, shards: int, count: int, threshold: float) -> int:
    """The narrowest beam that finds enough of the links of a sample of queries, all shards taken together.

    The sample is drawn by hash and grows until it holds ``AUDIT_LINKS`` links or all queries. A query's hit on itself is no link. A
    beam that no query has links for is the narrowest; where none is wide enough, the widest is taken, and what it leaves in doubt
    is compared in full by the search itself.
    """
    size = AUDIT
    while True:
        part = max(1, count // size)
        sample = queries.where(F.pmod(F.xxhash64("place", F.lit(5)), F.lit(part)) == 0)
        cells = _met(sample, graphs, shards, _blocks(min(size, count)), _audit(threshold), "beam int, found long, links long")
        rows = cells.groupBy("beam").agg(F.sum("found").alias("found"), F.sum("links").alias("links")).orderBy("beam").collect()
        if part == 1 or (rows and rows[0]["links"] >= AUDIT_LINKS):
            return next((r["beam"] for r in rows if r["found"] >= RECALL * r["links"]), BEAMS[-1])
        size *= 4


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row: other vectors with a cosine of ``threshold`` or more, the smallest
    key that links lead to, and whether that is the row's own.

    Equal vectors form one class, so a vector with any number of copies is searched once and counts by its copies. Classes are
    dealt out to shards by hash, more shards for more or longer vectors, and each shard gets one graph of bounded size, kept in rows of
    ``PIECE_BYTES`` that a task puts together. An audit over all shards chooses the beam. Each block of classes searches every shard; what is found is verified in double precision. Within a block and shard, links are only counted, and a spanning forest of
    them goes on to the components, so a large group of near copies makes rows in proportion to its members.

    Null vectors, zero vectors, and vectors with null or non-finite components link with nothing; neither do rows with a null key
    (their component is null, and they are kept). Only vectors of one length are compared. Rows that repeat a key count one by
    one. An empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    vec = F.col(vector).cast("array<double>")
    base = stored(rows.select(F.col(key).alias("vec_id"), vec.alias("vec")), "vectors")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = base.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)).withColumn("place", F.xxhash64("vec"))
    classes = stored(sound.groupBy("place", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    count, dim = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    per_shard = max(LEAST_VECTORS, SHARD_BYTES // (8 * (dim or 1)))
    shards = max(1, math.ceil(count / per_shard), min(LEAST_SHARDS, count // LEAST_VECTORS))
    dealt = classes.withColumn("dim", F.size("vec")).withColumn("shard", F.pmod(F.xxhash64("rep", "place"), F.lit(shards)).cast("int"))
    graphs = stored(dealt.groupBy("dim", "shard").applyInPandas(_build, GRAPH_SCHEMA), "graphs")
    queries = dealt.drop("shard")
    beam = audited_beam(queries, graphs, shards, count, threshold)
    links = stored(_met(queries, graphs, shards, _blocks(count), _search(threshold, beam), "rep long, links long, other long"), "links")
    discard(graphs)
    linked = links.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(links.where("other is not null"), "rep", "other").withColumnRenamed("node", "rep")
    result = stored(classes.join(linked, "rep", "left").join(groups, "rep", "left"), "classes-linked")
    discard(links, classes)
    found = base.withColumn("place", F.xxhash64("vec")).join(result, ["place", "vec"], "left")
    one = F.coalesce("component", "rep")
    return found.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNull(), None).otherwise(F.coalesce(one, F.col("vec_id"))).cast("long").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
