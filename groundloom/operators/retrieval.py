"""Lexical and vector retrieval, fusion and ranked results.

Rank lists are long-form frames ``(query_id, sub_id, source, chunk_id, rank)``. ``sub_id`` numbers the
sub-queries of a question from 0.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import html_unescape, let, snippet
from ..session import materialize, shared_dir
from .lexical import QUERY_KEYS, LexicalIndex, LexicalStore, bm25_topk, top_ranks

__all__ = ["LexicalIndex", "LexicalStore", "bm25_topk", "top_ranks"]

# Sources in the order in which their hits first appear.
SOURCES = ["vec", "bm25"]

#: Clusters of a vector search at most.
PIVOTS = 256


# --- lexical index --------------------------------------------------------------------------------


def index_text(embedding_text: Column, text: Column) -> Column:
    """Text to index: the embedding text where there is one."""
    return F.coalesce(F.nullif(embedding_text, F.lit("")), text)


def bm25_index(chunks: DataFrame, epsilon: float = 0.25, store: str | None = None) -> LexicalIndex:
    """Okapi index of ``(chunk_id, text)``, stored by term in ``store`` (by default a fresh path of the shared folder).

    Negative idf values are floored at ``epsilon`` times the mean idf of all terms. :class:`LexicalStore` opens the same folder to
    change documents and to read its newest state.
    """
    return LexicalStore(chunks.sparkSession, store or shared_dir(chunks.sparkSession, "lexical"), epsilon).add(chunks).index()


def pad_zero(ranks: DataFrame, queries: DataFrame, chunk_ids: DataFrame, k: int = 50) -> DataFrame:
    """Fill BM25 lists shorter than ``k`` with zero-score chunks in id order.

    The first ``k`` ids plus the matches are always enough, so at most ``k`` ids are paired with a query.
    """
    spare = chunk_ids.select("chunk_id").orderBy("chunk_id").limit(k)
    filler = spare.agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    wide = queries.select(*QUERY_KEYS).distinct().withColumn("chunk_id", F.explode(filler.scalar()))
    zero = wide.join(ranks, [*QUERY_KEYS, "chunk_id"], "left_anti").select(*QUERY_KEYS, "chunk_id", F.lit(0.0).alias("score"))
    both = ranks.select(*QUERY_KEYS, "chunk_id", "score").union(zero)
    return top_ranks(both, QUERY_KEYS, k).select(*QUERY_KEYS, F.lit("bm25").alias("source"), "chunk_id", "rank", "score")


# --- vectors --------------------------------------------------------------------------------------


def l2_normalize(v: Column) -> Column:
    """Unit-length array; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def vector_index(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every chunk with its unit vector; ``vectors`` is (chunk_id, embedding). A chunk without a vector fails the job."""
    texts = chunks.select("chunk_id", index_text(F.col("embedding_text"), F.col("text")).alias("indexed_text"))
    missing = F.raise_error(F.concat(F.lit("no vector for chunk "), F.col("chunk_id").cast("string"))).cast("array<double>")
    unit = F.when(F.col("embedding").isNull(), missing).otherwise(l2_normalize(F.col("embedding")))
    return texts.join(vectors, "chunk_id", "left").withColumn("embedding", unit)


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector; must be empty for a complete index."""
    return chunks.select("chunk_id").join(vectors, "chunk_id", "left_anti")


def _unit(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, dtype=np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1.0)


@dataclass(frozen=True)
class _Clusters:
    """Unit vectors by the nearest of a few of them, the pivots, with the widest angle in each cluster.

    Neighbouring small clusters share a group, a cluster above ``slot_vectors`` is a group of its own in several slots; a cell is a
    slot of a group.
    """

    vectors: DataFrame  # chunk_id, unit, cluster, group, slot
    pivots: np.ndarray
    radii: np.ndarray
    group: np.ndarray  # of each cluster
    slots: list[int]  # of each group


def _near_pivots(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(matrix @ pivots.T, -1.0, 1.0))


def _groups(sizes: np.ndarray, pivots: np.ndarray, slot_vectors: int) -> tuple[np.ndarray, list[int]]:
    """The group of each cluster and the slots of each group: clusters are walked from neighbour to neighbour and fill up groups."""
    angles = _near_pivots(pivots, pivots)
    left, at = set(range(len(pivots))), 0
    group, slots, held = np.zeros(len(pivots), np.int64), [], None
    while left:
        at = min(left, key=lambda c: (angles[at, c], c))
        left.remove(at)
        if held is None or held + sizes[at] > slot_vectors:
            slots.append(0)
            held = 0
        held += int(sizes[at])
        group[at], slots[-1] = len(slots) - 1, max(1, -(-held // slot_vectors))
    return group, slots


def _clustered(vectors: DataFrame, slot_vectors: int) -> _Clusters:
    """Pivots are a fixed choice by hash, ``PIVOTS`` at most, so what is sent to tasks is bounded. A zero vector has no angle: its
    cluster gets the widest."""
    held = vectors.select("chunk_id", "embedding").where("embedding IS NOT NULL")
    some = held.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(max(1, min(PIVOTS, math.isqrt(held.count())))).select("embedding").toPandas()
    pivots = _unit(np.stack(some["embedding"].to_numpy())) if len(some) else np.zeros((1, 1))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                unit = _unit(np.stack(pdf["embedding"].to_numpy()))
                angles = _near_pivots(unit, pivots)
                cluster = angles.argmin(axis=1)
                angle = np.where(unit.any(axis=1), angles[np.arange(len(unit)), cluster], np.pi)
                yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "unit": list(unit), "cluster": cluster.astype(np.int32), "angle": angle})

    kind = vectors.schema["chunk_id"].dataType.simpleString()
    placed = materialize(held.mapInPandas(assign, f"chunk_id {kind}, unit array<double>, cluster int, angle double"), "clusters")
    radii, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for row in placed.groupBy("cluster").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect():
        radii[row["cluster"]], sizes[row["cluster"]] = row["angle"], row["n"]
    group, slots = _groups(sizes, pivots, slot_vectors)
    grouped = placed.withColumn("group", F.lit(group.tolist())[F.col("cluster")].cast("int"))
    slot = F.pmod(F.xxhash64("chunk_id"), F.lit(slots)[F.col("group")]).cast("int")
    return _Clusters(grouped.withColumn("slot", slot).drop("angle"), pivots, radii, group, slots)


def _bounds(unit: np.ndarray, clusters: _Clusters) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cluster of each question, and the highest score that each cluster can hold for it."""
    angles = _near_pivots(unit, clusters.pivots) * unit.any(axis=1, keepdims=True)
    return angles.argmin(axis=1), np.cos(np.clip(angles - clusters.radii, 0.0, np.pi))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 50, block_queries: int = 20_000, slot_vectors: int = 50_000) -> DataFrame:
    """Exact inner-product top-``k`` on unit vectors for ``(query_id, sub_id, embedding)``.

    By the triangle inequality no vector of a cluster is nearer to a question than the pivot's angle less the cluster's radius. Each
    question first meets the group of the cluster that may be nearest; its ``k``-th best score there is a floor, and only groups
    with a cluster that may reach it follow. Cells of a block of questions and a slot of a group have bounded size: one task
    multiplies the questions with the clusters that they may find something in and hands on ``k`` rows per question.
    """
    fields = {f.name: f.dataType for f in queries.schema} | {f.name: f.dataType for f in vectors.schema}
    out = T.StructType([T.StructField(c, fields[c]) for c in (*QUERY_KEYS, "chunk_id")] + [T.StructField("score", T.DoubleType())])
    clusters = _clustered(vectors, slot_vectors)
    shape = _Clusters(None, clusters.pivots, clusters.radii, clusters.group, clusters.slots)
    asked = materialize(queries.select(*QUERY_KEYS, "embedding").where("embedding IS NOT NULL"), "questions")
    blocks = max(1, -(-asked.count() // block_queries))
    schema = ", ".join(f"{c} {fields[c].simpleString()}" for c in QUERY_KEYS) + ", unit array<double>, floor double, group int"

    def reach(batches):
        """Groups that a question may find something in: that of the nearest cluster where it has no floor yet, else all others that reach it."""
        for pdf in batches:
            if not len(pdf):
                continue
            unit = _unit(np.stack(pdf["embedding"].to_numpy()))
            nearest, bound = _bounds(unit, shape)
            groups, floor = np.arange(len(shape.slots)), np.full(len(unit), -2.0)
            first = shape.group[nearest][:, None] == groups
            wanted = first
            if "floor" in pdf:
                floor = pdf["floor"].fillna(-2.0).to_numpy()
                member = (shape.group[:, None] == groups).astype(np.float32)
                wanted = ((bound >= floor[:, None] - 1e-6).astype(np.float32) @ member > 0) & ~first
            row, group = np.nonzero(wanted)
            if not len(row):
                continue
            yield pd.DataFrame({c: pdf[c].to_numpy()[row] for c in QUERY_KEYS} | {"unit": list(unit[row]), "floor": floor[row], "group": group.astype(np.int32)})

    def met(pairs: DataFrame) -> DataFrame:
        return _meet_in_cells(pairs, clusters, k, out, blocks)

    first = materialize(top_ranks(met(asked.mapInPandas(reach, schema)), QUERY_KEYS, k).select(*out.fieldNames()), "nearest-clusters")
    floor = first.groupBy(*QUERY_KEYS).agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    others = asked.join(floor, QUERY_KEYS, "left").select(*QUERY_KEYS, "embedding", "floor").mapInPandas(reach, schema)
    both = first.unionByName(met(others))
    return top_ranks(both, QUERY_KEYS, k).select(*QUERY_KEYS, F.lit("vec").alias("source"), "chunk_id", "rank", "score")


def _numbers(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _best(questions: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, cluster: np.ndarray, k: int, shape: _Clusters, block: int = 256):
    """Rows of the best ``k`` vectors of each question, ties by id, and their scores.

    A question meets the clusters that may reach its floor only; vectors come in order of clusters, then ids.
    """
    cuts = np.flatnonzero(np.diff(cluster, prepend=-1, append=-1))
    rows, places, values = [], [], []
    for lo in range(0, len(questions), block):
        q = questions[lo : lo + block]
        reached = _bounds(q, shape)[1] >= floor[lo : lo + block, None] - 1e-6
        scores = np.full((len(q), len(ids)), -np.inf)
        for begin, end in zip(cuts[:-1], cuts[1:]):
            own = np.flatnonzero(reached[:, cluster[begin]])
            scores[own, begin:end] = np.round(q[own] @ vectors[begin:end].T, 9)
        least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
        for j, limit in enumerate(least):
            # Everything at or above the k-th score is kept, so ties are settled by id below.
            held = np.flatnonzero((scores[j] >= limit) & (scores[j] > -np.inf))
            held = held[np.lexsort((ids[held], -scores[j, held]))[:k]]
            rows.append(np.full(len(held), lo + j))
            places.append(held)
            values.append(scores[j, held])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values)


def _meet_in_cells(pairs: DataFrame, clusters: _Clusters, k: int, out: T.StructType, blocks: int) -> DataFrame:
    """Questions with the groups that they ask: cells of (group, slot of its vectors, block of questions)."""
    q = pairs.withColumn("block", F.pmod(F.xxhash64(*QUERY_KEYS), F.lit(blocks)).cast("int")).withColumn("slot", F.explode(_numbers(F.lit(clusters.slots)[F.col("group")])))
    v = clusters.vectors.withColumn("block", F.explode(_numbers(F.lit(blocks))))
    shape = _Clusters(None, clusters.pivots, clusters.radii, clusters.group, clusters.slots)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in out.fieldNames()})
        right = right.sort_values(["cluster", "chunk_id"], kind="stable")
        ids = right["chunk_id"].to_numpy()
        question, place, score = _best(np.stack(left["unit"].to_numpy()), left["floor"].to_numpy(), np.stack(right["unit"].to_numpy()), ids, right["cluster"].to_numpy(), k, shape)
        return pd.DataFrame({c: left[c].to_numpy()[question] for c in QUERY_KEYS} | {"chunk_id": ids[place], "score": score})

    cell = ["group", "slot", "block"]
    return q.groupBy(cell).cogroup(v.select(*cell, "chunk_id", "cluster", "unit").groupBy(cell)).applyInPandas(meet, out)


# --- filters, fusion, results ---------------------------------------------------------------------


def doc_filter(ranks: DataFrame, allow: DataFrame, by: str = "doc_id") -> DataFrame:
    """Keep allowed documents of each query; ranks keep their gaps.

    ``allow`` is (query_id, ``by``), ids or an attribute of documents that the ranked rows carry; a query without entries is not
    filtered.
    """
    allowed = allow.select("query_id", by).distinct().withColumn("_hit", F.lit(True))
    limited = allow.select("query_id").distinct().withColumn("_limited", F.lit(True))
    joined = ranks.join(limited, "query_id", "left").join(allowed, ["query_id", by], "left")
    return joined.filter(F.col("_limited").isNull() | F.col("_hit")).drop("_hit", "_limited")


def rrf(ranks: DataFrame, k: int = 60, keys: list[str] = QUERY_KEYS) -> DataFrame:
    """Reciprocal-rank fusion over sources: the sum of ``1 / (k + rank)``."""
    return ranks.groupBy(*keys, "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"))


def hybrid_pool(ranks: DataFrame, k: int = 60) -> DataFrame:
    """Fused score of each chunk over all sources and sub-queries of a question, in order.

    Ties go to the chunk that appears first: by sub-query, then source, then rank.
    """
    source_no = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    pooled = ranks.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"),
        F.min(F.struct("sub_id", source_no.alias("source_no"), "rank")).alias("first_seen"),
    )
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "first_seen")
    return pooled.withColumn("position", F.row_number().over(w)).drop("first_seen")


def store_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Chunk records written in buckets of ``chunk_id`` and opened as a table.

    A selection too large to be sent to the texts is shuffled into the same buckets and meets them where they are stored, so no
    text moves. A wide corpus takes more buckets: one should fit a task's memory a few times over.
    """
    name = "chunks_" + uuid.uuid4().hex
    chunks.write.bucketBy(buckets, "chunk_id").sortBy("chunk_id").option("path", path).saveAsTable(name)
    return chunks.sparkSession.table(name)


def open_chunks(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    """The table that :func:`store_chunks` wrote, for another session; ``buckets`` as there."""
    name = "chunks_" + uuid.uuid4().hex
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (chunk_id) SORTED BY (chunk_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def with_chunks(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Selected rows with their chunks' columns; unknown chunks drop out.

    The selection is written first, so its size is known when the join is planned: a small one goes to the chunks, and no text is
    shuffled. One above Spark's broadcast threshold meets them by chunk; chunks of :func:`store_chunks` stay where they are then too.
    """
    return materialize(selected, "selected").join(chunks, "chunk_id")


def ranked_results(pool: DataFrame, chunks: DataFrame, top: int = 8) -> DataFrame:
    """The first ``top`` results of each question with header and display text; unknown chunks drop out."""
    crumb = F.coalesce(F.nullif(F.col("breadcrumb"), F.lit("")), F.lit("∅"))
    header = F.format_string("[%d] %s | %s | chunk_id=%s | score=%.4f", "position", F.col("doc_id").cast("string"), crumb, F.col("chunk_id").cast("string"), F.bround("score", 4))
    picked = with_chunks(pool.filter(F.col("position") <= top), chunks)
    return picked.select("query_id", "position", "chunk_id", header.alias("header"), snippet(F.col("text"), 600, " …").alias("shown"))


def rerank_candidates(pool: DataFrame, chunks: DataFrame, limit: int = 50) -> DataFrame:
    """Per question the JSON list of its first candidates, each with a 400-character snippet."""
    item = F.struct(
        F.col("chunk_id").cast("string").alias("chunk_id"),
        F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"),
        F.col("doc_id").cast("string").alias("doc_id"),
        snippet(F.col("text"), 400).alias("snippet"),
    )
    return _listed(pool, chunks, limit, item, "candidates")


def _listed(selected: DataFrame, chunks: DataFrame, limit: int, item: Column, name: str) -> DataFrame:
    """JSON list of ``item`` for at most ``limit`` selected chunks per question."""
    joined = with_chunks(selected.filter(F.col("position") <= limit), chunks)
    listed = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))).alias("l"))
    return listed.select("query_id", F.to_json("l.item").alias(name))


def sufficiency_evidence(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per question the JSON list of its first 16 chunks with title and 280-character summary."""
    item = F.struct(
        F.col("chunk_id").cast("string").alias("chunk_id"),
        context_title(F.col("breadcrumb"), F.col("section_path")).alias("title"),
        snippet(F.col("text"), 280).alias("summary"),
    )
    return _listed(selected, chunks, 16, item, "evidence")


def validation_evidence(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per question the JSON list of its first 10 chunks with breadcrumb and 350-character snippet."""
    item = F.struct(
        F.col("chunk_id").cast("string").alias("chunk_id"),
        context_title(F.col("breadcrumb"), F.col("section_path")).alias("breadcrumb"),
        snippet(F.col("text"), 350).alias("snippet"),
    )
    return _listed(selected, chunks, 10, item, "evidence")


def context_title(breadcrumb: Column, section_path: Column) -> Column:
    return F.coalesce(F.nullif(breadcrumb, F.lit("")), F.array_join(section_path, " > "), F.lit(""))


def pack_context(selected: DataFrame, chunks: DataFrame, token_limit: int = 6000) -> DataFrame:
    """Context text per question under a character budget of four per token.

    Blocks are taken in order and the first one that does not fit ends the list, which equals keeping the
    rows whose running length is within the budget. Separators do not count. The budget is applied to lengths alone; texts are
    fetched last, for the chunks that are left.
    """
    title = context_title(F.col("breadcrumb"), F.col("section_path"))
    block = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), title, F.lit("\n"), F.col("text"), F.lit("\n"))
    lengths = chunks.select("chunk_id", F.length(block).alias("length"))
    w = W.partitionBy("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    sized = with_chunks(selected.select("query_id", "position", "chunk_id"), lengths)
    fitting = sized.withColumn("used", F.sum("length").over(w)).filter(F.col("used") <= token_limit * 4).drop("length")
    kept = with_chunks(fitting, chunks).select("query_id", "position", "chunk_id", "breadcrumb", "used", block.alias("block"))
    entry = F.struct("position", "block", F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb")).alias("source"))
    packed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("l"), F.max("used").alias("chars"))
    return packed.select(
        "query_id",
        F.array_join("l.block", "\n---\n").alias("context"),
        F.col("l.source").alias("sources"),
        F.size("l").cast("bigint").alias("included"),
        F.col("chars").cast("bigint").alias("chars"),
    )


def capped_sources(packed: DataFrame, top: int = 10) -> DataFrame:
    """``(query_id, sources)`` of packed contexts: the first ones, six more than ``top``, titles without character references."""
    rows = packed.select("query_id", F.posexplode(F.slice("sources", 1, top + 6)).alias("place", "s"))
    plain = rows.select("query_id", "place", F.struct(F.col("s.chunk_id").alias("chunk_id"), html_unescape(F.col("s.breadcrumb")).alias("breadcrumb")).alias("s"))
    return plain.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x.s).alias("sources"))
