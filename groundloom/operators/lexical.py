"""Lexical index by term, kept in immutable segments that are added, retired and merged.

A store is a folder. Each segment holds some chunks twice: as forward rows (one per chunk, with its term counts) and as blocks of
postings by term (one per term and cell of ``CELL`` chunks: places in the cell and counts). A block without a term lists the cell's
chunks. Blocks are sorted by a hash of their terms, the bucket, so that a reader of few terms skips the pages of others by their
statistics. Changes write new segments and lists of retired chunks; what is there is never rewritten, so readers of an older state
go on undisturbed. The state is a numbered row: the live segments and the totals that scores need.

Where a task or a batch ends within a cell, its blocks come in pieces, each with some of the cell's places.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import explode_once, lex_tokens
from ..session import materialize

QUERY_KEYS = ["query_id", "sub_id"]
#: Chunks per cell; buckets of terms; segments of one size that are merged into one.
CELL, BUCKETS, FAN = 4096, 256, 4
#: Questions that meet one slab of chunks in a task at most, and the slab's chunks, more or less.
QUESTIONS, SLAB = 65_536, 32_768
#: The bucket of the blocks that list a cell's chunks.
LISTS = -1
#: Scores are rounded to nine digits; bounds leave room for that.
SLACK = 1e-8
TERMS_SCHEMA = "bucket int, term string, df long"
#: Postings of a block, or the chunks of a list with their lengths.
BLOCK = "places array<smallint>, tfs array<int>, ids array<{}>, lens array<int>"


def _counted(schema: pa.Schema):
    """Rows of ``(chunk_id, doc_id, doc_len, tokens)`` with their term counts in place of the tokens."""

    def run(batches):
        for batch in batches:
            flat, row = batch.column("tokens").flatten(), np.array(pc.list_parent_indices(batch.column("tokens"))).astype(np.int64)
            terms = flat.dictionary_encode()
            width = max(1, len(terms.dictionary))
            entry, tf = np.unique(row * width + np.array(terms.indices), return_counts=True)
            cuts = np.searchsorted(entry // width, np.arange(batch.num_rows + 1)).astype(np.int32)
            kind = schema.field("entries").type.value_type
            entries = pa.StructArray.from_arrays([terms.dictionary.take(pa.array(entry % width)), pa.array(tf.astype(np.int64))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(cuts), entries).cast(schema.field("entries").type)], schema=schema)

    return run


@dataclass(frozen=True)
class LexicalIndex:
    """One state of a store: blocks of postings, retired chunks, terms with their Okapi weights, and totals."""

    blocks: DataFrame  # part, cell, bucket, term, places, tfs, ids, lens
    dead: DataFrame | None  # part, cell, place
    terms: DataFrame  # bucket, term, df, idf
    n_docs: int
    held: int  # chunks with the retired ones
    avgdl: float
    k1: float
    b: float


class LexicalStore:
    """A folder of segments. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, epsilon: float = 0.25, k1: float = 1.5, b: float = 0.75):
        self.spark, self.path, self.epsilon, self.k1, self.b = spark, path, epsilon, k1, b

    # --- state ----------------------------------------------------------------------------------

    def state(self) -> dict:
        """The newest state; an empty one where nothing was written yet."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._at("states"))
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return {"number": 0, "segments": {}, "dead": [], "terms": None, "n_docs": 0, "total_len": 0, "mean_idf": 0.0}
        states = self.spark.read.schema("number long, state string").parquet(self._at("states"))
        return json.loads(states.orderBy(F.desc("number")).first()["state"])

    def _at(self, *names: str) -> str:
        return os.path.join(self.path, *names)

    def _read(self, part: str, segments: dict) -> DataFrame | None:
        return self.spark.read.parquet(*[self._at(name, part) for name in segments]) if segments else None

    def _dead(self, state: dict) -> DataFrame | None:
        if not state["dead"]:
            return None
        return self.spark.read.parquet(*[self._at(name) for name in state["dead"]]).where(F.col("segment").isin(list(state["segments"])))

    def _commit(self, state: dict) -> None:
        """Totals over the live segments less what is retired in them, then the state itself as the last write."""
        state["number"] += 1
        segments, dead = state["segments"], self._dead(state)
        state["n_docs"] = sum(s["n"] for s in segments.values())
        state["total_len"] = sum(s["length"] for s in segments.values())
        terms = self._read("terms", segments)
        if len(segments) == 1 and dead is None:
            state["terms"] = os.path.join(*segments, "terms")
        elif terms is not None:
            if dead is not None:
                gone = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("length")).first()
                state["n_docs"] -= gone["n"]
                state["total_len"] -= gone["length"]
                less = explode_once(dead, F.col("entries.term"), "term").groupBy("term").agg((-F.count("*")).alias("df"))
                terms = terms.unionByName(less.select(bucket(F.col("term")), "term", "df"))
            merged = terms.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
            state["terms"] = f"terms-{uuid.uuid4().hex}"
            merged.write.parquet(self._at(state["terms"]))
        if terms is not None:
            kept = self.spark.read.schema(TERMS_SCHEMA).parquet(self._at(state["terms"]))
            state["mean_idf"] = kept.agg(F.avg(raw_idf(F.col("df"), state["n_docs"]))).first()[0] or 0.0
        row = self.spark.createDataFrame([(state["number"], json.dumps(state))], "number long, state string")
        row.coalesce(1).write.mode("append").parquet(self._at("states"))

    # --- changes --------------------------------------------------------------------------------

    def add(self, chunks: DataFrame) -> LexicalStore:
        """Index ``(chunk_id, text)`` and, where there is one, ``doc_id``; ids must be new to the store and unique."""
        state = self.state()
        self._segment(state, self._forward(chunks))
        self._commit(state)
        return self

    def replace(self, chunks: DataFrame, doc_ids: DataFrame) -> LexicalStore:
        """Retire all chunks of the documents ``(doc_id)`` and index their new ones, in one state.

        Documents without new chunks are removed. Texts of other documents are not read: of their forward rows only the ids are.
        """
        state = self.state()
        forward = self._read("forward", state["segments"])
        if forward is not None:
            gone = forward.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("segment", "cell", "place", "chunk_id", "doc_len", "entries")
            if (dead := self._dead(state)) is not None:
                gone = gone.join(dead.select("segment", "chunk_id"), ["segment", "chunk_id"], "left_anti")
            name = f"dead-{uuid.uuid4().hex}"
            gone.write.parquet(self._at(name))
            state["dead"].append(name)
        self._segment(state, self._forward(chunks))
        self._commit(state)
        return self

    def merge(self, fan: int = FAN) -> LexicalStore:
        """Merge segments of one order of size where ``fan`` or more have gathered, the merged ones again with those of their size.

        Each chunk is thus rewritten by the logarithm of the number of chunks, from its forward row: texts are not read again.
        Retired chunks are left behind.
        """
        state = self.state()
        while True:
            tiers: dict[int, list[str]] = {}
            for name, s in state["segments"].items():
                tiers.setdefault(int(math.log(max(s["n"], 1), fan)), []).append(name)
            full = [names for _, names in sorted(tiers.items()) if len(names) >= fan]
            if not full:
                return self
            forward = self._read("forward", dict.fromkeys(full[0]))
            if (dead := self._dead(state)) is not None:
                forward = forward.join(dead.select("segment", "chunk_id"), ["segment", "chunk_id"], "left_anti")
            for name in full[0]:
                del state["segments"][name]
            self._segment(state, forward.select("chunk_id", "doc_id", "doc_len", "entries"))
            self._commit(state)

    def _forward(self, chunks: DataFrame) -> DataFrame:
        """Term counts of each chunk; a narrow transform."""
        doc = F.col("doc_id" if "doc_id" in chunks.columns else "chunk_id").alias("doc_id")
        tokens = chunks.select("chunk_id", doc, lex_tokens(F.col("text")).alias("tokens"))
        sized = tokens.select("chunk_id", "doc_id", F.size("tokens").cast("bigint").alias("doc_len"), "tokens")
        kinds = ", ".join(f"{c} {sized.schema[c].dataType.simpleString()}" for c in ("chunk_id", "doc_id", "doc_len"))
        schema = T.StructType.fromDDL(f"{kinds}, entries array<struct<term:string,tf:long>>")
        return sized.mapInArrow(_counted(to_arrow_schema(schema)), schema)

    def _segment(self, state: dict, forward: DataFrame) -> None:
        """Write one segment. Cells are rows that follow each other in a task, so their blocks are made where the rows are read, without a
        shuffle, and the blocks of a very common term side by side, one in each cell."""
        name = f"segment-{uuid.uuid4().hex}"
        number = F.monotonically_increasing_id()
        forward = forward.withColumn("number", number).withColumn("cell", F.shiftright("number", CELL.bit_length() - 1))
        forward = forward.withColumn("place", F.col("number").bitwiseAND(CELL - 1).cast("smallint")).drop("number").withColumn("segment", F.lit(name))
        forward.write.parquet(self._at(name, "forward"))
        rows = self.spark.read.schema(forward.schema).parquet(self._at(name, "forward"))
        totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("length")).first()
        kind = forward.schema["chunk_id"].dataType.simpleString()
        schema = T.StructType.fromDDL(f"cell long, term string, n int, {BLOCK.format(kind)}")
        blocks = rows.select("cell", "place", "chunk_id", "doc_len", "entries").mapInArrow(_blocks_of_cells(to_arrow_schema(schema)), schema)
        place = F.when(F.col("term").isNull(), F.lit(LISTS)).otherwise(bucket(F.col("term"))).alias("bucket")
        blocks.select("*", place).sortWithinPartitions("bucket", "term", "cell").write.parquet(self._at(name, "blocks"))
        written = self.spark.read.schema("bucket int, term string, n int").parquet(self._at(name, "blocks")).where(F.col("bucket") != LISTS)
        written.groupBy("bucket", "term").agg(F.sum("n").alias("df")).write.parquet(self._at(name, "terms"))
        state["segments"][name] = {"n": totals["n"], "length": totals["length"], "kind": kind}

    # --- reads ----------------------------------------------------------------------------------

    def index(self) -> LexicalIndex:
        state = self.state()
        n = state["n_docs"]
        dead = self._dead(state)
        raw = raw_idf(F.col("df"), n)
        idf = F.when(raw < 0, F.lit(self.epsilon * state["mean_idf"])).otherwise(raw)
        terms = self.spark.read.schema(TERMS_SCHEMA).parquet(self._at(state["terms"])).withColumn("idf", idf)
        avgdl = state["total_len"] / n if n else 0.0
        parts = []
        for number, (name, segment) in enumerate(state["segments"].items()):
            part = self.spark.read.schema(f"cell long, term string, {BLOCK.format(segment['kind'])}, bucket int").parquet(self._at(name, "blocks"))
            parts.append(part.withColumn("part", F.lit(number)))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        if dead is not None:
            number = F.array_position(F.lit(list(state["segments"])), F.col("segment")) - 1
            dead = dead.select(number.cast("int").alias("part"), "cell", "place")
        held = sum(s["n"] for s in state["segments"].values())
        return LexicalIndex(whole, dead, terms, n, held, avgdl, self.k1, self.b)


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def raw_idf(df: Column, n_docs: int) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def top_ranks(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best ``k`` per key with 1-based ``rank``, ties by chunk id.

    The rank limit is applied inside each partition before the shuffle, so a query that matches most of
    the corpus still ships only ``k`` rows per task.
    """
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks_of_cells(schema: pa.Schema):
    """Blocks of postings by cell and term, and lists of the cells' chunks, of forward rows in order."""

    def lists(values: pa.Array, starts: np.ndarray, rest: int, name: str) -> pa.Array:
        """Lists that begin at ``starts``, then nulls."""
        kind = schema.field(name).type
        some = pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values.cast(kind.value_type)).cast(kind)
        return pa.concat_arrays([some, pa.nulls(rest, kind)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, place, length = (np.array(batch.column(c).fill_null(0)) for c in ("cell", "place", "doc_len"))
            firsts = np.flatnonzero(np.diff(cell, prepend=-1))
            entries = batch.column("entries")
            flat, row = entries.flatten(), np.array(pc.list_parent_indices(entries)).astype(np.int64)
            terms = flat.field("term").dictionary_encode()
            # Rows come by cell, so a stable sort by term within a cell keeps places in order.
            within = np.cumsum(np.diff(cell, prepend=cell[0]) != 0)[row] * max(1, len(terms.dictionary)) + np.array(terms.indices)
            order = np.argsort(within, kind="stable")
            starts = np.flatnonzero(np.diff(within[order], prepend=-1))
            held, n = row[order], np.diff(np.append(starts, len(order)))
            listed = lists(pa.array(place), firsts, 0, "places"), lists(batch.column("chunk_id"), firsts, 0, "ids"), lists(pa.array(length), firsts, 0, "lens")
            columns = {
                "cell": np.append(cell[held[starts]], cell[firsts]),
                "term": pa.concat_arrays([terms.dictionary.take(terms.indices.take(pa.array(order[starts]))), pa.nulls(len(firsts), pa.string())]),
                "n": np.append(n, np.zeros(len(firsts))).astype(np.int32),
                "places": pa.concat_arrays([lists(pa.array(place[held]), starts, 0, "places"), listed[0]]),
                "tfs": lists(flat.field("tf").take(pa.array(order)), starts, len(firsts), "tfs"),
                "ids": pa.concat_arrays([pa.nulls(len(starts), schema.field("ids").type), listed[1]]),
                "lens": pa.concat_arrays([pa.nulls(len(starts), schema.field("lens").type), listed[2]]),
            }
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name]) if isinstance(columns[f.name], np.ndarray) else columns[f.name] for f in schema], schema=schema)

    return run


def _flat(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """Values of a column of lists, and the row of each."""
    held = table[name].combine_chunks()
    return held.flatten(), np.array(pc.list_parent_indices(held)).astype(np.int64)


class _Slab:
    """Chunks of some cells in order of their ids, and their postings by term."""

    def __init__(self, blocks: pa.Table, gone: pa.Table, k1: float, b: float, avgdl: float):
        lists, posted = blocks.filter(pc.is_null(blocks["term"])), blocks.filter(pc.is_valid(blocks["term"]))
        many = max(1, pc.max(blocks["part"]).as_py() + 1)
        cells = np.unique(np.array(lists["cell"]) * many + np.array(lists["part"]))

        def cell_of(table: pa.Table) -> np.ndarray:
            return np.searchsorted(cells, np.array(table["cell"]) * many + np.array(table["part"]))

        ids, row = _flat(lists, "ids")
        place, length = np.array(_flat(lists, "places")[0]).astype(np.int64), np.array(_flat(lists, "lens")[0]).astype(float)
        own, by_id = cell_of(lists)[row], np.array(pc.sort_indices(ids))
        width = int(place.max()) + 1
        at = np.zeros(len(cells) * width, np.int64)
        at[own[by_id] * width + place[by_id]] = np.arange(len(ids))
        self.ids, length = ids.take(pa.array(by_id)), length[by_id]
        terms = posted["term"].combine_chunks().dictionary_encode()
        order = np.argsort(np.array(terms.indices), kind="stable")
        posted, code = posted.take(pa.array(order)), np.array(terms.indices)[order]
        self.terms = terms.dictionary
        values, row = _flat(posted, "places")
        doc = at[cell_of(posted)[row] * width + np.array(values)]
        tf, code = np.array(_flat(posted, "tfs")[0]).astype(float), code[row]
        share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / avgdl))
        gone = at[cell_of(gone) * width + np.array(gone["place"], np.int64)]
        # An id that comes twice in a cell is one chunk.
        names = np.array(self.ids.dictionary_encode(null_encoding="encode").indices) * len(cells) + own[by_id]
        first = np.unique(names, return_index=True)[1]
        if len(first) < len(names):
            same = first[np.unique(names, return_inverse=True)[1]]
            doc, gone = same[doc], same[gone]
            last = len(doc) - 1 - np.unique((code * len(names) + doc)[::-1], return_index=True)[1]
            doc, share, code = doc[last], share[last], code[last]
        self.doc, self.share, self.gone = doc, share, gone
        self.cuts = np.searchsorted(code, np.arange(len(self.terms) + 1)).tolist()
        self.size = -(-len(ids) // 64) * 64
        self.wide: dict[int, np.ndarray] = {}

    def add(self, scores: np.ndarray, term: int, weight: float) -> None:
        begin, end = self.cuts[term], self.cuts[term + 1]
        if (end - begin) * 4 < self.size:
            scores[self.doc[begin:end]] += weight * self.share[begin:end]
            return
        if term not in self.wide:
            self.wide[term] = np.zeros(self.size)
            self.wide[term][self.doc[begin:end]] = self.share[begin:end]
        scores += weight * self.wide[term]

    def best(self, terms: list[int], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best ``k`` chunks that have one of the terms, ties by id."""
        scores = np.zeros(self.size)
        for term, weight in zip(terms, weights, strict=True):
            self.add(scores, term, weight)
        if all(w > 0 for w in weights):
            hit = scores > 0
        else:
            hit = np.zeros(self.size, bool)
            for term in terms:
                hit[self.doc[self.cuts[term] : self.cuts[term + 1]]] = True
        hit[self.gone] = False
        scores[~hit] = -np.inf
        # The k-th highest of the maxima of short runs is no higher than the k-th highest score.
        tops = scores.reshape(-1, 64).max(axis=1)
        least = np.partition(tops, -k)[-k] if len(tops) > k else -np.inf
        own = np.flatnonzero(hit if least == -np.inf else scores >= least - SLACK)
        found = np.round(scores[own], 9)
        order = np.argsort(-found, kind="stable")[:k]
        return own[order], found[order]


def _scorer(index: LexicalIndex, k: int, schema: pa.Schema):
    """Scores of some questions against the cells of a slab, a question at a time."""
    k1, b, avgdl = index.k1, index.b, index.avgdl

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        questions, gone = asked.filter(pc.is_valid(asked["entries"])), asked.filter(pc.is_null(asked["entries"]))
        if not questions.num_rows or pc.is_null(blocks["term"]).combine_chunks().false_count == 0:
            return schema.empty_table()
        slab = _Slab(blocks, gone, k1, b, avgdl)
        flat, row = _flat(questions, "entries")
        term, weight = np.array(pc.index_in(flat.field("term"), slab.terms).fill_null(-1)), np.array(flat.field("weight"))
        row, term, weight = row[term >= 0], term[term >= 0], weight[term >= 0]
        cuts = np.searchsorted(row, np.arange(questions.num_rows + 1)).tolist()
        term, weight = term.tolist(), weight.tolist()
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for q, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if begin < end:
                own, found = slab.best(term[begin:end], weight[begin:end], k)
                for column, values in zip(out, (np.full(len(own), q), own, found), strict=True):
                    column.append(values)
        question, own, score = (np.concatenate(x) for x in out)
        keys = [questions[c].combine_chunks().take(pa.array(question)) for c in QUERY_KEYS]
        return pa.Table.from_arrays([*keys, slab.ids.take(pa.array(own)), pa.array(score)], schema=schema)

    return run


def bm25_topk(queries: DataFrame, index: LexicalIndex, k: int = 50) -> DataFrame:
    """Okapi top-``k`` of ``(query_id, sub_id, q)``; repeated query tokens count again. Only chunks that match are ranked.

    Pages without buckets of asked terms are skipped. Cells are dealt out to slabs of about ``SLAB`` chunks and questions to groups of
    ``QUESTIONS``, one row each; what a task holds is thus bounded. The postings of asked terms move once for each group, a few bytes
    each, a question moves once for each slab, and from there ``k`` chunks for each question go on.
    """
    keys, at = QUERY_KEYS, ["group", "slab"]
    counted = queries.dropna(subset=keys).select(*keys, F.explode(lex_tokens(F.col("q"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("qtf"))
    asked = counted.join(index.terms, "term").select(*keys, "bucket", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    asked = materialize(asked, "question-terms")
    sizes = asked.agg(F.collect_set("bucket").alias("buckets"), F.count_distinct(*keys).alias("questions")).first()
    groups = max(1, -(-sizes["questions"] // QUESTIONS))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    slabs = max(1, -(-index.held // SLAB), min(-(-index.held // CELL), -(-cores // groups)))
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("group")
    slab = F.pmod(F.xxhash64("part", "cell"), F.lit(slabs)).cast("int").alias("slab")

    kinds = {c: asked.schema[c].dataType for c in keys} | {"chunk_id": index.blocks.schema["ids"].dataType.elementType, "score": T.DoubleType()}
    result = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def none(kinds: dict[str, str]) -> list[Column]:
        return [F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]

    questions = asked.groupBy(*keys).agg(F.collect_list(F.struct("term", "weight")).alias("entries"))
    left = questions.select(group, *keys, "entries", *none({"part": "int", "cell": "long", "place": "smallint"})).withColumn("slab", every(slabs))
    if index.dead is not None:
        blank = none({c: kinds[c] for c in keys} | {"entries": questions.schema["entries"].dataType})
        left = left.unionByName(index.dead.select("part", "cell", "place", slab, *blank, every(groups).alias("group")))
    # New names for the columns, as both sides of the cogroup come from these rows.
    wanted = asked.select(group, "bucket", "term").distinct().toDF("group", "bucket", "term")
    postings = index.blocks.where(F.col("bucket").isin(sizes["buckets"])).join(wanted, ["bucket", "term"])
    lists = index.blocks.where(F.col("bucket") == LISTS).withColumn("group", every(groups))
    sent = ["part", "cell", "term", "places", "tfs", "ids", "lens"]
    right = postings.select("group", slab, *sent).unionByName(lists.select("group", slab, *sent))
    scored = left.groupBy(at).cogroup(right.groupBy(at)).applyInArrow(_scorer(index, k, to_arrow_schema(result)), result)
    return top_ranks(scored, keys, k).select(*keys, F.lit("bm25").alias("source"), "chunk_id", "rank", "score")
