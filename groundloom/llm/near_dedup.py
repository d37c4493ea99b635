"""Near-duplicate documents: an inverted join of MinHash coordinates, links confirmed on whole shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .components import components
from .shingles import mixed, shingle_set, word_hashes

COORDINATES = 64
#: A pair with just enough shingles in common is missed with this probability at most.
MISSED = 1.6e-7
#: Documents of one posting list that are compared with each other as a block; longer lists are split into pairs of blocks.
BLOCK = 512
#: Rounds in which classes are left out that can't have enough shingles in common with any other that is left.
PRUNINGS = 2
#: Pairs whose signatures are compared at once.
STEP_PAIRS = 1 << 15

_RNG = np.random.Generator(np.random.PCG64(7))
_FACTOR = _RNG.integers(0, 1 << 64, COORDINATES, dtype=np.uint64) | np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 64, COORDINATES, dtype=np.uint64)


def matches(enough: int) -> int:
    """Coordinates that a candidate pair has in common at least: as many as a pair with ``enough`` of 100 shingles in common reaches
    but for a probability of ``MISSED``."""
    share, fewer = enough / 100, 0.0
    for k in range(COORDINATES):
        fewer += math.comb(COORDINATES, k) * share**k * (1 - share) ** (COORDINATES - k)
        if fewer > MISSED:
            return max(1, k)
    return COORDINATES


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each coordinate's hash over a set of shingles, in 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[at : at + 1024, None] * _FACTOR + _SHIFT).min(0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sets(batch, step: int = 256):
    for at in range(0, batch.num_rows, step):
        rows = batch.slice(at, step)
        yield rows, [shingle_set(w) for w in word_hashes([(t or "").encode() for t in rows.column("_text").to_pylist()])]


def _prints(sets) -> tuple[list[int], list[int]]:
    """Two independent 64-bit sums over each set: equal sets have equal sums, and others don't but by an accident of 128 bits."""
    a = [int(mixed(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    b = [int(mixed(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    return a, b


def _signed(batches):
    for batch in batches:
        for rows, sets in _sets(batch):
            a, b = _prints(sets)
            values = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(values, pa.list_(pa.int32()))], names=["doc_id", "n", "a", "b", "values"])


def _whole_sets(batches):
    for batch in batches:
        for rows, sets in _sets(batch):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "shingles"])


def _spelled(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            sets = [np.frombuffer(x, np.int64) for x in rows.column("shingles").to_pylist()]
            sizes = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(np.array(rows.column(c)), sizes)) for c in ("rep", "label")), pa.array(np.concatenate(sets))], names=["rep", "label", "shingle"])


def _confirmed(enough: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xs"), batch.column("ys"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= enough * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _groups(batches):
    """Rows of one key after the other, as slices of Arrow batches; the last key of a batch waits for the next one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        keys = np.stack([np.array(table.column(c)) for c in ("post", "i", "j")], 1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        if len(edges):
            yield table.slice(0, edges[-1]), np.concatenate([[0], edges])
        held = table.slice(edges[-1] if len(edges) else 0)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _collisions(enough: int):
    """Pairs of a list that share ``matches(enough)`` coordinates, belong to different components, can have enough shingles in common, and
    have no list with a smaller coordinate in common, so that a pair comes from one list only."""

    least = matches(enough)

    def run(batches):
        kinds = pa.schema([("x", pa.int64()), ("y", pa.int64())])
        for table, edges in _groups(batches):
            rep, label, n, shared, block = (np.array(table.column(c)) for c in ("rep", "label", "n", "shared", "block"))
            post, i, j, prefix = (np.array(table.column(c)) for c in ("post", "i", "j", "mask"))
            sig = np.array(table.column("values").combine_chunks().flatten()).reshape(-1, COORDINATES)
            found = []
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = np.arange(begin, end)
                left, right = (own, own) if i[begin] == j[begin] else (own[block[begin:end] == i[begin]], own[block[begin:end] == j[begin]])
                x, y = (g.ravel() for g in np.meshgrid(left, right, indexing="ij"))
                ok = (label[x] != label[y]) & ((x < y) | (i[begin] != j[begin]))
                x, y = x[ok], y[ok]
                most = np.minimum(np.minimum(shared[x], shared[y]), np.minimum(n[x], n[y]))
                ok = 100 * most >= enough * (n[x] + n[y] - most)
                x, y = x[ok], y[ok]
                own_bit = np.int64(1) << np.int64(post[begin] >> 32)
                for at in range(0, len(x), STEP_PAIRS):
                    p, q = x[at : at + STEP_PAIRS], y[at : at + STEP_PAIRS]
                    same = sig[p] == sig[q]
                    bits = np.packbits(same, axis=1, bitorder="little").view(np.int64).ravel() & prefix[p] & prefix[q]
                    ok = ((bits & -bits) == own_bit) & (same.sum(1) >= least)
                    found.append((rep[p[ok]], rep[q[ok]]))
            if found:
                x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=kinds)

    return run


def near_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", enough: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row: documents are linked where 100 times their common shingles reach
    ``enough`` times their joint ones; a component's smallest key stays.

    Shingles are five words (runs of anything but ASCII white space, A-Z in lower case) of the whole text, fewer words are one
    shingle, and documents without words are linked with nothing. Each document has a MinHash signature of ``COORDINATES``
    values. Steps:

    1. Documents of equal shingle sets are one class, so copies cost a row each.
    2. Classes are posted under every (coordinate, value). Values of one class are dropped; a class that has fewer than ``matches(enough)``
       others can reach no pair. In order of list length, all but the last ``matches(enough) - 1`` values of a class are its prefix: two
       classes with ``matches(enough)`` values in common have a prefix value in common, so long lists are skipped for what they would add.
    3. Every list names the member with the most values on lists its pivot; each class is compared with the pivot that it shares most
       lists with. Confirmed links make first components, so a group of near copies shrinks to one before any pairs are made.
    4. Lists that still hold several components count collisions among their members, in pairs of blocks of ``BLOCK`` members. A
       pair is a candidate if it is of two components, has ``matches(enough)`` values in common, and can have enough common shingles given
       how many of each one's shingles occur in any other component that is left (found in ``PRUNINGS`` rounds).
    5. Candidates are confirmed on whole shingle sets; links of both rounds make the components.

    Rows with a null key are linked with nothing and kept (their component is null). Rows that repeat a key are one node. An empty
    table gives no rows; other columns are ignored.
    """
    least = matches(enough)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    signed = rows.mapInArrow(_signed, "doc_id long, n long, a long, b long, values array<int>").withColumn("row", F.monotonically_increasing_id())
    signed = stored(signed, "signed")
    sets = ["a", "b", "n"]
    usable = signed.where("n > 0 and doc_id is not null")
    classes = usable.groupBy(*sets).agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies"))
    copied = stored(classes.where("copies > 1").select(*sets, "first.doc_id", "first.row").withColumnsRenamed({"doc_id": "rep", "row": "rep_row"}), "copied")
    members = stored(usable.select("doc_id", "row", *sets).join(copied, sets).select("doc_id", "row", "rep", "rep_row"), "members")
    extra = members.where("row <> rep_row").select("row")
    reps = usable.join(extra, "row", "left_anti").select(F.col("doc_id").alias("rep"), "n", "values")

    posted = reps.select("rep", F.posexplode("values").alias("at", "value")).select("rep", F.expr("shiftleft(CAST(at AS LONG), 32) | (value & 4294967295L)").alias("post"))
    lists = stored(posted.groupBy("post").agg(F.count("*").alias("size")).where("size > 1"), "lists")
    on_lists = posted.join(lists, "post").groupBy("rep").agg(F.collect_list(F.struct("size", "post")).alias("on")).where(F.size("on") >= least)
    prefixes = stored(on_lists.select("rep", F.size("on").alias("held"), F.slice(F.sort_array("on"), F.lit(1), F.size("on") - (least - 1)).alias("prefix")), "prefixes")
    listed = prefixes.select("rep", "held", F.explode("prefix.post").alias("post"))

    pivots = stored(listed.groupBy("post").agg(F.max(F.struct("held", F.negative("rep").alias("minus"))).alias("m")).select("post", F.negative("m.minus").alias("pivot")), "pivots")
    near = listed.join(pivots, "post").where("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("n"))
    stars = near.groupBy("rep").agg(F.max(F.struct("n", F.negative("pivot").alias("minus"))).alias("m")).select(F.col("rep").alias("x"), F.negative("m.minus").alias("y"))
    texts = rows.withColumnRenamed("doc_id", "rep").join(prefixes.select("rep"), "rep", "left_semi").withColumnRenamed("rep", "doc_id")
    whole = stored(texts.mapInArrow(_whole_sets, "rep long, shingles binary"), "sets")

    def confirmed(pairs: DataFrame, purpose: str) -> DataFrame:
        xs, ys = (whole.select(F.col("rep").alias(c), F.col("shingles").alias(c + "s")) for c in "xy")
        return stored(pairs.join(xs, "x").join(ys, "y").select("x", "y", "xs", "ys").mapInArrow(_confirmed(enough), "x long, y long"), purpose)

    stars = stored(stars, "stars")
    first = confirmed(stars, "first-links")
    label = stored(prefixes.select(F.col("rep").alias("node")).distinct().join(components(first, "x", "y"), "node", "left").select(F.col("node").alias("rep"), F.coalesce("component", "node").alias("label")), "first-components")
    labelled = listed.drop("held").join(label, "rep")
    open_lists = stored(labelled.groupBy("post").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high").select("post", "size"), "open-lists")
    open_posts = stored(labelled.join(open_lists, "post"), "open-posts")
    active = stored(open_posts.select("rep", "label").distinct(), "active")
    sizes, masks = reps.select("rep", "n", "values"), prefixes.select("rep", F.expr("aggregate(prefix, 0L, (s, p) -> s | shiftleft(1L, CAST(shiftright(p.post, 32) AS INT)))").alias("mask"))
    able, scratch = active, [copied, lists, pivots, stars, label, open_lists, open_posts, active]
    for _ in range(PRUNINGS):
        spelled = whole.join(able.select("rep", "label"), "rep").select("rep", "label", "shingles").mapInArrow(_spelled, "rep long, label long, shingle long")
        wide = stored(spelled.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle"), "wide")
        shared = stored(spelled.join(wide, "shingle").groupBy("rep", "label").agg(F.count("*").alias("shared")), "shared")
        able = stored(sizes.join(shared, "rep").where(100 * F.col("shared") >= enough * F.col("n")).join(masks, "rep"), "able")
        scratch += [wide, shared, able]
    able_posts = stored(open_posts.drop("size").join(able.select("rep"), "rep", "left_semi"), "able-posts")
    still_open = stored(able_posts.groupBy("post").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high").select("post", "size"), "still-open")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cells = able_posts.join(still_open, "post").withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("post", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "label").join(able.drop("label"), "rep")
    sorted_cells = cells.repartition("post", "i", "j").sortWithinPartitions("post", "i", "j")
    candidates = stored(sorted_cells.mapInArrow(_collisions(enough), "x long, y long"), "candidates")
    second = confirmed(candidates, "second-links")
    discard(*scratch, prefixes, whole, able_posts, still_open, candidates)

    doubled = usable.groupBy("doc_id").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("doc_id")
    same = members.join(doubled, "doc_id", "left_semi").select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))
    groups = stored(components(first.unionByName(second).unionByName(same), "x", "y"), "components")
    discard(first, second)
    final = signed.select("doc_id", "row", "n").join(members.where("row <> rep_row").select("row", "rep"), "row", "left").withColumn("node", F.coalesce("rep", "doc_id"))
    one = final.join(groups, "node", "left")
    return one.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
