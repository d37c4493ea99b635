"""Exact duplicates by deterministic block naming: blocks, then pairs of names, are sorted into integer names."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, stored

#: Bytes per block; bytes of blocks that a task hands on at once.
BLOCK, BATCH_BYTES = 4096, 1 << 24
#: Names that one task may give: a name is the task's number times this, plus the name's place in the task's sorted rows.
TASK_NAMES = 1 << 40


def _split(names: list[str]):
    """Blocks of normalised texts. A text's first block carries its key and the digest of the whole."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, out, size = batch.column(0), [[] for _ in range(6)], 0
            for at, text in enumerate(batch.column(1).cast(pa.binary())):
                data = (text.as_py() or b"").lower()
                count = max(1, -(-len(data) // BLOCK))
                digest = hashlib.sha256(data).hexdigest()
                for pos in range(count):
                    block = data[pos * BLOCK : (pos + 1) * BLOCK]
                    for column, x in zip(out, (row, pos, count, at if pos == 0 else None, digest if pos == 0 else None, block), strict=True):
                        column.append(x)
                    size += len(block) + 64
                    if size >= BATCH_BYTES:
                        yield _blocks(names, keys, out)
                        out, size = [[] for _ in range(6)], 0
                row += 1
            if out[0]:
                yield _blocks(names, keys, out)

    return run


def _blocks(names: list[str], keys: pa.Array, out: list[list]) -> pa.RecordBatch:
    rows, pos, counts, at, digests, blocks = out
    columns = [pa.array(rows, pa.int64()), pa.array(pos, pa.int64()), pa.array(counts, pa.int64()), keys.take(pa.array(at, pa.int64())), pa.array(digests, pa.string()), pa.array(blocks, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _numbered(content: list[str], carried: list[str]):
    """Names for sorted rows: one more wherever the content differs from the row before. The contents that share their hash with the
    task's first or last row may go on in other tasks; they follow as rows of their own, without a place."""

    def run(batches):
        name = TaskContext.get().partitionId() * TASK_NAMES - 1
        before, first, last, heads, tails, schema = None, None, None, {}, {}, None
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            schema = batch.schema
            columns = [batch.column(c) for c in content]
            new = np.zeros(n, bool)
            for c in columns:
                new[1:] |= np.array(pc.not_equal(c.slice(1), c.slice(0, n - 1)))
            new[0] = before != [c[0].as_py() for c in columns]
            before = [c[n - 1].as_py() for c in columns]
            names = name + np.cumsum(new)
            name = int(names[-1])
            hashes = np.array(batch.column("h"))
            first = int(hashes[0]) if first is None else first
            if last != int(hashes[-1]):
                last, tails = int(hashes[-1]), {}
            for h, held in ((first, heads), (last, tails)):
                for i in np.flatnonzero(new & (hashes == h)).tolist():
                    held[int(names[i])] = (h, [c[i].as_py() for c in columns])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(names), *(pa.nulls(n, batch.schema.field(c).type) for c in ("h", *content))], names=[*carried, "name", "h", *content])
        ends = heads | tails
        if ends:
            none = [pa.nulls(len(ends), schema.field(c).type) for c in carried]
            values = [pa.array([e[1][i] for e in ends.values()], schema.field(c).type) for i, c in enumerate(content)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(list(ends), pa.int64()), pa.array([e[0] for e in ends.values()], pa.int64()), *values], names=[*carried, "name", "h", *content])

    return run


def named(rows: DataFrame, content: list[str], digest=F.xxhash64) -> DataFrame:
    """The rows with ``name`` instead of their ``content`` columns: an integer that equal contents share and different ones don't.

    Rows are dealt out by ranges of (hash, row, place) and sorted by hash and content within them, so contents are compared
    themselves, and a content with any share of all rows is spread over several tasks. Names given to one content by several tasks
    are then made one: only contents with the hash of a task's first or last row can be such, two a task but for equal hashes of
    different contents. What is broadcast are those names, and what is stored are names, not contents.
    """
    carried = [c for c in rows.columns if c not in content]
    ranged = rows.withColumn("h", digest(*content)).repartitionByRange("h", "row", "pos").sortWithinPartitions("h", *content)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "name long", "h long", *(f"`{c}` {kinds[c]}" for c in content)])
    numbers = stored(ranged.mapInArrow(_numbered(content, carried), schema), "names")
    ends = numbers.where("row IS NULL").groupBy("h", *content).agg(F.min("name").alias("one"), F.collect_set("name").alias("names"))
    moved = ends.where(F.size("names") > 1).select("one", F.explode("names").alias("name")).where("name <> one")
    out = numbers.where("row IS NOT NULL").join(F.broadcast(moved), "name", "left").select(*carried, F.coalesce("one", "name").alias("name"))
    out._stored_at = numbers._stored_at
    return out


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row: texts are equal when identical after lower-casing A-Z.

    Each normalised text is cut into blocks of ``BLOCK`` bytes of UTF-8. Distinct blocks are named by sorting them; then adjacent
    pairs of names are named, an odd last one with nothing beside it, until one name is left. That name and the number of rounds
    are the text's identity: contents and pairs are compared themselves, so no two texts share one. Rounds follow the logarithm of
    the longest text, and each holds only the texts that still have several names. Whole texts are read once more for the ranges'
    bounds, and their blocks are shuffled once.

    A null text is empty, and all empty texts are equal. Of equal texts the row with the largest key stays; a null key is smaller
    than any other, and of rows that repeat the largest key exactly one stays. ``keep_id`` is null where all keys of a group are. An
    empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["row", "pos", "blocks", "key", "sha", "block"]
    table = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = table.mapInArrow(_split(names), f"row long, pos long, blocks long, key {kind}, sha string, block binary")
    content, level, done, scratch = ["block"], 0, [], []
    while True:
        level += 1
        one = named(rows, content)
        scratch.append(one)
        done.append(one.where("blocks = 1").select("row", "key", "sha", F.lit(level).alias("level"), "name"))
        left = one.where("blocks > 1")
        if left.isEmpty():
            break
        side = F.col("pos") % 2
        pairs = left.groupBy("row", F.shiftright("pos", 1).alias("pos")).agg(
            F.floor((F.max("blocks") + 1) / 2).alias("blocks"),
            F.max("key").alias("key"),
            F.max("sha").alias("sha"),
            F.max(F.when(side == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        rows, content = pairs, ["a", "b"]
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    whole = stored(whole, "identities")
    discard(*scratch)
    best = F.max(F.struct("key", "row"))
    groups = stored(whole.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    found = join_counted(whole, groups, ["level", "name"], "group_size")
    return found.select(F.col("key").alias("doc_id"), F.col("best.key").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))
