"""Prefix trie of conversations, its subtree totals by time-forward processing: nodes in reverse level order, messages to parents."""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, stored

#: A prefix of turns is named by a polynomial of their 126-bit digests modulo a prime of 127 bits.
PRIME, BASE = (1 << 127) - 1, int.from_bytes(hashlib.sha256(b"prefix").digest()[:15], "big")
#: Levels per band, and rows per shard: a subtree with fewer rows below it is light. Light subtrees are shards.
BAND, SHARE, LEAST_ROWS = 4096, 256, 1024
#: Messages that a queue holds in memory, and ids that are hashed as one piece.
QUEUE, PIECE = 1 << 18, 8192
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


# --- prefixes -------------------------------------------------------------------------------------


def _scanned(batches):
    """Place of every turn among those of its conversation that the task holds, and the polynomials of the turns up to it and before it,
    from sorted rows."""
    part, conv, place, total = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for c, digest, chars in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if c != conv:
                conv, place, total = c, 0, 0
            before, place, total = total, place + 1, (total * BASE + (_number(digest) >> 2)) % PRIME
            for column, x in zip(out, (c, place, _bytes(total), _bytes(before), chars), strict=True):
                column.append(x)
        n = len(out[0])
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64())], names=["part", "conv", "i", "p", "q", "chars"])


def _carries(scanned: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Per task the conversation that it goes on with, that one's turns in earlier tasks and their polynomial. One row per task."""
    tasks = scanned.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "i", "p")).alias("last")).orderBy("part").collect()
    carries, open_conv, turns, total = {}, None, 0, 0
    for task in tasks:
        if task["first"] == open_conv:
            carries[task["part"]] = (open_conv, turns, total)
        last = task["last"]
        goes_on = last["conv"] == open_conv
        total = (total * pow(BASE, last["i"], PRIME) if goes_on else 0) + _number(last["p"])
        open_conv, turns, total = last["conv"], (turns if goes_on else 0) + last["i"], total % PRIME
    return carries


def _carried(carries: dict[int, tuple[int, int, int]]):
    def run(batches):
        for batch in batches:
            parts, convs, places, sums, before = (batch.column(c).to_pylist() for c in ("part", "conv", "i", "p", "q"))
            for n, (part, conv) in enumerate(zip(parts, convs, strict=True)):
                if part in carries and carries[part][0] == conv:
                    _, turns, total = carries[part]
                    shift = total * pow(BASE, places[n] - 1, PRIME) % PRIME
                    sums[n], before[n] = _bytes((shift * BASE + _number(sums[n])) % PRIME), _bytes((shift + _number(before[n])) % PRIME)
                    places[n] += turns
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(places, pa.int64()), pa.array(sums, pa.binary()), pa.array(before, pa.binary()), batch.column("chars")], names=["conv", "i", "p", "q", "chars"])

    return run


def ordered_turns(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, i, p, q, chars)``: place from 1, polynomials of the turns up to this one and before it, and code points of the text.

    Turns are dealt out by ranges of (conversation, turn) as digests, without their texts. A conversation of any share of all turns
    is spread over several tasks; what its earlier tasks found is carried on by one row per task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = rows.select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("n")).where("conv IS NOT NULL")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("n")]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "chars")
    scanned = stored(placed.mapInArrow(_scanned, "part int, conv long, i long, p binary, q binary, chars long"), "turns")
    out = scanned.mapInArrow(_carried(_carries(scanned)), "conv long, i long, p binary, q binary, chars long")
    out._stored_at = scanned._stored_at
    return out


def _rebuilt(batches):
    """Prefixes of the rebuilt conversation from its own turns: the polynomial after its first ``h`` turns is put in place of theirs."""
    for batch in batches:
        depth, nodes, parents = [], [], []
        for i, p, q, k, h, head, own in zip(*(batch.column(c).to_pylist() for c in ("i", "p", "q", "k", "h", "head_p", "own_p")), strict=True):
            shift = (_number(head) - _number(own)) * pow(BASE, i - h - 1, PRIME) % PRIME
            depth.append(k + i - h)
            nodes.append(_bytes((_number(p) + shift * BASE) % PRIME))
            parents.append(_bytes((_number(q) + shift) % PRIME))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(depth, pa.int64()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch.column("chars"), batch.column("total")], names=["conv", "depth", "node", "parent", "chars", "total"])


def rebuilt_prefixes(turns: DataFrame, base: Column, h: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes ``(conv, depth, node, parent, chars, total)`` of all rebuilt conversations, and their lengths ``(conv, total)``.

    A conversation takes the first ``h`` (up to ``most``) turns of conversation ``base``, both columns over ``conv``, and then its own
    after its first ``h``.
    """
    entry = F.when(F.col("i") <= most, F.struct("i", "p", "q", "chars"))
    # At most ``most`` entries per conversation.
    convs = turns.groupBy("conv").agg(F.max("i").alias("n"), F.array_sort(F.collect_list(entry)).alias("own"))
    convs = stored(convs.withColumn("h", h.cast("int")).withColumn("base", base), "conversations")
    heads = convs.select(F.col("conv").alias("base"), F.col("own").alias("head"))
    zero = F.lit(_bytes(0))

    def after(entries: str, n: Column) -> Column:
        return F.when(n > 0, F.get(entries, n - 1)["p"]).otherwise(zero)

    some = F.coalesce("head", F.array().cast(convs.schema["own"].dataType))
    info = convs.join(heads, "base", "left").withColumn("head", F.slice(some, F.lit(1), F.col("h"))).withColumn("k", F.size("head"))
    info = info.withColumn("total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    info = stored(info.select("conv", "n", "h", "k", "total", "head", after("head", F.col("k")).alias("head_p"), after("own", F.least(F.col("h"), F.size("own"))).alias("own_p")), "rebuilt")
    first = info.select("conv", "total", F.explode("head").alias("e")).select("conv", F.col("e.i").alias("depth"), F.col("e.p").alias("node"), F.col("e.q").alias("parent"), F.col("e.chars").alias("chars"), "total")
    later = join_counted(turns, info.select("conv", "n", "h", "k", "total", "head_p", "own_p"), ["conv"], "n").where("i > h")
    own = later.select("conv", "i", "p", "q", "chars", "k", "h", "total", "head_p", "own_p").mapInArrow(_rebuilt, "conv long, depth long, node binary, parent binary, chars long, total long")
    prefixes = stored(first.unionByName(own), "prefixes")
    lengths = stored(info.select("conv", "total"), "lengths")
    discard(convs, info)
    return prefixes, lengths


# --- ends -----------------------------------------------------------------------------------------


def _pieces(batches):
    """Sorted ids of each node as pieces of text."""
    node, ids = None, []

    def piece():
        return pa.RecordBatch.from_pylist([{"depth": node[0], "node": node[1], "first": ids[0], "ids": ",".join(map(str, ids))}], schema=pa.schema([("depth", pa.int64()), ("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))

    for batch in batches:
        for depth, name, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "conv")), strict=True):
            if ids and (node != (depth, name) or len(ids) == PIECE):
                yield piece()
                ids = []
            node = (depth, name)
            ids.append(conv)
    if ids:
        yield piece()


def _digests(batches):
    """Digest of each node's pieces, which come in order; a piece is dropped once it is hashed."""
    schema = pa.schema([("depth", pa.int64()), ("node", pa.binary()), ("ends_sha256", pa.string())])
    node, digest, done = None, None, []
    for batch in batches:
        for depth, name, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
            if node == (depth, name):
                digest.update(b",")
            else:
                if node is not None:
                    done.append({"depth": node[0], "node": node[1], "ends_sha256": digest.hexdigest()})
                node, digest = (depth, name), hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pylist(done, schema=schema)
        done = []
    if node is not None:
        yield pa.RecordBatch.from_pylist([{"depth": node[0], "node": node[1], "ends_sha256": digest.hexdigest()}], schema=schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(depth, node, ends_sha256)`` of ``(depth, node, conv)``. Ids become text in ranges that may split a node; as a digest has no
    parts, the pieces of one node, ``PIECE`` ids a row, then stream through one task."""
    order = ["depth", "node", "conv"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, node binary, first long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, node binary, ends_sha256 string")


# --- time-forward processing ----------------------------------------------------------------------


class SpillingQueue:
    """Messages ``(level, node, children, leaves, saved)`` by level and node, the smallest first.

    Up to ``most`` are held in memory; beyond, they go as a sorted run to an unnamed file of the task, which is read forward only,
    belongs to this process and is gone with it.
    """

    RECORD = ">q16s3q"

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs = most, [], []

    def push(self, message: tuple[int, bytes, int, int, int]) -> None:
        if len(self.heap) >= self.most:
            file = tempfile.TemporaryFile()
            for m in sorted(self.heap):
                file.write(struct.pack(self.RECORD, *m))
            file.seek(0)
            self.heap = []
            self._advance(file)
        heapq.heappush(self.heap, message)

    def _advance(self, file) -> None:
        data = file.read(struct.calcsize(self.RECORD))
        if data:
            heapq.heappush(self.runs, (struct.unpack(self.RECORD, data), id(file), file))
        else:
            file.close()

    def pop(self, level: int, node: bytes) -> Iterator[tuple[int, int, int]]:
        """All messages for one node."""
        while True:
            run = self.runs and (not self.heap or self.runs[0][0] < self.heap[0])
            head = self.runs[0][0] if run else self.heap[0] if self.heap else None
            if head is None or head[:2] != (level, node):
                return
            if run:
                _, _, file = heapq.heappop(self.runs)
                self._advance(file)
            else:
                heapq.heappop(self.heap)
            yield head[2:]


def _forward(most: int):
    """Totals of the nodes of shards, whose rows come by shard and reverse level: each node takes its messages off the queue and sends its
    own to its parent; the message of a shard's top node leaves the shard."""

    def run(batches):
        shard, queue = None, None
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for at, (own, depth, node, parent, top, n, chars, children, leaves, saved) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "depth", "node", "parent", "top", "n_convs", "chars", "in_children", "in_leaves", "in_saved")), strict=True)):
                if own != shard:
                    shard, queue = own, SpillingQueue(most)
                for c, l, s in queue.pop(-depth, node):
                    children, leaves, saved = children + c, leaves + l, saved + s
                leaves, saved = leaves or 1, saved + (n - 1) * chars
                if not top:
                    queue.push((1 - depth, parent, 1, leaves, saved))
                for column, x in zip(out, (at, children, leaves, saved, top), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("depth", "node", "parent", "conv", "n_convs")), *(pa.array(x, pa.int64()) for x in out[1:4]), batch.column("top")], names=["depth", "node", "parent", "conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "top"])

    return run


_TOTALS = "depth long, node binary, parent binary, conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _messages(*totals: DataFrame) -> DataFrame:
    """One message per parent: the sums over the top nodes below it."""
    tops = totals[0].where("top")
    for other in totals[1:]:
        tops = tops.unionByName(other.where("top"))
    return tops.where("parent IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved"))


def _with(nodes: DataFrame, messages: DataFrame | None) -> DataFrame:
    zero = {c: F.lit(0).cast("long") for c in ("in_children", "in_leaves", "in_saved")}
    if messages is None:
        return nodes.withColumns(zero)
    return nodes.join(messages, ["depth", "node"], "left").withColumns({c: F.coalesce(F.col(c), z) for c, z in zero.items()})


def subtree_totals(nodes: DataFrame, prefixes: DataFrame, rows: int, least_rows: int = LEAST_ROWS, band: int = BAND, queue: int = QUEUE) -> DataFrame:
    """Every node with ``n_children``, ``n_leaves`` and ``saved_tokens`` of its subtree. ``nodes``: depth, node, parent, conv, n_convs,
    chars, below; ``prefixes``: conv, depth, node; ``rows``: the number of prefixes.

    Levels are taken in bands from the deepest up. Within a band a node is light when the conversations below it have at most a
    ``SHARE``-th of all rows (``least_rows`` at least) left in the band. The topmost light node of a conversation is its shard, found by one aggregate
    over the band's prefixes, to which the other nodes go as a broadcast: at most ``SHARE`` of them on a level, so ``SHARE * band`` in
    all. A shard thus holds whole subtrees of bounded size. Shards are sorted by reverse level and processed in parallel; what leaves
    their roots, added up by parent, goes to the nodes above them, which are again processed in reverse level order; what leaves the
    band goes to the band above.
    """
    light_rows = max(least_rows, -(-rows // SHARE))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done: list[DataFrame] = []
    scratch: list[DataFrame] = []
    messages = None
    for at in range(deepest // band, -1, -1):
        inside = F.floor(F.col("depth") / band) == at
        own = nodes.where(inside)
        if deepest >= band:
            # Of a conversation that goes on below, only the levels of this band count.
            left = prefixes.where(inside).groupBy("depth", "node").agg(F.sum(F.least(F.col("total"), F.lit((at + 1) * band)) - F.col("depth")).alias("below"))
            own = own.drop("below").join(left, ["depth", "node"], "left").withColumn("below", F.coalesce("below", F.lit(rows)))
        own = stored(own, "band")
        heavy = own.where(F.col("below") > light_rows)
        marked = prefixes.where(inside).join(F.broadcast(heavy.select("depth", "node", F.lit(True).alias("heavy"))), ["depth", "node"], "left")
        shards = marked.where("heavy IS NULL").groupBy("conv").agg(F.min(F.struct("depth", "node")).alias("shard"))
        # Nodes of one conversation number at most those of a band.
        light = own.where(F.col("below") <= light_rows).join(shards, "conv", "left")
        # The root of all, if light, is a shard with all below it: its conversations' topmost light prefixes are not.
        whole = not own.where((F.col("depth") == 0) & (F.col("below") <= light_rows)).isEmpty()
        shard = F.lit(b"") if whole else F.col("shard.node")
        light = light.withColumn("top", F.lit(False) if whole else (F.col("depth") == F.col("shard.depth"))).withColumn("shard", shard)
        light = light.withColumn("top", F.col("top") | (F.col("depth") == 0))
        order = [F.col("shard"), F.desc("depth"), F.col("node")]
        ready = _with(light, messages).repartition("shard").sortWithinPartitions(*order)
        below = stored(ready.mapInArrow(_forward(queue), _TOTALS), "light")
        done.append(below)
        scratch += [own, below]
        arriving = _messages(below)
        if messages is not None:
            sums = [F.sum(c).alias(c) for c in ("in_children", "in_leaves", "in_saved")]
            arriving = arriving.unionByName(messages).groupBy("depth", "node").agg(*sums)
        top = _with(heavy, arriving).withColumn("shard", F.lit(b"")).withColumn("top", F.col("depth") == F.lit(at * band))
        above = stored(top.repartition(1).sortWithinPartitions(F.desc("depth"), F.col("node")).mapInArrow(_forward(queue), _TOTALS), "heavy")
        done.append(above)
        scratch.append(above)
        if at:
            last = F.col("depth") == F.lit(at * band)
            messages = stored(_messages(below.where(last), above.where(last)), "messages")
            scratch.append(messages)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    totals = stored(whole.drop("top"), "totals")
    discard(*scratch)
    return totals


def prefix_trie(rows: DataFrame, base: Column, h: Column, most: int, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **sizes: int) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``conv_id`` (its smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    ``base`` and ``h``, columns over ``conv``, say whose first ``h`` turns (``most`` at most) a conversation has in place of its own first
    ``h``. A node is a distinct sequence of (role, text); its members are the conversations that begin with it.

    Turns are ordered by ``turn``, null first; turns that tie are ordered by the digest of role and text, so repeated rows are turns one
    after the other. Null roles and texts are empty, and an empty text is a turn like any other. Rows with a null key belong to no
    conversation. An empty table gives no rows, not even a root. Other columns are ignored. Prefixes that differ share a name with a
    probability of their length times 2**-127.
    """
    turns = ordered_turns(rows, key, turn, role, text)
    prefixes, lengths = rebuilt_prefixes(turns, base, h, most)
    root = F.lit(_bytes(0))
    count, convs, least = prefixes.count(), *lengths.agg(F.count("*"), F.min("conv")).first()
    members = prefixes.groupBy("depth", "node").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.max("chars").alias("chars"), F.sum(F.col("total") - F.col("depth")).alias("below"))
    top = lengths.limit(1).select(F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(least).cast("long").alias("conv"), F.lit(convs).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"), F.lit(count).cast("long").alias("below"))
    nodes = stored(members.unionByName(top), "nodes")
    totals = subtree_totals(nodes, prefixes, count, **sizes)
    whole = lengths.where("total = 0").select(F.lit(0).cast("long").alias("depth"), root.alias("node"), "conv")
    ends = prefixes.where("depth = total").select("depth", "node", "conv").unionByName(whole)
    digests = ends_digests(ends)
    above = totals.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("_kids"))
    named = join_counted(totals.where("depth > 0"), above, ["depth", "parent"], "_kids").drop("_kids")
    root_row = totals.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = named.unionByName(root_row).join(digests, ["depth", "node"], "left")
    result = stored(found.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256")), "trie")
    discard(turns, prefixes, lengths, nodes, totals)
    return result
