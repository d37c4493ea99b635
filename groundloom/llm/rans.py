"""Token-id files coded by a static range asymmetric numeral system, in independent blocks of interleaved states.

A file is a folder written by Spark's Parquet writer:

``table``: ``symbol, freq``, shared by all blocks; the frequencies sum to a power of two.
``blocks``: one row per block of whole documents in ascending order of their keys: ``keys`` and ``lengths`` of the documents, ``start``
(ids of all documents before the block), ``n`` (ids), ``lanes``, ``states`` (each lane's first state, 64 bits), ``words`` (the 32-bit
words that the lanes read, in reading order), ``check_words`` and ``check_states`` (position in ``words`` and states before every
``CHECK_STEPS``-th step, from which decoding can begin), ``check_crc32`` (checksums of the runs between them), ``crc32`` of the ids as
little-endian unsigned 32-bit integers.

Id ``i`` of a block belongs to lane ``i % lanes``, so a step of the coder treats as many ids as there are lanes at once.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .packing import part_starts
from .tokens import ChunkEncoder, text_lists

BLOCK_IDS = 1 << 18
LANES = 1024
CHECK_STEPS = 128
FLOOR = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)


class Coder:
    """Encodes and decodes arrays of ids by one frequency table."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.bits = int(freqs.sum()).bit_length() - 1
        size = int(symbols.max()) + 1
        self.freq, self.low = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[symbols] = freqs
        self.low[symbols] = np.cumsum(freqs) - freqs
        self.symbol = np.repeat(symbols, freqs).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> dict:
        n = len(ids)
        lanes = min(LANES, 1 << max(0, (n // 64).bit_length() - 1)) if n else 1
        steps = -(-n // lanes)
        shift, room = np.uint64(self.bits), np.uint64(63 - self.bits)
        x, words, checks = np.full(lanes, FLOOR), [None] * steps, []
        for step in range(steps - 1, -1, -1):
            part = ids[step * lanes : (step + 1) * lanes]
            freq, low, now = self.freq[part], self.low[part], x[: len(part)]
            full = now >= freq << room
            words[step] = now[full].astype("<u4")
            now = np.where(full, now >> WORD_BITS, now)
            whole = now // freq
            x[: len(part)] = (whole << shift) + (now - whole * freq) + low
            if step and step % CHECK_STEPS == 0:
                checks.append((step, x.copy()))
        ends = np.cumsum([len(w) for w in words]) if steps else np.zeros(0, np.int64)
        checks.reverse()
        run, wide = CHECK_STEPS * lanes, ids.astype("<u4")
        return {
            "n": n,
            "lanes": lanes,
            "states": x.astype("<u8").tobytes(),
            "words": np.concatenate(words).tobytes() if steps else b"",
            "check_words": [int(ends[step - 1]) for step, _ in checks],
            "check_states": b"".join(s.astype("<u8").tobytes() for _, s in checks),
            "check_crc32": [zlib.crc32(wide[at : at + run].tobytes()) for at in range(0, n, run)],
            "crc32": zlib.crc32(wide.tobytes()),
        }

    def decode(self, block: dict, check: int = 0) -> np.ndarray:
        """The block's ids, from its ``check``-th checkpoint on (0: from the beginning)."""
        lanes, states, words = block["lanes"], block["states"], block["words"]
        if check:
            states = block["check_states"][8 * (check - 1) * lanes : 8 * check * lanes]
            words = words[4 * block["check_words"][check - 1] :]
        return self.decode_run(states, words, block["n"] - check * CHECK_STEPS * lanes)

    def decode_run(self, states: bytes, words: bytes, n: int) -> np.ndarray:
        """``n`` ids from the states of all lanes before the first and the words that follow."""
        x, words, at = np.frombuffer(states, "<u8").astype(np.uint64), np.frombuffer(words, "<u4").astype(np.uint64), 0
        lanes = len(x)
        shift, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        out = np.empty(n, np.uint32)
        for begin in range(0, len(out), lanes):
            now = x[: min(lanes, len(out) - begin)]
            slot = now & mask
            symbol = self.symbol[slot.astype(np.int64)]
            out[begin : begin + len(now)] = symbol
            now = self.freq[symbol] * (now >> shift) + slot - self.low[symbol]
            empty = np.flatnonzero(now < FLOOR)
            now[empty] = (now[empty] << WORD_BITS) | words[at : at + len(empty)]
            at += len(empty)
            x[: len(now)] = now
        return out


def frequency_table(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that follow the counts and sum to a power of two, 16 times the number of symbols or more."""
    total = 1 << max(16, math.ceil(math.log2(len(symbols))) + 4)
    freqs = 1 + np.floor(counts.astype(np.float64) * ((total - len(symbols)) / counts.sum())).astype(np.int64)
    freqs[np.argmax(counts)] += total - int(freqs.sum())
    return freqs


def write_ids(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1) -> None:
    """Encode whole texts and write their ids to ``path`` in ascending order of keys (null first, equal keys by text).

    Keys are dealt out by ranges, so each task codes a run of the order; ids are written once, uncoded, then counted for the table
    (at most a row per entry of the vocabulary reaches the driver) and coded. A null text counts as empty and holds its end id
    alone. A document is never split over blocks, so one longer than ``BLOCK_IDS`` has a long block of its own. An empty table
    writes an empty file.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).repartitionByRange("_key").sortWithinPartitions("_key", "_text")

    def gather(batches):
        encoder, part, before = ChunkEncoder.shared(tokenizer, end_id), TaskContext.get().partitionId(), 0
        keys, ids, held = [], [], 0

        def block():
            lengths = [len(x) // encoder.dtype.itemsize for x in ids]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([before], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([[k.as_py() for k in keys]], pa.list_(key_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([b"".join(ids)], pa.binary()), pa.array([encoder.dtype.itemsize], pa.int32())],
                names=["part", "before", "n", "keys", "lengths", "ids", "width"],
            )

        for batch in batches:
            key_type = batch.schema.field("_key").type
            for part_rows, texts in text_lists(batch, "_text", 64):
                for k, x in zip(part_rows.column("_key"), encoder.encode(texts), strict=True):
                    keys.append(k)
                    ids.append(x)
                    held += len(x) // encoder.dtype.itemsize
                    if held >= BLOCK_IDS:
                        yield block()
                        before += held
                        keys, ids, held = [], [], 0
        if ids:
            yield block()

    raw = stored(rows.mapInArrow(gather, f"part long, before long, n long, keys array<{kind}>, lengths array<long>, ids binary, width int"), "raw-ids")

    def count(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for data, width in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True):
                own = np.bincount(np.frombuffer(data, f"<u{width}"), minlength=len(counts))
                own[: len(counts)] += counts
                counts = own
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["symbol", "count"])

    counts = raw.select("ids", "width").mapInArrow(count, "symbol long, count long").groupBy("symbol").agg(F.sum("count").alias("count")).orderBy("symbol").collect()
    symbols = np.array([r[0] for r in counts], np.int64)
    freqs = frequency_table(symbols, np.array([r[1] for r in counts], np.int64)) if counts else np.zeros(0, np.int64)
    spark.createDataFrame([(int(s), int(f)) for s, f in zip(symbols, freqs, strict=True)], "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")

    def code(batches):
        coder = None
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                coder = coder or Coder(symbols, freqs)
                ids = np.frombuffer(one.column("ids")[0].as_py(), f"<u{one.column('width')[0].as_py()}")
                b = coder.encode(ids)
                start = one.column("base")[0].as_py() + one.column("before")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [one.column("keys"), one.column("lengths"), pa.array([start], pa.int64()), pa.array([b["n"]], pa.int64()), pa.array([b["lanes"]], pa.int32()), pa.array([b["states"]], pa.binary()), pa.array([b["words"]], pa.binary()), pa.array([b["check_words"]], pa.list_(pa.int64())), pa.array([b["check_states"]], pa.binary()), pa.array([b["check_crc32"]], pa.list_(pa.int64())), pa.array([b["crc32"]], pa.int64())],
                    names=["keys", "lengths", "start", "n", "lanes", "states", "words", "check_words", "check_states", "check_crc32", "crc32"],
                )

    placed = raw.join(F.broadcast(part_starts(raw)), "part")
    placed.mapInArrow(code, f"keys array<{kind}>, lengths array<long>, start long, n long, lanes int, states binary, words binary, check_words array<long>, check_states binary, check_crc32 array<long>, crc32 long").write.parquet(f"{path}/blocks")


# Fixed value: the polynomial of the checksum, lowest power in the highest bit.
POLYNOMIAL = 0xEDB88320


def _product(a: int, b: int) -> int:
    """Product of two polynomials over bits, reduced by that of the checksum."""
    total = 0
    for power in range(31, -1, -1):
        if a >> power & 1:
            total ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return total


def joined_crc32(first: int, second: int, length: int) -> int:
    """The checksum of two runs of bytes in a row from those of each and the second's length: the first times ``x`` to 8 a byte."""
    power, square, bits = 1 << 31, 1 << 30, 8 * length
    while bits:
        if bits & 1:
            power = _product(power, square)
        square, bits = _product(square, square), bits >> 1
    return _product(power, first) ^ second


def _ranges(batches):
    """Each block of some length as ranges of checkpoints: the states and words to decode one from, and the documents that it holds."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            b = {c: one.column(c)[0].as_py() for c in ("start", "n", "lanes", "states", "words", "check_words", "check_states", "check_crc32")}
            run, keys = CHECK_STEPS * b["lanes"], one.column("keys")[0].values
            step, state = max(1, BLOCK_IDS // run), 8 * b["lanes"]
            lengths = np.array(one.column("lengths")[0].values)
            ends = np.cumsum(lengths)
            marks = [0, *b["check_words"]]
            for first in range(0, len(marks), step):
                begin, end = first * run, min(b["n"], (first + step) * run)
                lo, hi = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
                stop = 4 * marks[first + step] if first + step < len(marks) else None
                states = b["check_states"][(first - 1) * state : first * state] if first else b["states"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["start"] + begin]), pa.array([end - begin]), pa.array([run]), pa.array([states], pa.binary()), pa.array([b["words"][4 * marks[first] : stop]], pa.binary()), pa.array([b["check_crc32"][first : first + step]], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), keys.slice(lo, hi - lo)), pa.array([b["start"] + ends[lo:hi] - lengths[lo:hi]]), pa.array([lengths[lo:hi]])],
                    names=["at", "n", "run", "states", "words", "crc32s", "keys", "starts", "lengths"],
                )


def _whole(pieces: pa.Table) -> pa.Table:
    """One document from the pieces of it that the ranges hold."""
    pieces = pieces.sort_by("place")
    crc, size = 0, pieces.schema.names.index("crc32")
    for own, n in zip(pieces["crc32"].to_pylist(), pieces["length"].to_pylist(), strict=True):
        crc = joined_crc32(crc, own, 4 * n)
    row = pieces.slice(0, 1).set_column(size, "ids_crc32", pa.array([crc], pa.int64()))
    if "ids" in row.column_names:
        row = row.set_column(row.schema.names.index("ids"), "ids", pa.array([b"".join(pieces["ids"].to_pylist())], pa.binary()))
    return row.drop_columns(["place", "length"])


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` and, if wanted, ``ids`` per document from a file of ``write_ids``.

    Blocks are decoded side by side, and a block of more than twice ``BLOCK_IDS``, which a long document makes, in ranges of
    checkpoints that are dealt out to tasks; a document's checksum is put together from those of its pieces. A block or range whose
    ids don't have their checksum fails the job.
    """
    rows = spark.read.parquet(f"{path}/table").orderBy("symbol").collect()
    symbols, freqs = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    long, ids_field = F.col("n") > 2 * BLOCK_IDS, ", ids binary" if with_ids else ""

    def decode(batches):
        coder = None
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                coder = coder or Coder(symbols, freqs)
                block = {c: one.column(c)[0].as_py() for c in ("start", "n", "lanes", "states", "words", "crc32")}
                ids = coder.decode(block).astype("<u4")
                if zlib.crc32(ids.tobytes()) != block["crc32"]:
                    raise ValueError(f"block at id {block['start']} is damaged")
                lengths = np.array(one.column("lengths")[0].values)
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [one.column("keys")[0].values, pa.array(block["start"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(parts, pa.binary())] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    def decode_ranges(batches):
        coder = None
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                coder = coder or Coder(symbols, freqs)
                r = {c: one.column(c)[0].as_py() for c in ("at", "n", "run", "states", "words", "crc32s")}
                ids = coder.decode_run(r["states"], r["words"], r["n"]).astype("<u4")
                if [zlib.crc32(ids[i : i + r["run"]].tobytes()) for i in range(0, len(ids), r["run"])] != r["crc32s"]:
                    raise ValueError(f"range at id {r['at']} is damaged")
                starts, lengths = np.array(one.column("starts")[0].values), np.array(one.column("lengths")[0].values)
                lo, hi = np.maximum(starts, r["at"]), np.minimum(starts + lengths, r["at"] + r["n"])
                parts = [ids[a - r["at"] : b - r["at"]].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                columns = [one.column("keys")[0].values, pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(lo), pa.array(hi - lo)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(parts, pa.binary())] if with_ids else [])], names=["doc_id", "start", "n_tokens", "crc32", "place", "length", "ids"][: 6 + with_ids])

    plain = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long{ids_field}"
    short = blocks.where(~long).mapInArrow(decode, plain)
    ranges = blocks.where(long).mapInArrow(_ranges, f"at long, n long, run long, states binary, words binary, crc32s array<long>, keys array<{kind}>, starts array<long>, lengths array<long>")
    pieces = ranges.repartition("at").mapInArrow(decode_ranges, f"doc_id {kind}, start long, n_tokens long, crc32 long, place long, length long{ids_field}")
    return short.unionByName(pieces.groupBy("start").applyInArrow(_whole, plain))
