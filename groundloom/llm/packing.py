"""Packing of documents into sequences of fixed length: concatenate and cut."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import ChunkEncoder, text_lists


def tokenized(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """``(key, ids, n, part, before)`` per document: its ids with the end id as bytes, their number, the input partition, and the number of ids before it in that partition."""
    fields = docs.select(key).schema.simpleString()[len("struct<") : -1].split(":", 1)[1]

    def run(batches):
        encoder, part, before = ChunkEncoder.shared(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in text_lists(batch, "_text"):
                ids = encoder.encode(texts)
                n = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
                ahead = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([rows.column("_key"), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(ahead), pa.array(np.full(len(n), encoder.dtype.itemsize, np.int32))], names=["_key", "ids", "n", "part", "before", "width"])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {fields}, ids binary, n long, part long, before long, width int")


def part_starts(rows: DataFrame, part: str = "part", n: str = "n") -> DataFrame:
    """``(part, base)``: ids before each partition. One row per partition of the table, so it may pass through one task and be broadcast."""
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(part).agg(F.sum(n).alias("_sum")).select(part, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("base"))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids.

    The documents' ids, each document's followed by ``end_id``, stand one after the other in the order in which the partitions of
    the table hold them; sequence ``i`` is the window of ids ``i * length`` to ``(i + 1) * length - 1``, so only the last sequence
    of all is padded. The first pass encodes whole texts and writes the ids with their places within the partition; the partitions'
    totals summed up give each partition's place; the second pass cuts. Nothing is shuffled, and a document that crosses a
    window's end has a piece on either side. As the ids are written once, lost executors change no place.

    One row per piece: ``doc_id, start`` (ids of its document before it), ``length, ids_crc32`` (of its ids as little-endian
    unsigned 32-bit integers), ``doc_tokens, sequence_id, offset`` (in the sequence). A null or empty text is its end id alone;
    null keys and repeated rows are packed like others; an empty table gives no rows; other columns are ignored.
    """
    ids = stored(tokenized(docs, key, text, tokenizer, end_id), "ids")
    placed = ids.join(F.broadcast(part_starts(ids)), "part")
    kind = ids.schema["_key"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            keys = batch.column("_key")
            take = []
            for row, (data, width, at) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), (np.array(batch.column("base")) + np.array(batch.column("before"))).tolist(), strict=True)):
                values = np.frombuffer(data, f"<u{width}").astype("<u4")
                begin = 0
                while begin < len(values):
                    offset = (at + begin) % length
                    end = min(len(values), begin + length - offset)
                    take.append(row)
                    for column, x in zip(out, (begin, end - begin, zlib.crc32(values[begin:end].tobytes()), len(values), (at + begin) // length, offset), strict=False):
                        column.append(x)
                    begin = end
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(take, pa.int64())), *(pa.array(x, pa.int64()) for x in out[:6])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.select("_key", "ids", "width", "before", "base").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
