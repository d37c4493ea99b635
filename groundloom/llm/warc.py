"""WARC archives: writing page records, and reading archives back by verified record boundaries."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

MAGIC = b"WARC/1.0\r\n"
#: Smaller payloads are always written in full.
LEAST_REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE) -> None:
    """One record per row, in one archive per partition of the table.

    The block of a record is an HTTP response head and the payload (null: empty). Among rows of equal payloads of at least
    ``LEAST_REVISIT_BYTES`` bytes, the one with the largest key is a ``response``; the others are ``revisit`` records, which have
    the head alone and refer to it. Rows that repeat the largest key are responses too; rows with a null key revisit a row with
    one and are responses where there is none. Line breaks in URLs are written percent-encoded. The records are text in UTF-8, so
    Spark's text writer makes the archives: each value ends with CR LF CR and the line separator adds the last LF.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("body"), F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes"))
    copies = rows.where(F.col("bytes") >= LEAST_REVISIT_BYTES).groupBy("digest", "bytes").agg(F.max("key").alias("newest"), F.count("*").alias("n")).where("n > 1 and newest is not null")
    joined = rows.join(stored(copies.drop("n"), "copies"), ["digest", "bytes"], "left")
    revisit = F.col("newest").isNotNull() & ~F.col("key").eqNullSafe(F.col("newest"))

    def urn(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(head, F.when(revisit, "").otherwise(F.col("body")))
    clean = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("key")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("newest"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    joined.select(F.concat(lines, F.lit("\r\n\r\n"), block, F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").text(path)


_FIELD = {name: re.compile(rb"(?im)^" + name + rb":[ \t]*(.*?)[ \t]*\r?$") for name in (b"content-length", b"warc-type", b"warc-record-id", b"warc-refers-to")}


def _head(piece: bytes) -> tuple[int, int, dict] | None:
    """Length of a record's head after its first line, length of its block, and its fields; None if this is no record."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {name: m[1] for name, p in _FIELD.items() if (m := p.search(piece, 0, end))}
    length = fields.get(b"content-length", b"")
    return (end + 4, int(length), fields) if length.isdigit() and b"warc-type" in fields else None


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _pieces(batches):
    """The pieces between magic words with file, split and place in the split's text."""
    split, at = None, 0
    for batch in batches:
        for piece, file, begin in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), batch.column("split").to_pylist(), strict=True):
            if (file, begin) != split:
                split, at = (file, begin), 0
            yield file, begin, at, piece
            at += len(piece) + len(MAGIC)


def _table(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names=names)


def _candidates(batches):
    names = ["file", "split", "at", "bytes", "length", "kind", "record", "refers", "payload_bytes", "digest"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    rows = []
    for file, begin, at, piece in _pieces(batches):
        length = kind = record = refers = size = digest = None
        if (begin or at) and (head := _head(piece)):
            skip, n, fields = head
            length = len(MAGIC) + skip + n + 4
            kind, record, refers = (fields.get(f, b"").decode("utf-8", "replace") or None for f in (b"warc-type", b"warc-record-id", b"warc-refers-to"))
            if len(piece) == skip + n + 4:
                payload = _payload(piece[skip : skip + n])
                size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        rows.append((file, begin, at, len(piece) + len(MAGIC), length, kind, record, refers, size, digest))
        if len(rows) == 2000:
            yield _table(rows, names, types)
            rows = []
    yield _table(rows, names, types)


def _bodies(batches):
    names, types = ["file", "split", "at", "body"], [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    for row in _pieces(batches):
        yield _table([row], names, types)


def _whole(batches):
    for batch in batches:
        rows = []
        for file, place, parts in zip(batch.column("file").to_pylist(), batch.column("place").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            record = MAGIC.join(p["body"] for p in parts)
            skip, n, _ = _head(record)
            payload = _payload(record[skip : skip + n])
            rows.append((file, place, len(payload), hashlib.sha1(payload).hexdigest()))
        yield _table(rows, ["file", "place", "payload_bytes", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string()])


def reachable(candidates: DataFrame) -> DataFrame:
    """The rows of ``(file, place, next)`` that a chain of successors from place 0 of their file reaches.

    Pointer jumping: in round k the rows known to be reached send their pointers over 2^k records, then pointers double, so the
    rounds are the logarithm of the records of a file. All joins are on single places.
    """
    jump = stored(candidates.select("file", "place", "next"), "jump")
    known = new = stored(jump.where("place = 0").select("file", "place"), "reached")
    while not new.isEmpty():
        ends = jump.select("file", F.col("place").alias("from"), F.col("next").alias("place"))
        hit = known.withColumnRenamed("place", "from").join(ends, ["file", "from"]).select("file", "place")
        new = stored(hit.join(candidates.select("file", "place"), ["file", "place"], "left_semi"), "reached")
        known = known.unionByName(new)
        jump = stored(jump.select("file", "place", F.col("next").alias("mid")).join(jump.select("file", F.col("place").alias("mid"), "next"), ["file", "mid"]).select("file", "place", "next"), "jump")
    return candidates.join(known, ["file", "place"], "left_semi")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, place, kind, record, refers, payload_bytes, digest)`` per record of the archives below ``path``.

    Tasks read ranges of the files, cut at each magic word wherever it stands. Every piece that begins with a record head is a
    candidate with the place of its successor; candidates inside payloads are none of a file's records, for no chain of
    successors from the file's start reaches them. Places in a file come from the splits' lengths summed up. The payload of a
    record that holds magic words itself is put together from its pieces in a second read. ``digest`` is the SHA-1 of the payload
    read; for revisits that of the record they refer to, likewise ``payload_bytes`` (null if there is no such record). What
    stands after a damaged record is left out; empty files have no records.
    """
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    found = stored(raw.mapInArrow(_candidates, "file string, split long, at long, bytes long, length long, kind string, record string, refers string, payload_bytes long, digest string"), "pieces")
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.groupBy("file", "split").agg(F.sum("bytes").alias("sum")).select("file", "split", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"))
    placed = stored(found.join(bases, ["file", "split"]).withColumn("place", F.col("base") + F.col("at") - len(MAGIC)).withColumn("next", F.col("place") + F.col("length")), "placed")
    records = stored(reachable(placed.where("length is not null")), "records")
    result = records.select("file", "place", "kind", "record", "refers", "payload_bytes", "digest")
    if not records.where("digest is null").isEmpty():
        flags = placed.join(records.select("file", "place", F.lit(True).alias("real"), F.col("digest").isNull().alias("open")), ["file", "place"], "left")
        upto = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        owner = F.last(F.when(F.col("real"), F.struct(F.col("place").alias("owner"), "next", "open")), True).over(upto)
        parts = stored(flags.withColumn("owner", owner).where("owner.open and place < owner.next").select("file", "split", "at", "place", "owner.owner"), "parts")
        bodies = raw.mapInArrow(_bodies, "file string, split long, at long, body binary").join(parts, ["file", "split", "at"])
        whole = bodies.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("place", "body"))).alias("parts")).withColumnRenamed("owner", "place")
        mended = stored(whole.mapInArrow(_whole, "file string, place long, payload_bytes long, digest string"), "mended")
        late = mended.withColumnsRenamed({"payload_bytes": "late_bytes", "digest": "late_digest"})
        result = result.join(late, ["file", "place"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "late_bytes")).withColumn("digest", F.coalesce("digest", "late_digest")).drop("late_bytes", "late_digest")
    result = stored(result, "read")
    full = result.where("kind <> 'revisit' and record is not null").groupBy("record").agg(F.max("payload_bytes").alias("full_bytes"), F.max("digest").alias("full_digest"))
    own = result.where("kind <> 'revisit'")
    others = result.where("kind = 'revisit'").join(stored(full, "full").withColumnRenamed("record", "refers"), "refers", "left")
    return own.unionByName(others.withColumn("payload_bytes", F.col("full_bytes")).withColumn("digest", F.col("full_digest")).select(own.columns))
