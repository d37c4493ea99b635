"""Keyed state of streams: what a micro-batch costs follows its own rows, and replays change nothing."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..session import materialize

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def keep_state(spark: SparkSession) -> None:
    """Processors with timers and collections need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


# --- insight state --------------------------------------------------------------------------------

#: What stands in a pass: the fields of its last accepted decision.
STANDING_FIELDS = ["event_id", "ts", "batch_id", "status", "answer_id", "answer_ids", "mode", "confidence", "evidence", "vault_version"]
#: Per pass what stands in it and its first accepted decision.
PASS_KEY = ["chat_id", "insight_id", "pass_id"]


def insight_changes(judged: DataFrame) -> DataFrame:
    """Changed passes from a stream of judged decisions, in update mode: per (chat, insight, pass) the last accepted decision and the
    first, whatever the order of arrival.

    A maximum and a minimum, so an ordinary streaming aggregate: Spark keeps one row of state for a pass, not its events, and an event
    that comes twice or late gives the same row as a batch over all events.
    """
    keep_state(judged.sparkSession)
    missing = {c: F.lit(None).cast(t) for c, t in (("evidence", "array<string>"), ("vault_version", "string")) if c not in judged.columns}
    accepted = judged.filter(F.col("status").isin("take", "question_only")).withColumns(missing).withColumn("ts", F.col("ts").cast("timestamp"))
    return accepted.groupBy(*PASS_KEY).agg(F.max(F.struct(*STANDING_FIELDS)).alias("stands"), F.min(F.struct("event_id", "ts")).alias("first"))


def insight_rows(passes: DataFrame) -> DataFrame:
    """The insight state of the newest rows of all passes: that of the first pass that took the insight, or of the last pass where none did."""
    taking = F.when(F.col("stands.status") == "take", F.col("pass_id"))
    folded = passes.groupBy("chat_id", "insight_id").agg(
        F.coalesce(F.min_by("stands", taking), F.max_by("stands", "pass_id")).alias("w"), F.min(F.struct("pass_id", "first")).alias("f")
    )
    taken = F.col("w.status") == "take"
    return folded.select(
        "chat_id", "insight_id", "w.batch_id", F.when(taken, True).alias("taken"), "w.answer_id", "w.answer_ids",
        F.when(~taken, "question_only").alias("pending_reason"), F.lit("auto-inference").alias("source"), "w.mode", "w.confidence",
        "w.evidence", "w.vault_version", F.col("f.first.ts").alias("created_at"), F.col("w.ts").alias("updated_at"),
    )


# --- sessions -------------------------------------------------------------------------------------

SESSION_ROW = "request_id long, started_at timestamp, expires_at timestamp, events long, last_label string, closed boolean"


def _millis(ts: datetime) -> int:
    return (ts.replace(tzinfo=timezone.utc) - _EPOCH) // timedelta(milliseconds=1) if ts.tzinfo is None else (ts - _EPOCH) // timedelta(milliseconds=1)


class SessionKeeper(StatefulProcessor):
    """Sessions of a request in event order: events wait until the watermark has passed them, so their order is final. A timer stands for
    the first that waits.

    A closing event ends its session at once; otherwise a timer does after the gap.
    """

    def __init__(self, gap: timedelta, closing: list[str]):
        self.gap, self.closing = gap, closing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, event_id long, type string, label string")
        self.open = handle.getValueState("open", "started timestamp, last timestamp, events long, label string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["ts"], r["event_id"], r["type"], r["label"]) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(_millis(min(n[0] for n in new)) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        events = sorted(self.waiting.get(), key=lambda e: (e[0], e[1])) if self.waiting.exists() else []
        ready = [e for e in events if _millis(e[0]) < until]
        if later := events[len(ready) :]:
            self.handle.registerTimer(_millis(later[0][0]) + 1)
        if ready and later:
            self.waiting.put(later)
        elif ready:
            self.waiting.clear()
        session = tuple(self.open.get()) if self.open.exists() else None
        for ts, _, kind, label in ready:
            if session and ts > session[1] + self.gap:
                yield self._row(key, session, False)
                session = None
            session = (session[0], ts, session[2] + 1, label) if session else (ts, ts, 1, label)
            if kind in self.closing:
                yield self._row(key, session, True)
                session = None
        if session and _millis(session[1] + self.gap) < until:
            yield self._row(key, session, False)
            session = None
        if session:
            self.open.update(session)
            self.handle.registerTimer(_millis(session[1] + self.gap) + 1)
        elif self.open.exists():
            self.open.clear()

    def _row(self, key, session, closed: bool) -> Row:
        started, last, events, label = session
        return Row(request_id=key[0], started_at=started, expires_at=last + self.gap, events=events, last_label=label, closed=closed)

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, gap: timedelta, closing: list[str]) -> DataFrame:
    """Sessions of a stream with a watermark on ``ts``: request_id, ts, event_id, type, label. A session appears once the watermark has
    passed its closing event, or its last event by the gap."""
    keep_state(events.sparkSession)
    keyed = events.select("request_id", "ts", "event_id", "type", "label").groupBy("request_id")
    return keyed.transformWithState(SessionKeeper(gap, closing), SESSION_ROW, "Append", "EventTime")


# --- change log -----------------------------------------------------------------------------------


class ChangeLog:
    """Newest row per key, as changes per micro-batch and a snapshot of what came before them.

    A micro-batch overwrites its own folder, so a retry changes nothing. After ``every`` folders the newest rows go into a new
    snapshot, which counts once it is complete; folders that it covers are ignored and removed with the next snapshot.
    """

    def __init__(self, path: str, keys: list[str], every: int = 10):
        self.path, self.keys, self.every = path, keys, every

    def _listed(self, spark: SparkSession, part: str, complete: bool) -> list[int]:
        hadoop = spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(os.path.join(self.path, part))
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        paths = [f.getPath() for f in fs.listStatus(at)]
        return sorted(int(p.getName().split("=")[1]) for p in paths if not complete or fs.exists(hadoop.Path(p, "_SUCCESS")))

    def _at(self, part: str, number: int) -> str:
        return os.path.join(self.path, part, f"number={number}")

    def write(self, changed: DataFrame, epoch: int) -> None:
        """The sink of a stream of changes."""
        spark = changed.sparkSession
        changed.write.mode("overwrite").parquet(self._at("changes", epoch))
        snapshots = self._listed(spark, "snapshots", True)
        done = snapshots[-1] if snapshots else -1
        if len([n for n in self._listed(spark, "changes", True) if n > done]) >= self.every:
            self.read(spark).write.mode("overwrite").parquet(self._at("snapshots", epoch))
            self._remove(spark, [("changes", n) for n in self._listed(spark, "changes", False) if n <= done] + [("snapshots", n) for n in snapshots[:-1]])

    def _remove(self, spark: SparkSession, old: list[tuple[str, int]]) -> None:
        for part, number in old:
            at = spark._jvm.org.apache.hadoop.fs.Path(self._at(part, number))
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row of each key: of a few folders of changes, then of the snapshot."""
        snapshots = self._listed(spark, "snapshots", True)
        done = snapshots[-1] if snapshots else -1
        parts = [("snapshots", done)] if snapshots else []
        parts += [("changes", n) for n in self._listed(spark, "changes", True) if n > done]
        if len(parts) == 1:
            # A micro-batch gives one row per key.
            return spark.read.parquet(self._at(*parts[0])).dropna(subset=self.keys)
        rows = None
        for part, number in parts:
            one = spark.read.parquet(self._at(part, number)).withColumn("_number", F.lit(number).cast("long"))
            rows = one if rows is None else rows.unionByName(one)
        newest = rows.groupBy(*self.keys).agg(F.max("_number").alias("_number"))
        return rows.join(newest, [*self.keys, "_number"], "left_semi").drop("_number")


# --- replays --------------------------------------------------------------------------------------


class KeyLog:
    """Every key ever seen, so that an event replayed after any delay is dropped.

    Keys are kept in files by bucket, and each bucket of a file has a Bloom filter. A micro-batch tests its keys against the filters
    and reads only the buckets of files that may hold one, which for new keys are nearly none. The stream itself holds no state.
    Where ``FAN`` files of one level have gathered they become one of the next, so a bucket has few filters; files carry the range of
    micro-batches that they cover, and one that is covered by a complete file of a higher level counts no more.
    """

    BITS, HASHES, FAN = 16, 6, 8

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _at(self, file: tuple[int, int, int], *part: str) -> str:
        return os.path.join(self.path, "level{}-from{}-to{}".format(*file), *part)

    def files(self) -> list[tuple[int, int, int]]:
        """Complete files (level, first and last micro-batch) that no higher one covers."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        whole = [f.getPath() for f in fs.listStatus(at) if fs.exists(hadoop.Path(f.getPath(), "filters/_SUCCESS"))]
        found = [tuple(map(int, re.fullmatch(r"level(\d+)-from(\d+)-to(\d+)", p.getName()).groups())) for p in whole]
        return sorted(f for f in found if not any(o[0] > f[0] and o[1] <= f[1] and f[2] <= o[2] for o in found))

    def _write(self, file: tuple[int, int, int], keys: DataFrame) -> DataFrame:
        """Keys ``(k, a, b, bucket)`` of a file, then their filters."""
        bits, hashes = self.BITS, self.HASHES

        def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
            size = max(64, len(pdf) * bits)
            bitmap = np.zeros(size, bool)
            for i in range(hashes):
                bitmap[_spots(pdf["a"].to_numpy(), pdf["b"].to_numpy(), i, size)] = True
            return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "size": [size], "bitmap": [np.packbits(bitmap).tobytes()]})

        keys.write.mode("overwrite").partitionBy("bucket").parquet(self._at(file, "keys"))
        stored = self.spark.read.schema(_KEYS).parquet(self._at(file, "keys"))
        stored.groupBy("bucket").applyInPandas(filtered, _FILTER).write.mode("overwrite").parquet(self._at(file, "filters"))
        return stored

    def merge(self, before: int) -> None:
        """Merge files of micro-batches before the given one: a later one may still be run again."""
        while True:
            levels: dict[int, list] = {}
            for f in self.files():
                if f[2] < before:
                    levels.setdefault(f[0], []).append(f)
            full = next((fs[: self.FAN] for _, fs in sorted(levels.items()) if len(fs) >= self.FAN), None)
            if full is None:
                return
            keys = self.spark.read.schema(_KEYS).parquet(self._at(full[0], "keys"))
            for f in full[1:]:
                keys = keys.unionByName(self.spark.read.schema(_KEYS).parquet(self._at(f, "keys")))
            self._write((full[0][0] + 1, min(f[1] for f in full), max(f[2] for f in full)), keys)
            for f in full:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(f))
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def fresh(self, batch: DataFrame, epoch: int) -> DataFrame:
        """The rows of a micro-batch whose key no earlier one had, one per key; their keys are logged under the batch's number.

        A batch that is run again leaves its own file out of the test and overwrites it. Rows with a null key are one key.
        """
        self.merge(epoch)
        text = F.coalesce(F.concat(F.lit("k"), F.col(self.key).cast("string")), F.lit("null"))
        once = batch.dropDuplicates([self.key])
        bucket = F.pmod(F.xxhash64(text), F.lit(self.buckets)).cast("int")
        hashed = once.select(text.alias("k"), F.xxhash64(text, F.lit(0)).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"), bucket.alias("bucket"))
        known = self._seen(hashed, [f for f in self.files() if f[2] < epoch])
        new = hashed if known is None else hashed.join(known, "k", "left_anti")
        stored = self._write((0, epoch, epoch), new)
        return once.withColumn("_k", text).join(stored.select(F.col("k").alias("_k")), "_k", "left_semi").drop("_k")

    def _seen(self, hashed: DataFrame, files: list[tuple[int, int, int]]) -> DataFrame | None:
        """Keys of the batch that one of the files holds."""
        if not files:
            return None
        filters = None
        for number, f in enumerate(files):
            own = self.spark.read.schema(_FILTER).parquet(self._at(f, "filters")).withColumn("file", F.lit(number))
            filters = own if filters is None else filters.unionByName(own)
        hashes = self.HASHES

        def maybe(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"k": [], "bucket": [], "file": []})]
            for size, bitmap, file in zip(held["size"], held["bitmap"], held["file"], strict=True):
                bits = np.frombuffer(bitmap, np.uint8)
                hit = np.ones(len(keys), bool)
                for i in range(hashes):
                    spots = _spots(keys["a"].to_numpy(), keys["b"].to_numpy(), i, int(size))
                    hit &= ((bits[spots >> 3] >> (7 - (spots & 7))) & 1).astype(bool)
                out.append(keys.loc[hit, ["k", "bucket"]].assign(file=file))
            return pd.concat(out)

        near = materialize(hashed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(maybe, "k string, bucket int, file int"), "maybe-seen")
        places = [(files[r["file"]], r["bucket"]) for r in near.select("file", "bucket").distinct().collect()]
        if not places:
            return None
        held = self.spark.read.schema("k string").parquet(*[self._at(f, "keys", f"bucket={b}") for f, b in places])
        return near.join(held, "k", "left_semi").select("k").distinct()


_KEYS = "k string, a long, b long, bucket int"
_FILTER = "bucket int, size long, bitmap binary"


def _spots(a: np.ndarray, b: np.ndarray, i: int, size: int) -> np.ndarray:
    """Place of the ``i``-th bit of keys with the two hashes ``a`` and ``b``."""
    with np.errstate(over="ignore"):
        mixed = a.astype(np.uint64) + np.uint64(i) * (b.astype(np.uint64) | np.uint64(1))
    return (mixed % np.uint64(size)).astype(np.int64)


def dedupe_forever(events: DataFrame, path: str, key: str, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Give the first event of each key to ``sink(rows, epoch)``, however late its replays come. The sink overwrites by epoch."""
    log = KeyLog(events.sparkSession, os.path.join(path, "keys"), key)
    writer = events.writeStream.option("checkpointLocation", os.path.join(path, "checkpoint")).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, epoch: sink(log.fresh(batch, epoch), epoch))
