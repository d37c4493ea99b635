"""Event streams: typed source, sessions, replay removal and state upserts."""

from __future__ import annotations

import os
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators import insights as I
from ..operators.intake import fold_uia_state
from .keyed import PASS_KEY, ChangeLog, dedupe_forever, insight_changes, insight_rows, stream_sessions

__all__ = ["dedupe_forever"]

# Events of the intake log, and events that end a request.
UIA_EVENT_TYPES = ["IntentDetectedLLM", "IntentDetectedFallback", "ECSurveyShown", "SkillsSurveyShown"]
CLOSING = ["done", "error"]
SESSION_GAP = timedelta(minutes=5)


def file_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that appear under a path or glob, with a declared schema."""
    return spark.readStream.schema(schema).parquet(path)


def event_stream(raw: DataFrame, types: list[str] | None = None, delay: str = "10 minutes") -> DataFrame:
    """Event-log records with event time; later than ``delay`` is late. Optionally only given types."""
    timed = raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed if types is None else timed.filter(F.col("type").isin(types))


def recent_events(events: DataFrame, n: int, key: str = "chat_id", tie: str = "event_id") -> DataFrame:
    """The newest ``n`` events per key; the limit is applied per partition before the shuffle."""
    w = W.partitionBy(key).orderBy(F.desc("ts"), F.desc(tie))
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def progress_sessions(events: DataFrame, gap: timedelta = SESSION_GAP, closing: list[str] | None = None) -> DataFrame:
    """Sessions of a request: each event renews the time to live; silence ends it, and so does a closing event.

    ``events``: request_id, ts, event_id, type, label; batch or stream (with a watermark). Events are taken by time, those of one time
    by id, and what follows a closing event is a session of its own. A stream gives the sessions that its watermark has passed, the
    same as the batch.
    """
    closing = closing or CLOSING
    if events.isStreaming:
        return stream_sessions(events, gap, closing)
    before = W.partitionBy("request_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    numbered = events.withColumn("_closes", F.coalesce(F.sum(F.col("type").isin(closing).cast("int")).over(before), F.lit(0)))
    grouped = numbered.groupBy("request_id", "_closes", F.session_window("ts", f"{gap.total_seconds():.0f} seconds").alias("session"))
    return grouped.agg(
        F.count("*").alias("events"),
        F.max_by("label", F.struct("ts", "event_id")).alias("last_label"),
        F.max(F.col("type").isin(closing)).alias("closed"),
    ).select("request_id", F.col("session.start").alias("started_at"), F.col("session.end").alias("expires_at"), "events", "last_label", "closed")


def event_dedupe(events: DataFrame, keys: list[str]) -> DataFrame:
    """Drop replays of an event that arrive within the watermark delay."""
    return events.dropDuplicatesWithinWatermark(keys)


def write_files(stream: DataFrame, path: str, mode: str = "append") -> DataStreamWriter:
    """A file sink that processes what is there and stops; checkpoint next to the output."""
    return (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", path + "-checkpoint")
        .trigger(availableNow=True)
    )


# --- state upserts --------------------------------------------------------------------------------


def upsert_uia_state(events: DataFrame, path: str) -> DataStreamWriter:
    """Keep the intake state of every chat from a stream of its events.

    The fold is made of maxima and minima, so it is an ordinary streaming aggregate in update mode: Spark keeps
    one row of state per chat. Changed rows are logged per micro-batch under the batch's own number, which makes
    a retried batch overwrite itself, and compacted now and then.
    """

    return (
        fold_uia_state(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", path + "-checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(ChangeLog(path, ["chat_id"]).write)
    )


def read_uia_state(spark: SparkSession, path: str) -> DataFrame:
    return ChangeLog(path, ["chat_id"]).read(spark)


def insight_log(path: str, every: int = 10) -> ChangeLog:
    return ChangeLog(path, PASS_KEY, every)


def upsert_insight_state(decisions: DataFrame, vault: DataFrame, path: str, every: int = 10) -> DataStreamWriter:
    """Keep the insight state from a stream of decisions.

    Decisions are judged by themselves; what stands in each pass is kept by key, so a micro-batch costs what it mentions and no history
    is read. Changed passes go to a change log that is compacted every so many micro-batches; readers fold the passes.
    """
    changes = insight_changes(I.judge_decisions(decisions, vault))
    return (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", path + "-checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(insight_log(path, every).write)
    )


def read_insight_state(spark: SparkSession, path: str) -> DataFrame:
    return insight_rows(insight_log(path).read(spark))


def as_ntz(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")
