"""Streaming queries: each drains the given files through a stream and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import events as K
from .fixtures import SPARK_VIEWS, oracle, table, view
from .fixtures import vault as vault_of
from .insight_queries import APPLIED
from .intake_queries import STATE
from .registry import query


def stream(spark, sf, name):
    return K.file_stream(spark, f"{sf}/{name}*.parquet", table(spark, sf, name).schema)


def drained(spark, df, purpose: str):
    path = shared_dir(spark, purpose)
    K.write_files(df, path).start().awaitTermination()
    return spark.read.parquet(path)


def log_records(raw):
    return raw.select("event_id", "ts", F.col("event_type").alias("type"), F.col("user_id").alias("chat_id"), F.coalesce("props", F.lit("{}")).alias("payload"))


@query("SELECT event_id, ts, event_type AS type, user_id AS chat_id, props AS payload FROM events WHERE event_type IN ('click', 'view', 'signup')")
def uia_event_stream(spark, sf):
    """The event log as a stream, narrowed to given types."""
    records = K.event_stream(log_records(stream(spark, sf, "events")), ["click", "view", "signup"])
    return drained(spark, records, "uia-events").withColumn("ts", K.as_ntz(F.col("ts")))


@query("SELECT user_id AS chat_id, event_id, ts, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5")
def recent_events(spark, sf):
    newest = K.recent_events(log_records(table(spark, sf, "events")), 5)
    return newest.select("chat_id", "event_id", "ts", F.col("rank").cast("bigint").alias("rank"))


# A session ends after five minutes of silence, or with an event that closes its request.
SESSIONS = """g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(event_type) OVER w NOT IN ('error', 'purchase') AND ts - lag(ts) OVER w <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))),
sess AS (SELECT user_id AS request_id, min(ts) AS started_at, max(ts) + INTERVAL 5 MINUTE AS expires_at, count(*) AS events, arg_max(event_type, (ts, event_id)) AS last_label, bool_or(event_type IN ('error', 'purchase')) AS closed FROM g GROUP BY user_id, s)"""


def progress(raw):
    return raw.select("event_id", F.col("user_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), F.col("event_type").alias("label"))


def shown(sessions):
    return sessions.withColumns({c: K.as_ntz(F.col(c)) for c in ("started_at", "expires_at")})


@query(oracle("", "SELECT * FROM sess", SESSIONS))
def progress_sessions(spark, sf):
    """Sessions of all users as a batch."""
    return shown(K.progress_sessions(progress(table(spark, sf, "events")), closing=["error", "purchase"]))


_PASSED = "epoch_ms((SELECT max(ts) FROM events)) - 60000"


@query(oracle("", f"SELECT * FROM sess WHERE epoch_ms(expires_at - CASE WHEN closed THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END) < {_PASSED}", SESSIONS))
def progress_session_stream(spark, sf):
    """The same as a stream: a session appears once the watermark has passed its closing event, or its last event by five minutes."""
    timed = progress(stream(spark, sf, "events")).withWatermark("ts", "1 minute")
    return shown(drained(spark, K.progress_sessions(timed, closing=["error", "purchase"]), "sessions"))


@query("SELECT event_id, ts, event_type AS type, user_id AS chat_id, props AS payload FROM events")
def event_dedupe(spark, sf):
    """Every event arrives twice, the second time in a later run, and is kept once."""
    path, kept = shared_dir(spark, "dedupe"), shared_dir(spark, "deduped")

    def sink(rows, epoch):
        rows.write.mode("overwrite").parquet(f"{kept}/epoch={epoch}")

    for _ in range(2):
        events = log_records(stream(spark, sf, "events"))
        twice = events.union(log_records(stream(spark, sf, "events")))
        K.dedupe_forever(twice, path, "event_id", sink).start().awaitTermination()
    return spark.read.parquet(kept).drop("epoch")


@query(oracle("v_uia", "SELECT chat_id, employment_category_id, skills, let_system_decide, vault_version, recorded_at, updated_at FROM st", STATE))
def uia_state_upsert_stream(spark, sf):
    """Intake state kept by a stream over the orders; equals the batch fold."""
    table(spark, sf, "part").createOrReplaceTempView("part")
    stream(spark, sf, "orders").createOrReplaceTempView("orders")
    events = spark.sql(SPARK_VIEWS["v_uia"]).withColumn("skills", F.array("skill_id"))
    path = shared_dir(spark, "uia-state")
    K.upsert_uia_state(events, path).start().awaitTermination()
    state = K.read_uia_state(spark, path)
    return state.withColumn("skills", F.coalesce(F.array_join("skills_selected", ","), F.lit(""))).drop("skills_selected")


_FOLD = (
    APPLIED
    + """,
wr AS (SELECT chat_id, insight_id, batch_id, status = 'take' AS taken, CASE WHEN status = 'take' THEN coalesce(array_to_string(many, ','), '') ELSE '' END AS answer_ids, CASE WHEN status = 'take' THEN coalesce(one, '') ELSE '' END AS answer_id, confidence, array_to_string(evidence, ',') AS evidence, vault_version, min_by(ts, (pass_id, event_id)) OVER (PARTITION BY chat_id, insight_id) AS created_at, ts AS updated_at FROM ap WHERE status IN ('take', 'question_only') QUALIFY row_number() OVER (PARTITION BY chat_id, insight_id ORDER BY pass_id DESC, event_id DESC) = 1)"""
)


@query(oracle("v_dec v_vault", "SELECT * FROM wr", _FOLD))
def insight_state_upsert_stream(spark, sf):
    """Insight state kept by a stream over the decisions; equals the batch fold."""
    vault = vault_of(spark, sf)
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    stream(spark, sf, "events").createOrReplaceTempView("events")
    decisions = spark.sql(SPARK_VIEWS["v_dec"])
    path = shared_dir(spark, "insight-state")
    K.upsert_insight_state(decisions, vault, path).start().awaitTermination()
    state = K.read_insight_state(spark, path)
    blank = F.lit("")
    return state.select(
        "chat_id", "insight_id", "batch_id", F.coalesce("taken", F.lit(False)).alias("taken"), F.coalesce(F.array_join("answer_ids", ","), blank).alias("answer_ids"), F.coalesce("answer_id", blank).alias("answer_id"), "confidence",
        F.array_join("evidence", ",").alias("evidence"), "vault_version", K.as_ntz(F.col("created_at")).alias("created_at"), K.as_ntz(F.col("updated_at")).alias("updated_at")
    )
