"""Model replies around an answer. The replies are built from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answering as A
from ..operators import retrieval as R
from .fixtures import oracle, sql
from .registry import query
from .retrieval_queries import POOL, corpus, pool
from .text_queries import SP

# Valid, wrapped in prose, malformed, empty, and valid without the wanted field.
_REPLY = "SELECT v.event_id, CASE WHEN v.event_id % 8 = 4 THEN e.props ELSE raw END AS raw FROM v_json v JOIN events e ON e.event_id = v.event_id"
_IDS = {
    "spark": "transform(sequence(0, 11), i -> CAST(event_id + i % 7 AS STRING))",
    "duck": "list_transform(range(0, 12), lambda i: CAST(event_id + i % 7 AS VARCHAR))",
}
_STRINGS = "CAST(json_extract_string(raw, '$.{f}[*]') AS VARCHAR[])"


def replies(spark, sf):
    return sql(spark, sf, f"SELECT *, {_IDS['spark']} AS ids FROM ({_REPLY})")


def duck(body: str) -> str:
    return oracle("v_json", body, f"rep AS (SELECT *, {_IDS['duck']} AS ids FROM ({_REPLY}))")


@query(
    duck(
        f"SELECT event_id, pos - 1 AS pos, a[pos] AS chunk_id FROM (SELECT event_id, CASE WHEN json_valid(raw) THEN {_STRINGS.format(f='selected')} ELSE ids[1:10] END AS a FROM rep), unnest(range(1, len(a) + 1)) t(pos)"
    )
)
def ingest_selection(spark, sf):
    rows = replies(spark, sf).select("event_id", F.posexplode(A.ingest_selection(F.col("raw"), F.col("ids"))).alias("pos", "chunk_id"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    duck(
        "SELECT event_id, array_to_string(ids, ',') AS live, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE ids[1:5] END, ',') AS strict FROM (SELECT *, CASE WHEN json_valid(raw) THEN CAST(json_extract_string(raw, '$.selected[*]') AS VARCHAR[]) END AS k FROM rep)"
    )
)
def ingest_keep(spark, sf):
    reply = F.replace(F.col("raw"), F.lit("selected"), F.lit("keep"))
    return replies(spark, sf).select(
        "event_id",
        F.array_join(A.ingest_keep(reply, F.col("ids")), ",").alias("live"),
        F.array_join(A.ingest_keep(reply, F.col("ids"), cap=5, mode="strict"), ",").alias("strict"),
    )


@query(duck("SELECT event_id, array_to_string(ids[1:7], ',') AS ids FROM rep"))
def dedupe_keep_order(spark, sf):
    return replies(spark, sf).select("event_id", F.array_join(A.dedupe_keep_order(F.col("ids")), ",").alias("ids"))


@query(duck(f"SELECT event_id, array_to_string(coalesce(CASE WHEN json_valid(raw) THEN {_STRINGS.format(f='selected')} END, []), ',') AS missing, CAST(len(coalesce(CASE WHEN json_valid(raw) THEN {_STRINGS.format(f='selected')} END, [])) AS BIGINT) AS n FROM rep"))
def missing_aspects(spark, sf):
    """What a sufficiency reply still misses; nothing where the reply cannot be read."""
    aspects = A.missing_aspects(F.replace(F.col("raw"), F.lit("selected"), F.lit("missing_aspects")))
    return replies(spark, sf).select("event_id", F.array_join(aspects, ",").alias("missing"), F.size(aspects).cast("bigint").alias("n"))


_SUFF = "CASE WHEN json_valid(raw) THEN coalesce(CAST(json_extract_string(raw, '$.sufficiency') AS DOUBLE), 0.5) ELSE 0.4 + least(event_id % 14, 10) * 0.05 END"


@query(duck(f"SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_SUFF})), 6) AS sufficiency, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_SUFF})), 6) < 0.7 AND event_id % 2 = 0 AS allow_general FROM rep"))
def sufficiency(spark, sf):
    """Coverage and the resulting permission to use general knowledge."""
    scored = replies(spark, sf).select("event_id", F.round(A.sufficiency(F.col("raw"), F.col("event_id") % 14), 6).alias("sufficiency"))
    allowed = A.allow_general(F.lit(False), F.col("event_id") % 2 == 0, F.col("sufficiency"))
    return scored.select("event_id", "sufficiency", allowed.alias("allow_general"))


def _evidence(limit: int, n: int, title: str, body: str) -> str:
    return oracle(
        "v_query",
        f"SELECT query_id, to_json(list({{'chunk_id': CAST(chunk_id AS VARCHAR), '{title}': d.source, '{body}': substr(replace(trim(d.text, {SP}), chr(13), ''), 1, {n})}} ORDER BY position)) AS evidence FROM pool JOIN documents d ON d.doc_id = chunk_id WHERE position <= {limit} GROUP BY query_id",
        POOL,
    )


@query(_evidence(16, 280, "title", "summary"))
def sufficiency_evidence(spark, sf):
    return R.sufficiency_evidence(pool(spark, sf), corpus(spark, sf))


@query(_evidence(10, 350, "breadcrumb", "snippet"))
def validation_evidence(spark, sf):
    return R.validation_evidence(pool(spark, sf), corpus(spark, sf))


_PLANS = """SELECT event_id, concat('Q', event_id) AS question, CASE event_id % 5 WHEN 0 THEN concat('{"queries": ["a', user_id, '", "b"], "style": "tutorial", "link_prev": true}') WHEN 1 THEN '{"queries": []}' WHEN 2 THEN concat('x "queries": ["q', event_id, '", "r"] broken') WHEN 3 THEN '' ELSE '{"allow_general_knowledge": true, "tone": "technical", "doc_filters": ["DOC01"], "format": ["table"]}' END AS raw FROM events"""


@query(
    f"""SELECT event_id,
CASE event_id % 5 WHEN 0 THEN 'a' || user_id || '|b' WHEN 1 THEN '' ELSE question END AS live_queries,
CASE event_id % 5 WHEN 0 THEN 'a' || user_id || '|b' WHEN 2 THEN 'q' || event_id || '|r' ELSE question END AS older_queries,
coalesce(json_extract_string(j, '$.style'), 'concise') AS style, coalesce(json_extract_string(j, '$.tone'), 'plain') AS tone,
coalesce(array_to_string(nullif(CAST(json_extract_string(j, '$.format[*]') AS VARCHAR[]), []), '|'), 'sections|bullets') AS format,
coalesce(CAST(json_extract_string(j, '$.link_prev') AS BOOLEAN), false) AS link_prev,
coalesce(CAST(json_extract_string(j, '$.allow_general_knowledge') AS BOOLEAN), false) AS allow_general_knowledge,
coalesce(array_to_string(CAST(json_extract_string(j, '$.doc_filters[*]') AS VARCHAR[]), '|'), '') AS doc_filters,
CASE WHEN j IS NULL THEN 'planner-json-parse-failed; defaulting to unrelated' ELSE '' END AS why,
CASE WHEN j IS NULL THEN 'fallback parse' ELSE '' END AS older_notes
FROM (SELECT p.*, e.user_id, CASE WHEN json_valid(raw) THEN raw END AS j FROM ({_PLANS}) p JOIN events e ON e.event_id = p.event_id)"""
)
def plan_defaults(spark, sf):
    rows = sql(spark, sf, _PLANS).select(
        "event_id",
        A.plan_defaults(F.col("raw"), F.col("question")).alias("live"),
        A.plan_defaults(F.col("raw"), F.col("question"), "older").alias("older"),
    )
    return rows.select(
        "event_id",
        F.array_join("live.queries", "|").alias("live_queries"),
        F.array_join("older.queries", "|").alias("older_queries"),
        "live.style",
        "live.tone",
        F.array_join("live.format", "|").alias("format"),
        "live.link_prev",
        "live.allow_general_knowledge",
        F.array_join("live.doc_filters", "|").alias("doc_filters"),
        "live.why",
        F.col("older.notes").alias("older_notes"),
    )


_VERDICTS = """SELECT event_id, event_type AS draft, CASE event_id % 6 WHEN 0 THEN concat('{"on_topic": false, "contradiction": false, "revision": "r', user_id, '"}') WHEN 1 THEN concat('{"on_topic": true, "contradiction": true, "revision": "c', user_id, '"}') WHEN 2 THEN '{"on_topic": false, "revision": ""}' WHEN 3 THEN concat('{"revision": "u', user_id, '"}') WHEN 4 THEN '{"on_topic": fal' ELSE '' END AS raw FROM events"""


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'r' || user_id WHEN 1 THEN 'c' || user_id ELSE event_type END AS answer FROM events")
def apply_validation(spark, sf):
    return sql(spark, sf, _VERDICTS).select("event_id", A.apply_validation(F.col("raw"), F.col("draft")).alias("answer"))
