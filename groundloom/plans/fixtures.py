"""Derived inputs over the given tables, as Spark SQL and as DuckDB SQL.

All of them cover whole tables: no row or character is left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.insights import of_version
from ..session import spread

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations""".split()

_MD_CASE = """CASE {mod} WHEN 0 THEN '# '||l WHEN 1 THEN '## '||l WHEN 2 THEN '### '||l WHEN 3 THEN '- '||l WHEN 4 THEN '- '||l WHEN 5 THEN '1. '||l WHEN 6 THEN '' WHEN 7 THEN '```' WHEN 8 THEN '| a | b |' WHEN 9 THEN '|---|---|' ELSE l END"""

_ANSWERS = [("A", "Reading", "the"), ("B", "Videos", "and"), ("C", "Hands-on practice", "que"), ("D", "Other", "zzz")]

# One insight per supplier, one batch per nation: the vault grows with the data.
_V_VAULT = """SELECT concat('b', s_nationkey) AS batch_id, n_name AS batch_name, s_nationkey % 5 <> 4 AS batch_active, CASE s_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS language, CAST(s_nationkey AS BIGINT) AS batch_pos, concat('i', s_suppkey) AS insight_id, s_suppkey AS pos, concat('How do you work with ', s_name, '?') AS question, s_suppkey % 2 = 1 AS is_multi, s_suppkey % 7 <> 0 AS insight_active, a.answer_id, a.label, a.alias FROM supplier JOIN nation ON n_nationkey = s_nationkey {answers}"""

# Two versions in one table: the second has the same ids, other texts, and the other half of its batches and insights open.
_V_VAULTS = """SELECT 'v1' AS vault_version, batch_id, batch_name, batch_active, language, batch_pos, insight_id, pos, question, is_multi, insight_active, answer_id, label, alias FROM ({one}) UNION ALL SELECT 'v2', batch_id, concat('New ', batch_name), NOT batch_active, language, batch_pos + 1, insight_id, pos, concat('Now: ', question), NOT is_multi, NOT insight_active, answer_id, concat(label, ' 2'), alias FROM ({one})"""

_V_DEC = """SELECT e.event_id, e.user_id AS chat_id, e.ts, concat('i', s.s_suppkey) AS insight_id, concat('b', CASE WHEN e.event_id % 17 = 0 THEN 99 ELSE s.s_nationkey END) AS batch_id, CASE e.event_type WHEN 'purchase' THEN 'QUESTION_AND_ANSWER' WHEN 'click' THEN 'ANSWER_ONLY' WHEN 'signup' THEN 'ANSWER_ONLY' WHEN 'view' THEN 'QUESTION_ONLY' ELSE 'NO_MATCH' END AS match_type, CASE e.event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'b|D' WHEN 2 THEN 'A, C' WHEN 3 THEN 'null' WHEN 4 THEN 'a' ELSE 'Z' END AS answer_raw, CAST(e.event_id % 101 AS DOUBLE) / 100 AS confidence, CAST(floor(e.event_id / 3) AS BIGINT) AS pass_id, {evidence} AS evidence, CASE WHEN e.event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS vault_version FROM (SELECT *, CAST({k} AS INT) AS k FROM events) e JOIN supplier s ON s.s_suppkey = (e.k * 37 + e.user_id) % (SELECT count(*) FROM supplier)"""

_V_SEG = """SELECT 'v1' AS vault_version, p_brand AS ec_id, concat('Role ', p_brand) AS ec_name, concat('sk', p_partkey) AS skill_id, p_name AS skill_name, p_type AS skill_alias, p_partkey AS pos FROM part"""

_V_UIA = """SELECT o_orderkey AS event_id, o_custkey AS chat_id, o_orderdate AS ts, CASE WHEN o_orderkey % 4 = 0 THEN 'set_ec' WHEN o_orderkey % 4 = 1 THEN 'set_skills' WHEN o_orderkey % 4 = 2 THEN 'system_decide' ELSE 'message' END AS kind, p_brand AS ec_id, concat('sk', p_partkey) AS skill_id, CASE WHEN o_orderkey % 11 = 0 THEN 'v0' ELSE 'v1' END AS vault_version FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)"""

_V_MSG = """SELECT conv_id AS chat_id, CAST(floor(conv_id / 3) AS BIGINT) AS user_id, turn, role, text AS content, {at} AS created_at, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN text ELSE '' END AS enc_question, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'insight_survey' END AS survey_type FROM conversations"""

_V_SUB = """SELECT event_id AS submission_id, user_id AS chat_id, ts, concat('i', (k * 37 + user_id) % (SELECT count(*) FROM supplier)) AS insight_id, CASE WHEN event_id % 3 = 0 THEN 'A' WHEN event_id % 3 = 1 THEN 'B,D' ELSE 'Q' END AS answer_csv FROM (SELECT *, CAST({k} AS INT) AS k FROM events)"""

_V_JSON = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('{"selected": ["', user_id, '", "', event_id, '"], "sufficiency": 1.4}') WHEN 1 THEN concat('Sure: ', props, ' done') WHEN 2 THEN '{"selected": [' ELSE '' END AS raw FROM events"""

_PHRASE = "CASE (conv_id + turn) % 7 WHEN 0 THEN 'I am a Data Scientist' WHEN 1 THEN 'Help me choose skills like red widget or blue bolt' WHEN 2 THEN 'Reading and VIDEOS work best' WHEN 3 THEN concat('I', chr(39), 'm a Nurse') WHEN 4 THEN 'Café   résumé!' WHEN 5 THEN 'Role Brand#4' END"

# Every prompt with its whole text, most with a phrase behind it, and the phrases once more as prompts of their own.
_V_ASK = f"""SELECT conv_id AS chat_id, turn, concat_ws(' ', text, {_PHRASE}) AS text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 100000 + turn, {_PHRASE} FROM conversations WHERE role = 'user' AND (conv_id + turn) % 7 <> 6"""

_V_TEXT = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(text, chr(10), 'a split-', chr(10), 'word in Batch 3 and batch 12') WHEN 1 THEN concat(text, chr(10), 'Café NLP and SHAP beat the API &amp; SQL') WHEN 2 THEN concat('page 1', chr(10), 'page 1', chr(10), 'page 1', chr(10), text, chr(10), 'page 1', chr(10), 'page 1') ELSE text END AS text FROM documents"""

# Second sub-query: the long words of the question.
_V_QUERY = """SELECT item_id AS query_id, 0 AS sub_id, text AS q FROM benchmark UNION ALL SELECT item_id, 1, {keywords} FROM benchmark"""

SPARK_VIEWS = {
    "v_md": r"SELECT doc_id, array_join(transform(split(text, '\n'), (l, i) -> " + _MD_CASE.format(mod="pmod(doc_id + i, 13)") + r"), '\n') AS text FROM documents",
    "v_vaults": _V_VAULTS.format(one=_V_VAULT).format(
        answers="LATERAL VIEW inline(array("
        + ", ".join(f"named_struct('answer_id', '{i}', 'label', '{t}', 'alias', '{x}')" for i, t, x in _ANSWERS)
        + ")) a"
    ),
    "v_dec": _V_DEC.format(k="get_json_object(props, '$.k')", evidence="array(concat('event ', e.event_id), e.event_type)"),
    "v_seg": _V_SEG,
    "v_uia": _V_UIA,
    "v_msg": _V_MSG.format(at="TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id AS INT), CAST(turn AS INT), 0)"),
    "v_sub": _V_SUB.format(k="get_json_object(props, '$.k')"),
    "v_json": _V_JSON,
    "v_ask": _V_ASK,
    "v_text": _V_TEXT,
    "v_query": _V_QUERY.format(keywords="array_join(filter(split(text, ' '), w -> length(w) >= 7), ' ')"),
}

DUCK_VIEWS = {
    "v_md": "SELECT doc_id, array_to_string(list_transform(str_split(text, chr(10)), lambda l, i: " + _MD_CASE.format(mod="(doc_id + i - 1) % 13") + "), chr(10)) AS text FROM documents",
    "v_vault": "SELECT * EXCLUDE (vault_version) FROM (" + _V_VAULTS.format(one=_V_VAULT).format(answers=f"CROSS JOIN (VALUES {', '.join(map(str, _ANSWERS))}) AS a(answer_id, label, alias)") + ") WHERE vault_version = 'v1'",
    "v_dec": _V_DEC.format(k="json_extract_string(props, '$.k')", evidence="[concat('event ', e.event_id), e.event_type]"),
    "v_seg": _V_SEG,
    "v_uia": _V_UIA,
    "v_msg": _V_MSG.format(at="TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id::INT) + to_minutes(turn::INT)"),
    "v_sub": _V_SUB.format(k="json_extract_string(props, '$.k')"),
    "v_json": _V_JSON,
    "v_ask": _V_ASK,
    "v_text": _V_TEXT,
    "v_query": _V_QUERY.format(keywords="array_to_string(list_filter(str_split(text, ' '), lambda w: length(w) >= 7), ' ')"),
}


# Tables whose rows take heavy work each, with their key.
_HEAVY_TABLES = {"documents": "doc_id", "pages": "page_id", "events": "event_id"}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    return spread(df, _HEAVY_TABLES[name]) if name in _HEAVY_TABLES else df


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the given tables and the derived views."""
    words = set(re.findall(r"\w+", text))
    for name in words & set(SPARK_VIEWS):
        sql(spark, sf_dir, SPARK_VIEWS[name]).createOrReplaceTempView(name)
    for name in words & set(TABLES):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, SPARK_VIEWS[name])


def vault(spark: SparkSession, sf_dir: str, version: str = "v1") -> DataFrame:
    """One version of the insight vault."""
    return of_version(view(spark, sf_dir, "v_vaults"), version)


def oracle(views: str, body: str, ctes: str = "") -> str:
    """DuckDB statement: the named views, further common table expressions, then the body."""
    parts = [f"{name} AS MATERIALIZED ({DUCK_VIEWS[name]})" for name in views.split()]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
