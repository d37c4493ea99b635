"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answering as A
from ..operators import chat as M
from .fixtures import oracle, sql, table, view
from .insight_queries import SURVEYS, ChatState, survey_rows
from .question_queries import OPEN, TURN_VIEWS, TURNS, turns
from .registry import query
from .text_queries import SP


def messages(spark, sf):
    return view(spark, sf, "v_msg")


_CHATS = "chats0 AS (SELECT chat_id, user_id, coalesce(arg_min(substr(content, 1, 40), (created_at, turn)) FILTER (role = 'user'), 'Untitled chat') AS title, max(created_at) AS last_message_at FROM v_msg GROUP BY ALL)"


@query(oracle("v_msg", "SELECT user_id, chat_id, title, last_message_at FROM chats0", _CHATS))
def list_chats(spark, sf):
    return M.list_chats(M.chats_of(messages(spark, sf)))


@query(oracle("v_msg", "SELECT user_id, chat_id, turn, role, 'text' AS type, content, coalesce(survey_type, '') AS survey_type, enc_question, created_at FROM v_msg"))
def list_messages(spark, sf):
    blank = {c: F.coalesce(c, F.lit("")) for c in ("survey_type", "enc_question")}
    return M.list_messages(messages(spark, sf)).withColumns(blank)


@query(oracle("v_msg", "SELECT chat_id, user_id, turn FROM v_msg WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = chat_id AND c_nationkey = user_id % 25)"))
def owner_check(spark, sf):
    """A chat belongs to its user where the customer of that number lives in the user's nation."""
    owned = table(spark, sf, "customer").select(F.col("c_custkey").alias("chat_id"), "c_nationkey")
    chats = M.chats_of(messages(spark, sf)).join(owned, "chat_id").filter(F.col("c_nationkey") == F.col("user_id") % 25)
    return M.owner_check(messages(spark, sf), chats).select("chat_id", "user_id", "turn")


_ACT = "act AS (SELECT * FROM v_msg WHERE role = 'assistant' AND (enc_question <> '' OR survey_type IS NOT NULL))"


@query(oracle("v_msg", "SELECT chat_id, user_id, turn, created_at, enc_question, coalesce(survey_type, '') AS survey_type FROM act QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC) = 1", _ACT))
def last_actionable_message(spark, sf):
    return M.last_actionable_message(messages(spark, sf)).withColumn("survey_type", F.coalesce("survey_type", F.lit("")))


_ASOF = f"{_ACT},\nbefore AS (SELECT m.*, a.turn AS asked_turn, a.enc_question AS prev_enc, a.survey_type AS prev_survey FROM (SELECT * FROM v_msg WHERE role = 'user') m ASOF LEFT JOIN act a ON a.chat_id = m.chat_id AND a.created_at < m.created_at)"


@query(oracle("v_msg", "SELECT chat_id, turn, coalesce(asked_turn, -1) AS asked_turn, coalesce(prev_enc, '') AS prev_enc, coalesce(prev_survey, '') AS prev_survey FROM before", _ASOF))
def actionable_before_turns(spark, sf):
    found = M.actionable_before_turns(messages(spark, sf), bucket="2 minutes")
    return found.select(
        "chat_id", "turn", F.coalesce("asked_turn", F.lit(-1)).alias("asked_turn"), F.coalesce("prev_enc", F.lit("")).alias("prev_enc"), F.coalesce("prev_survey_type", F.lit("")).alias("prev_survey")
    )


@query(
    oracle(
        "v_msg",
        f"SELECT chat_id, turn, CASE WHEN coalesce(prev_enc, '') <> '' AND turn % 3 <> 0 THEN content || '{A.CONTEXT_NOTE}' || CASE WHEN length(trim(prev_enc, {SP})) > 500 THEN substr(trim(prev_enc, {SP}), 1, 500) || '...' ELSE trim(prev_enc, {SP}) END ELSE content END AS question FROM before",
        _ASOF,
    )
)
def compose_question(spark, sf):
    found = M.actionable_before_turns(messages(spark, sf))
    return found.select("chat_id", "turn", A.compose_question(F.col("content"), F.col("prev_enc"), F.col("turn") % 3 != 0).alias("question"))


_GATE = """SELECT event_id, user_id, CASE event_id % 6 WHEN 0 THEN '{"proceed": true}' WHEN 1 THEN concat('{"proceed": false, "message": " Ask user ', user_id, '?\\nplease? "}') WHEN 2 THEN 'Well: {"message": ""}' WHEN 3 THEN '{"proceed": 1' WHEN 4 THEN '' ELSE '{"proceed": "yes"}' END AS raw FROM events"""


@query(
    f"SELECT event_id, event_id % 6 IN (0, 5) AS proceed, CASE event_id % 6 WHEN 0 THEN '' WHEN 5 THEN '' WHEN 1 THEN 'Ask user ' || user_id || '. please.' ELSE '{M.OUT_OF_SCOPE}' END AS message FROM events"
)
def gate_decision(spark, sf):
    rows = sql(spark, sf, _GATE.replace("\\n", "\\\\n")).select("event_id", M.gate_decision(F.col("raw")).alias("g"))
    return rows.select("event_id", "g.proceed", F.coalesce("g.message", F.lit("")).alias("message"))


@query(
    oracle(
        TURN_VIEWS,
        f"""SELECT chat_id, turn, coalesce(survey_type, '') AS survey_type, CASE WHEN stage = 'none' THEN '{M.ALL_GATHERED}' ELSE 'ask ' || stage END AS enc_question, CASE WHEN turn % 4 <> 2 THEN 'answer ' || turn ELSE '' END AS content, CASE WHEN survey_type IS NULL THEN 'text' ELSE 'survey' END AS type FROM (
 SELECT tn.*, CASE action WHEN 'show_ec_survey' THEN 'ec_survey' WHEN 'show_skills_survey' THEN 'skills_survey' ELSE CASE WHEN done AND EXISTS (SELECT 1 FROM sv WHERE sv.chat_id = tn.log_chat) THEN 'insight_survey' END END AS survey_type FROM tn)""",
        SURVEYS + ",\n" + TURNS[TURNS.index("lt AS ("):],
    )
)
def assemble_reply(spark, sf):
    """Replies of all user turns; the answer text is a stand-in."""
    chats = ChatState(spark, sf)
    prepared = survey_rows(chats, questions=False).groupBy(F.col("chat_id").alias("log_chat")).agg(F.countDistinct("batch_id").alias("n"))
    rows = turns(spark, sf, chats).join(prepared, "log_chat", "left").withColumns(
        {
            "intake_action": F.col("action"),
            "surveys_prepared": F.when(F.col("skills_done") & F.col("ec_current").isNotNull(), F.col("n")),
            "question": F.concat(F.lit("ask "), "stage"),
            "answer_used": F.col("turn") % 4 != 2,
            "answer_md": F.concat(F.lit("answer "), F.col("turn").cast("string")),
        }
    )
    made = M.assemble_reply(rows)
    return made.select("chat_id", "turn", F.coalesce("survey_type", F.lit("")).alias("survey_type"), "enc_question", "content", "type")


@query(oracle("v_msg", "SELECT chat_id, max(created_at) AS last_message_at FROM v_msg GROUP BY chat_id"))
def last_activity(spark, sf):
    return M.last_activity(messages(spark, sf))
