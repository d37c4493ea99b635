"""Conversations: listings, the last message worth answering, the gate, the assembled reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.modeljson import extract_json_object, field
from ..functions.text import chat_title, strip

UNTITLED = "Untitled chat"


def chats_of(messages: DataFrame) -> DataFrame:
    """One row per chat: owner, title from the first prompt, first and last activity. Combined map-side."""
    prompt = F.when(F.col("role") == "user", F.struct("created_at", "turn", chat_title(F.col("content")).alias("title")))
    return messages.groupBy("chat_id", "user_id").agg(
        F.min(prompt).title.alias("title"), F.min("created_at").alias("created_at"), F.max("created_at").alias("last_message_at")
    )


def list_chats(chats: DataFrame, hide_archived: bool = False) -> DataFrame:
    """Chats per user, latest activity first. A range-partitioned sort, so no user gathers in one task."""
    if hide_archived:
        chats = chats.filter(~F.coalesce("archived", F.lit(False)))
    titled = chats.withColumn("title", F.coalesce("title", F.lit(UNTITLED)))
    return titled.select("user_id", "chat_id", "title", "last_message_at").orderBy("user_id", F.desc("last_message_at"), "chat_id")


def list_messages(messages: DataFrame) -> DataFrame:
    """Messages in order with defaults; optional fields only where they say something."""
    kind = F.col("type") if "type" in messages.columns else F.lit(None).cast("string")
    return messages.select(
        "user_id",
        "chat_id",
        "turn",
        "role",
        F.coalesce(kind, F.lit("text")).alias("type"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.col("survey_type"),
        F.nullif(F.col("enc_question"), F.lit("")).alias("enc_question"),
        "created_at",
    ).orderBy("chat_id", "created_at", "turn")


def owner_check(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Messages whose chat belongs to their user."""
    return messages.join(chats.select("chat_id", "user_id"), ["chat_id", "user_id"], "left_semi")


def _actionable() -> Column:
    asks = F.coalesce(F.col("enc_question") != "", F.lit(False)) | F.col("survey_type").isNotNull()
    return (F.col("role") == "assistant") & asks


def last_actionable_message(messages: DataFrame) -> DataFrame:
    """Newest assistant message of each chat that asks something."""
    found = messages.filter(_actionable())
    newest = found.groupBy("chat_id", "user_id").agg(F.max(F.struct("created_at", "turn", "enc_question", "survey_type")).alias("m"))
    return newest.select("chat_id", "user_id", "m.turn", "m.created_at", "m.enc_question", "m.survey_type")


def actionable_before_turns(messages: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """For each user turn the last actionable message before it in the chat (null where there is none).

    The as-of step runs within (chat, time bucket) and a carry of one row per bucket links the buckets, so a
    chat with very many messages is spread over tasks instead of being sorted in one.
    """
    marked = messages.withColumns(
        {
            "_bucket": F.window(F.col("created_at").cast("timestamp"), bucket).start,
            "_ask": F.when(_actionable(), F.struct("turn", "enc_question", "survey_type")),
        }
    )
    within = W.partitionBy("chat_id", "_bucket").orderBy("created_at", "turn").rowsBetween(W.unboundedPreceding, -1)
    local = marked.withColumn("_local", F.last("_ask", ignorenulls=True).over(within)).filter(F.col("role") == "user")
    ends = marked.groupBy("chat_id", "_bucket").agg(F.max(F.when(F.col("_ask").isNotNull(), F.struct("created_at", "turn", "_ask")))._ask.alias("_end"))
    across = W.partitionBy("chat_id").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(across)).select("chat_id", "_bucket", "_carry")
    joined = local.join(carry, ["chat_id", "_bucket"]).withColumn("_last", F.coalesce("_local", "_carry"))
    return joined.select(
        "chat_id", "user_id", "turn", "content", "created_at",
        F.col("_last.turn").alias("asked_turn"), F.col("_last.enc_question").alias("prev_enc"), F.col("_last.survey_type").alias("prev_survey_type"),
    )


# Sent when a message is out of scope and the model gives no text; callers pass their own sentence.
OUT_OF_SCOPE = "This request is outside the scope of this assistant."


def gate_decision(reply: Column, fallback: str = OUT_OF_SCOPE) -> Column:
    """Struct (proceed, message): whether to go on, else one sentence without a question mark."""
    data = extract_json_object(reply)
    said = F.to_json(field(data, "$.proceed", "variant"))
    proceed = F.coalesce(~said.isin("false", "null", "0", "0.0", '""', "[]", "{}"), F.lit(False))
    text = strip(F.coalesce(field(data, "$.message", "string"), F.lit("")))
    text = F.when(text == "", F.lit(fallback)).otherwise(text)
    message = F.replace(strip(F.replace(text, F.lit("\n"), F.lit(" "))), F.lit("?"), F.lit("."))
    return F.struct(proceed.alias("proceed"), F.when(~proceed, message).alias("message"))


# Fixed value: closing line when nothing is left to ask.
ALL_GATHERED = "All the insights have been gathered. No further questions at this time. Now you can proceed to planning if you wish to!"


def assemble_reply(turns: DataFrame) -> DataFrame:
    """The assistant message of each turn.

    ``turns``: intake_action, surveys_prepared, stage, question, answer_used, answer_md and, where answers have them, sources. An
    intake survey wins over an insight survey. An answer that is not used leaves no sources either.
    """
    intake = F.when(F.col("intake_action") == "show_ec_survey", "ec_survey").when(F.col("intake_action") == "show_skills_survey", "skills_survey")
    insight = F.when(F.coalesce("surveys_prepared", F.lit(0)) > 0, "insight_survey")
    enc = F.when(F.col("stage") == "none", ALL_GATHERED).otherwise(F.coalesce("question", F.lit("")))
    used = F.coalesce("answer_used", F.lit(False)) & (F.coalesce("answer_md", F.lit("")) != "")
    given = {}
    if "sources" in turns.columns:
        given["sources"] = F.coalesce(F.when(used, F.col("sources")), F.array().cast(turns.schema["sources"].dataType))
    return turns.withColumns(
        {
            **given,
            "survey_type": F.coalesce(intake, insight),
            "enc_question": enc,
            "content": F.when(used, F.col("answer_md")).otherwise(""),
        }
    ).withColumn("type", F.when(F.col("survey_type").isNull(), "text").otherwise("survey"))


def last_activity(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.max("created_at").alias("last_message_at"))
