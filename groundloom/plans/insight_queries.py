"""Insight vault and per-chat insight state queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import insights as I
from .fixtures import oracle, sql, vault, view
from ..session import materialize
from .registry import query

# --- check SQL ------------------------------------------------------------------------------------

INDEX = """ix AS MATERIALIZED (SELECT batch_id, batch_name, batch_pos, language, insight_id, pos, question, is_multi, list(answer_id ORDER BY answer_id) AS ids, list(label ORDER BY answer_id) AS labels, to_json(list({'answerId': answer_id, 'label': label} ORDER BY answer_id)) AS options, list({'k': answer_id, 'v': {'text': label, 'aliases': [alias]}} ORDER BY answer_id) AS entries FROM v_vault WHERE batch_active AND insight_active GROUP BY ALL)"""

_PARSED = "list_filter(list_transform(regexp_split_to_array(trim({raw}), '[|,/\\s]+'), lambda p: upper(p)), lambda p: p <> '' AND p <> 'NULL' AND list_contains(ids, p))"
# First occurrences in order.
_DISTINCT = "list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN list_position(p, p[i]) = i THEN p[i] END), lambda x: x IS NOT NULL)"

DECIDED = f"""{INDEX},
d0 AS (SELECT d.*, x.batch_id AS own, x.is_multi, x.ids, {_PARSED.format(raw='answer_raw')} AS p FROM v_dec d LEFT JOIN ix x ON x.insight_id = d.insight_id),
d1 AS (SELECT *, CASE WHEN is_multi THEN {_DISTINCT} END AS many, CASE WHEN is_multi THEN NULL WHEN lower(answer_raw) = 'null' THEN NULL WHEN regexp_matches(answer_raw, '[|, /]') THEN p[1] WHEN list_contains(ids, answer_raw) THEN answer_raw END AS one FROM d0),
d2 AS (SELECT *, CASE WHEN own IS NULL THEN 'unknown_insight' WHEN own <> batch_id THEN 'batch_mismatch' WHEN match_type NOT IN ('QUESTION_AND_ANSWER', 'ANSWER_ONLY', 'QUESTION_ONLY') THEN 'bad_match_type' WHEN match_type <> 'QUESTION_ONLY' AND confidence >= 0.75 THEN (CASE WHEN len(many) > 0 OR one IS NOT NULL THEN 'take' ELSE 'no_valid_answer' END) WHEN match_type = 'QUESTION_ONLY' AND confidence >= 0.6 THEN 'question_only' ELSE 'below_threshold' END AS judged FROM d1)"""

SUBMITTED = f"""s0 AS (SELECT v.*, concat('b', CASE WHEN submission_id % 17 = 0 THEN 99 ELSE s_nationkey END) AS batch_id, CASE WHEN contains(answer_csv, ',') THEN str_split(answer_csv, ',') END AS many, CASE WHEN NOT contains(answer_csv, ',') THEN answer_csv END AS one FROM v_sub v JOIN supplier ON concat('i', s_suppkey) = v.insight_id),
sub AS MATERIALIZED (SELECT s0.*, CASE WHEN s0.batch_id NOT IN (SELECT batch_id FROM v_vault WHERE batch_active) THEN 'unknown_batch' WHEN x.batch_id IS NULL OR x.batch_id <> s0.batch_id THEN 'insight_not_in_batch' WHEN is_multi AND many IS NULL THEN 'expects_multiple' WHEN is_multi THEN (CASE WHEN len(list_filter(many, lambda a: NOT list_contains(ids, a))) = 0 THEN 'ok' ELSE 'invalid_answer' END) WHEN list_contains(ids, one) THEN 'ok' ELSE 'invalid_answer' END AS status FROM s0 LEFT JOIN ix x ON x.insight_id = s0.insight_id)"""


def applied_sql(with_surveys: bool) -> str:
    more = "UNION ALL SELECT chat_id, insight_id, floor(submission_id / 3) + 0.5 FROM sub WHERE status = 'ok'" if with_surveys else ""
    return (
        (f"{DECIDED},\n{SUBMITTED},\n" if with_surveys else f"{DECIDED},\n")
        + f"""tk AS (SELECT chat_id, insight_id, min(seq) AS taken_from FROM (SELECT chat_id, insight_id, CAST(pass_id AS DOUBLE) AS seq FROM d2 WHERE judged IN ('take', 'question_only') GROUP BY chat_id, insight_id, pass_id HAVING arg_max(judged, event_id) = 'take' {more}) GROUP BY ALL),
ap AS MATERIALIZED (SELECT d2.*, CASE WHEN judged NOT IN ('unknown_insight', 'batch_mismatch') AND coalesce(taken_from, 1e18) < pass_id THEN 'already_taken' ELSE judged END AS status FROM d2 LEFT JOIN tk ON tk.chat_id = d2.chat_id AND tk.insight_id = d2.insight_id)"""
    )


APPLIED = applied_sql(False)
FOLDED = (
    applied_sql(True)
    + """,
wr AS (SELECT chat_id, insight_id, batch_id, CAST(pass_id AS DOUBLE) AS seq, event_id, ts, CASE WHEN status = 'take' THEN true END AS taken, CASE WHEN status = 'take' THEN coalesce(array_to_string(many, ','), '') ELSE '' END AS ids, CASE WHEN status = 'take' THEN coalesce(one, '') ELSE '' END AS one, CASE WHEN status = 'take' THEN '' ELSE 'question_only' END AS pending_reason, 'auto-inference' AS source, CASE WHEN status <> 'take' THEN '' WHEN match_type = 'QUESTION_AND_ANSWER' THEN 'qa' ELSE 'answer_only' END AS mode, confidence, array_to_string(evidence, ',') AS evidence, vault_version FROM ap WHERE status IN ('take', 'question_only')
  UNION ALL SELECT chat_id, insight_id, batch_id, floor(submission_id / 3) + 0.5, submission_id, ts, true, coalesce(array_to_string(many, ','), ''), coalesce(one, ''), '', 'survey', '', 1.0, '', 'v1' FROM sub WHERE status = 'ok'),
fs AS MATERIALIZED (SELECT *, first_value(ts) OVER (PARTITION BY chat_id, insight_id ORDER BY seq, event_id) AS created_at FROM wr QUALIFY row_number() OVER (PARTITION BY chat_id, insight_id ORDER BY seq DESC, event_id DESC) = 1),
touched AS MATERIALIZED (SELECT DISTINCT chat_id, batch_id FROM ap WHERE status IN ('already_taken', 'take', 'question_only')),
fill AS MATERIALIZED (SELECT t.chat_id, x.insight_id, t.batch_id FROM touched t JOIN ix x ON x.batch_id = t.batch_id WHERE NOT EXISTS (SELECT 1 FROM fs WHERE fs.chat_id = t.chat_id AND fs.insight_id = x.insight_id)),
ss AS MATERIALIZED (SELECT chat_id, insight_id, batch_id, taken, ids, one, pending_reason, source, confidence FROM fs UNION ALL SELECT chat_id, insight_id, batch_id, NULL, '', '', 'batch_fill', 'batch-expansion', 1.0 FROM fill),
done AS MATERIALIZED (SELECT s.chat_id, x.batch_id, count(*) FILTER (s.taken) AS taken, any_value(t.total) AS total, count(*) FILTER (s.taken) = any_value(t.total) AS is_complete FROM ss s JOIN ix x ON x.insight_id = s.insight_id JOIN (SELECT batch_id, count(*) AS total FROM ix GROUP BY batch_id) t ON t.batch_id = x.batch_id GROUP BY ALL)"""
)


# --- inputs ---------------------------------------------------------------------------------------


def index(spark, sf):
    """The active insights, stored once per query."""
    return materialize(I.insight_index(vault(spark, sf)), "insight-index")


def applied(spark, sf):
    return I.apply_decisions(view(spark, sf, "v_dec"), vault(spark, sf))


def responses(spark, sf):
    rows = sql(
        spark,
        sf,
        "SELECT v.*, concat('b', CASE WHEN submission_id % 17 = 0 THEN 99 ELSE s_nationkey END) AS batch_id, CASE WHEN contains(answer_csv, ',') THEN split(answer_csv, ',') END AS answer_ids, CASE WHEN NOT contains(answer_csv, ',') THEN answer_csv END AS answer_id FROM v_sub v JOIN supplier ON concat('i', s_suppkey) = v.insight_id",
    )
    return rows


def surveys(spark, sf, ix):
    ok = I.submit_survey(responses(spark, sf), ix).filter("accepted")
    return ok.withColumns({"seq": F.floor(F.col("submission_id") / 3) + 0.5, "vault_version": F.lit("v1")}).withColumnRenamed("submission_id", "event_id")


class ChatState:
    """Decisions and surveys of all chats folded once; the parts that several operators read are stored."""

    def __init__(self, spark, sf):
        self.index = index(spark, sf)
        self.surveys = materialize(surveys(spark, sf, self.index), "surveys")
        judged = materialize(I.judge_decisions(view(spark, sf, "v_dec"), self.index), "judged")
        self.applied = materialize(I.settle_decisions(judged, self.surveys), "applied")
        self.touched = I.touched_batches(self.applied)
        self.folded = I.fold_insight_state(self.applied, self.surveys)

    @cached_property
    def state(self):
        """The folded rows, stored, and the pending ones that batch expansion adds, which only reads that return them open."""
        return I.expanded_state(materialize(self.folded, "insight-state"), materialize(self.touched, "touched"), self.index)


# --- queries --------------------------------------------------------------------------------------


@query(oracle("v_vault", "SELECT DISTINCT batch_id, batch_name, batch_pos FROM v_vault WHERE batch_active"))
def active_batches(spark, sf):
    return I.active_batches(vault(spark, sf))


@query(oracle("v_vault", "SELECT batch_id, insight_id, question, is_multi, array_to_string(ids, ',') AS answer_ids, array_to_string(labels, ',') AS labels FROM ix", INDEX))
def insight_index(spark, sf):
    return I.insight_index(vault(spark, sf)).select(
        "batch_id", "insight_id", "question", "is_multi", F.array_join("answers.answer_id", ",").alias("answer_ids"), F.array_join("answers.label", ",").alias("labels")
    )


@query(
    oracle(
        "v_vault",
        "SELECT 'vault' AS part, -1 AS batch_pos, -1 AS pos, '{\"vaultVersion\":\"v1\"}' AS json UNION ALL SELECT 'batches', batch_pos, -1, CASE WHEN language IS NULL THEN to_json({'batchId': batch_id, 'name': batch_name}) ELSE to_json({'batchId': batch_id, 'name': batch_name, 'language': language}) END FROM (SELECT DISTINCT batch_id, batch_name, batch_pos, language FROM v_vault WHERE batch_active) UNION ALL SELECT 'insights', batch_pos, pos, to_json({'insightId': insight_id, 'batchId': batch_id, 'question': question, 'answers': map_from_entries(entries), 'isMultiSelect': is_multi, 'isActive': true}) FROM ix",
        INDEX,
    )
)
def vault_pack(spark, sf):
    return I.vault_pack(vault(spark, sf), "v1")


@query(
    oracle(
        "v_vault v_sub",
        "SELECT submission_id, CASE WHEN valid THEN b ELSE '' END AS batch_id, valid FROM (SELECT submission_id, x.batch_id AS b, coalesce(x.batch_id IS NOT NULL AND (c IS NULL OR list_contains(ids, c)), false) AS valid FROM (SELECT *, CASE WHEN answer_csv = 'Q' AND submission_id % 2 = 0 THEN NULL ELSE answer_csv END AS c FROM v_sub) v LEFT JOIN ix x ON x.insight_id = v.insight_id)",
        INDEX,
    )
)
def validate_insight_answer(spark, sf):
    answer = F.when(~((F.col("answer_csv") == "Q") & (F.col("submission_id") % 2 == 0)), F.col("answer_csv"))
    claims = view(spark, sf, "v_sub").select("submission_id", "insight_id", answer.alias("answer_id"))
    checked = I.validate_insight_answer(claims, vault(spark, sf))
    return checked.select("submission_id", F.coalesce("batch_id", F.lit("")).alias("batch_id"), "valid")


@query(oracle("v_vault", "SELECT batch_id, batch_pos, insight_id, row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS insight_no FROM ix", INDEX))
def batches_in_order(spark, sf):
    ordered = I.batches_in_order(vault(spark, sf))
    return ordered.select("batch_id", "batch_pos", "insight_id", F.col("insight_no").cast("bigint").alias("insight_no"))


@query(
    oracle(
        "v_vault",
        "SELECT 'v1' AS vault_version, 'ready' AS status FROM v_vault WHERE batch_active HAVING count(*) > 0 UNION ALL SELECT 'v9', 'version not found' FROM v_vault HAVING count(*) > 0",
    )
)
def vault_readiness(spark, sf):
    versions = view(spark, sf, "v_vaults")
    return I.vault_readiness(versions, "v1").union(I.vault_readiness(versions, "v9"))


@query(oracle("v_dec v_vault", f"SELECT event_id, array_to_string({_DISTINCT}, ',') AS answer_ids FROM d0 WHERE own IS NOT NULL", DECIDED))
def parse_answer_ids(spark, sf):
    ids = I.insight_index(vault(spark, sf)).select("insight_id", F.col("answers.answer_id").alias("ids"))
    joined = view(spark, sf, "v_dec").join(ids, "insight_id")
    return joined.select("event_id", F.array_join(I.parse_answer_ids(F.col("answer_raw"), F.col("ids")), ",").alias("answer_ids"))


@query(oracle("v_dec v_vault", "SELECT event_id, status, CASE WHEN status = 'take' THEN coalesce(one, '') ELSE '' END AS answer_id, CASE WHEN status = 'take' THEN coalesce(array_to_string(many, ','), '') ELSE '' END AS answer_ids, status IN ('already_taken', 'take', 'question_only') AS touched FROM ap", APPLIED))
def apply_decisions(spark, sf):
    return applied(spark, sf).select(
        "event_id", "status", F.coalesce("answer_id", F.lit("")).alias("answer_id"), F.coalesce(F.array_join("answer_ids", ","), F.lit("")).alias("answer_ids"), "touched"
    )


@query(oracle("v_dec v_vault", "SELECT chat_id, pass_id, count(*) FILTER (status = 'take') AS auto_taken_count, count(*) FILTER (status = 'question_only') AS question_only_count FROM ap GROUP BY ALL", APPLIED))
def decision_counts(spark, sf):
    return I.decision_counts(applied(spark, sf))


_V = "v_dec v_vault v_sub"


@query(oracle(_V, "SELECT chat_id, insight_id, batch_id, coalesce(taken, false) AS taken, one AS answer_id, ids AS answer_ids, pending_reason, source, mode, confidence, evidence, vault_version, created_at, ts AS updated_at FROM fs", FOLDED))
def fold_insight_state(spark, sf):
    folded = ChatState(spark, sf).folded
    blank = F.lit("")
    return folded.withColumns(
        {
            "taken": F.coalesce("taken", F.lit(False)),
            "answer_id": F.coalesce("answer_id", blank),
            "answer_ids": F.coalesce(F.array_join("answer_ids", ","), blank),
            "pending_reason": F.coalesce("pending_reason", blank),
            "mode": F.coalesce("mode", blank),
            "evidence": F.coalesce(F.array_join("evidence", ","), blank),
        }
    )


@query(oracle(_V, "SELECT chat_id, insight_id, batch_id, 'batch_fill' AS pending_reason, 'batch-expansion' AS source, 1.0::DOUBLE AS confidence FROM fill", FOLDED))
def batch_expand(spark, sf):
    chats = ChatState(spark, sf)
    return I.batch_expand(chats.state.touched, chats.index, chats.state.folded)


@query(oracle(_V, "SELECT s.chat_id, s.batch_id, insight_id, pending_reason, CAST(confidence AS DOUBLE) AS confidence FROM ss s WHERE taken IS NULL AND ((s.chat_id, s.batch_id) IN (SELECT chat_id, batch_id FROM touched) OR s.chat_id NOT IN (SELECT chat_id FROM touched))", FOLDED))
def pending_by_batch(spark, sf):
    chats = ChatState(spark, sf)
    return I.pending_by_batch(chats.state, chats.state.touched)


@query(oracle(_V, "SELECT chat_id, count(*) FILTER (taken) AS taken_count, count(*) FILTER (taken IS NULL) AS pending_count FROM ss GROUP BY chat_id", FOLDED))
def insight_stats(spark, sf):
    return I.insight_stats(ChatState(spark, sf).state)


@query(oracle("v_dec v_vault", "SELECT DISTINCT chat_id, batch_id FROM ap WHERE status IN ('already_taken', 'take', 'question_only')", APPLIED))
def touched_batches(spark, sf):
    return I.touched_batches(applied(spark, sf))


SURVEYS = f"""{FOLDED},
sv AS MATERIALIZED (SELECT s.chat_id, s.batch_id, x.batch_name || ' (Follow-up)' AS title, coalesce(x.language, 'en') AS language, s.insight_id, x.question, CASE WHEN x.is_multi THEN 'multi' ELSE 'single' END AS type, x.options, true AS include_other, 'Other (write-in)' AS other_label, row_number() OVER (PARTITION BY s.chat_id, s.batch_id ORDER BY CASE WHEN pending_reason = 'question_only' THEN 0 ELSE 1 END, confidence DESC, pos) AS question_no FROM ss s JOIN touched t ON t.chat_id = s.chat_id AND t.batch_id = s.batch_id JOIN ix x ON x.insight_id = s.insight_id AND x.batch_id = s.batch_id WHERE taken IS NULL)"""


def survey_rows(chats, questions=True):
    return I.build_surveys(chats.state, chats.state.touched, chats.index, questions)


@query(oracle(_V, "SELECT * FROM sv", SURVEYS))
def build_surveys(spark, sf):
    return survey_rows(ChatState(spark, sf)).withColumn("question_no", F.col("question_no").cast("bigint"))


@query(oracle("v_vault v_sub", "SELECT submission_id, status, status = 'ok' AS accepted FROM sub", INDEX + ",\n" + SUBMITTED))
def submit_survey(spark, sf):
    return I.submit_survey(responses(spark, sf), vault(spark, sf)).select("submission_id", "status", "accepted")


@query(
    oracle(
        _V,
        "SELECT * FROM (SELECT count(*) FILTER (taken IS NULL AND (one <> '' OR ids <> '')) AS pending_with_answer, count(*) FILTER (taken AND (one <> '') = (ids <> '')) AS taken_without_one_answer, count(*) - count(DISTINCT (chat_id, insight_id)) AS duplicate_key, count(*) AS rows FROM ss) UNPIVOT (violations FOR rule IN (*))",
        FOLDED,
    )
)
def state_quality(spark, sf):
    return I.state_quality(ChatState(spark, sf).state)


@query(
    oracle(
        _V,
        "SELECT c.chat_id, t.batch_id, coalesce(d.taken, 0) AS taken, t.total, coalesce(d.is_complete, false) AS is_complete FROM (SELECT DISTINCT chat_id FROM ss) c CROSS JOIN (SELECT batch_id, count(*) AS total FROM ix GROUP BY batch_id) t LEFT JOIN done d ON d.chat_id = c.chat_id AND d.batch_id = t.batch_id",
        FOLDED,
    )
)
def batch_completion(spark, sf):
    """Every active batch of every chat that has a row."""
    chats = ChatState(spark, sf)
    return I.batch_completion(chats.state, chats.index, dense=True)


@query(oracle(_V, "SELECT chat_id, batch_id, taken, total, is_complete FROM done", FOLDED))
def batch_completion_touched(spark, sf):
    chats = ChatState(spark, sf)
    return I.batch_completion(chats.state, chats.index)


@query(
    oracle(
        _V,
        "SELECT c.chat_id, b.batch_id FROM (SELECT DISTINCT chat_id FROM ss) c, (SELECT DISTINCT batch_id FROM ix) b WHERE NOT EXISTS (SELECT 1 FROM ix x WHERE x.batch_id = b.batch_id AND NOT EXISTS (SELECT 1 FROM ss s WHERE s.chat_id = c.chat_id AND s.insight_id = x.insight_id AND s.taken))",
        FOLDED,
    )
)
def fully_taken_batches(spark, sf):
    chats = ChatState(spark, sf)
    return I.fully_taken_batches(chats.state, chats.index)


@query(
    oracle(
        _V,
        "SELECT t.chat_id AS msg_id, count(*) AS batches, count(s.at) AS submitted, max(s.at) AS last_submitted_at, count(*) = count(s.at) AS is_submitted FROM touched t LEFT JOIN (SELECT chat_id, batch_id, max(ts) AS at FROM sub WHERE status = 'ok' GROUP BY ALL) s ON s.chat_id = t.chat_id AND s.batch_id = t.batch_id GROUP BY t.chat_id",
        FOLDED,
    )
)
def survey_message_progress(spark, sf):
    """One survey message per chat over its touched batches."""
    chats = ChatState(spark, sf)
    messages = chats.touched.withColumnRenamed("chat_id", "msg_id")
    return I.survey_message_progress(messages, chats.surveys.withColumnRenamed("chat_id", "msg_id"))
