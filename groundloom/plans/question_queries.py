"""Next-question queries: user prompts against the vaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake as U
from ..operators import insights as I
from ..operators import questions as N
from .fixtures import oracle, sql, view
from .insight_queries import FOLDED, INDEX, ChatState, vault
from .intake_queries import STATE, active, aliases, seg
from .intake_queries import ALIASES, _HIT, intents_sql
from .intake_queries import state as uia_state
from .registry import query

GENERIC = "(lower({0}) IN ('other', 'none', 'none of these', 'n/a', 'not applicable', 'not sure') OR regexp_matches(lower({0}), '^(other|none|n/a|not applicable|not sure)'))"

# Each prompt is asked about one batch.
_ASKED = "SELECT chat_id, turn, text, concat('b', chat_id % 25) AS batch_id FROM v_ask"
ASKED = f"""{INDEX},
aq AS MATERIALIZED ({_ASKED}),
ph AS (SELECT DISTINCT batch_id, insight_id, pos, answer_id, lower(label) AS phrase, 2 AS w, 'l' AS k FROM v_vault WHERE batch_active AND insight_active UNION ALL SELECT batch_id, insight_id, pos, answer_id, lower(alias), 1, 'a' FROM v_vault WHERE batch_active AND insight_active),
rel AS MATERIALIZED (SELECT chat_id, turn, aq.batch_id, insight_id, pos, answer_id, CAST(sum(w) AS BIGINT) AS score FROM aq JOIN ph ON ph.batch_id = aq.batch_id AND contains(lower(text), phrase) GROUP BY ALL),
irel AS MATERIALIZED (SELECT chat_id, turn, batch_id, insight_id, pos, CAST(sum(score) AS BIGINT) AS score FROM rel GROUP BY ALL),
best AS MATERIALIZED (SELECT a.chat_id, a.turn, a.text, a.batch_id, coalesce(r.insight_id, f.insight_id) AS insight_id, coalesce(r.score, 0) AS score FROM aq a LEFT JOIN (SELECT batch_id, arg_min(insight_id, pos) AS insight_id FROM ix GROUP BY batch_id) f ON f.batch_id = a.batch_id LEFT JOIN (SELECT * FROM irel QUALIFY row_number() OVER (PARTITION BY chat_id, turn ORDER BY score DESC, pos) = 1) r ON r.chat_id = a.chat_id AND r.turn = a.turn)"""


def asked(spark, sf):
    return sql(spark, sf, _ASKED)


_OPTIONS = "SELECT p_brand AS list_id, p_partkey AS id, p_name AS label, p_partkey AS pos FROM part"


@query(
    oracle(
        "v_ask",
        "SELECT chat_id, turn, id, label, score, rank FROM (SELECT a.chat_id, a.turn, o.id, o.label, CAST(len(list_filter(regexp_split_to_array(lower(o.label), '[^a-z0-9+]+'), lambda t: t <> '' AND contains(lower(a.text), t))) AS BIGINT) AS score, row_number() OVER (PARTITION BY a.chat_id, a.turn ORDER BY score DESC, o.pos) AS rank FROM (SELECT *, concat('Brand#', 1 + chat_id % 25) AS list_id FROM v_ask) a JOIN ("
        + _OPTIONS
        + ") o ON o.list_id = a.list_id) WHERE rank <= 4",
    )
)
def shortlist(spark, sf):
    """Skills of the prompt's category."""
    asks = view(spark, sf, "v_ask").withColumn("list_id", F.concat(F.lit("Brand#"), 1 + F.col("chat_id") % 25))
    top = N.shortlist(asks, sql(spark, sf, _OPTIONS))
    return top.select("chat_id", "turn", "id", "label", "score", F.col("rank").cast("bigint").alias("rank"))


@query(oracle("v_ask v_vault", "SELECT * FROM rel", ASKED))
def answer_relevance(spark, sf):
    return N.answer_relevance(asked(spark, sf), vault(spark, sf))


@query(oracle("v_ask v_vault", "SELECT chat_id, turn, aq.batch_id, a.insight_id, a.pos, a.answer_id, coalesce(rel.score, 0) AS score FROM aq JOIN (SELECT DISTINCT batch_id, insight_id, pos, answer_id FROM ph) a ON a.batch_id = aq.batch_id LEFT JOIN rel USING (chat_id, turn, insight_id, answer_id)", ASKED))
def answer_relevance_all(spark, sf):
    """Also the answers that a prompt does not mention."""
    asks = asked(spark, sf)
    return N.with_unmentioned(N.answer_relevance(asks, vault(spark, sf), shared=True), asks, vault(spark, sf))


@query(oracle("v_ask v_vault", "SELECT chat_id, turn, aq.batch_id, a.insight_id, a.pos, coalesce(irel.score, 0) AS score FROM aq JOIN (SELECT DISTINCT batch_id, insight_id, pos FROM ph) a ON a.batch_id = aq.batch_id LEFT JOIN irel USING (chat_id, turn, insight_id)", ASKED))
def insight_relevance_all(spark, sf):
    asks = asked(spark, sf)
    return N.with_unmentioned(N.insight_relevance(asks, vault(spark, sf), shared=True), asks, vault(spark, sf))


@query(oracle("v_ask v_vault", "SELECT * FROM irel", ASKED))
def insight_relevance(spark, sf):
    return N.insight_relevance(asked(spark, sf), vault(spark, sf))


@query(oracle("v_ask v_vault", "SELECT chat_id, turn, batch_id, insight_id, score FROM best", ASKED))
def best_insight(spark, sf):
    return N.best_insight(asked(spark, sf), vault(spark, sf)).drop("text")


@query(
    oracle(
        "v_ask v_vault",
        f"""SELECT chat_id, turn, insight_id, item_no, string_agg(label, '|' ORDER BY score DESC, answer_id) AS mention_answers FROM (
  SELECT *, row_number() OVER (PARTITION BY chat_id, turn, insight_id ORDER BY score DESC, answer_id) AS n, max(score) OVER (PARTITION BY chat_id, turn, insight_id) AS top FROM (
    SELECT a.chat_id, a.turn, x.insight_id, x.item_no, v.answer_id, v.label, CASE WHEN contains(lower(a.text), lower(v.label)) THEN 2 ELSE 0 END + CASE WHEN contains(lower(a.text), lower(v.alias)) THEN 1 ELSE 0 END AS score
    FROM aq a JOIN (SELECT batch_id, insight_id, row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS item_no FROM ix) x ON x.batch_id = a.batch_id AND item_no <= 3 JOIN v_vault v ON v.insight_id = x.insight_id WHERE NOT {GENERIC.format('v.label')}))
WHERE n <= 3 AND (score > 0 OR top = 0) GROUP BY ALL""",
        ASKED,
    )
)
def mention_answers(spark, sf):
    m = N.mention_answers(asked(spark, sf), vault(spark, sf))
    return m.select("chat_id", "turn", "insight_id", F.col("item_no").cast("bigint").alias("item_no"), F.array_join("mention_answers", "|").alias("mention_answers"))


_CANON = f"list_filter(labels, lambda s: NOT {GENERIC.format('s')})"
_DET = f"rtrim(question, ' ?') || '—' || CASE WHEN is_multi THEN 'choose any of' ELSE 'choose one of' END || ': ' || array_to_string({_CANON}[1:2], ', ') || ', or ' || {_CANON}[3] || ' (reply with the exact words)?'"


@query(oracle("v_vault", f"SELECT insight_id, array_to_string({_CANON}, '|') AS labels FROM ix", INDEX))
def canonical_labels(spark, sf):
    ix = I.insight_index(vault(spark, sf))
    return ix.select("insight_id", F.array_join(N.canonical_labels(F.col("answers")), "|").alias("labels"))


def fallback_question():
    return N.deterministic_question(F.col("question"), F.col("is_multi"), N.canonical_labels(F.col("answers")))


@query(oracle("v_vault", f"SELECT insight_id, {_DET} AS question FROM ix", INDEX))
def deterministic_question(spark, sf):
    return I.insight_index(vault(spark, sf)).select("insight_id", fallback_question().alias("question"))


@query(
    oracle(
        "v_ask v_vault",
        f"SELECT chat_id, turn, CASE WHEN ix.insight_id IS NOT NULL AND (contains(lower(text), 'reading') OR contains(lower(text), 'videos') OR contains(lower(text), 'hands-on practice')) THEN text ELSE {_DET} END AS question FROM best LEFT JOIN ix ON ix.insight_id = best.insight_id",
        ASKED,
    )
)
def question_guard(spark, sf):
    """The prompt text stands in for the model's question."""
    best = N.best_insight(asked(spark, sf), vault(spark, sf)).select("chat_id", "turn", "text", "insight_id")
    joined = best.join(I.insight_index(vault(spark, sf)), "insight_id", "left")
    guarded = N.question_guard(F.col("text"), N.canonical_labels(F.col("answers")), fallback_question())
    return joined.select("chat_id", "turn", guarded.alias("question"))


_REPLIES = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'employment_category' WHEN 1 THEN 'skills' ELSE 'insights' END AS stage, CASE event_id % 5 WHEN 0 THEN concat('{"stage": "x", "question": " Which of ', event_type, ' "}') WHEN 1 THEN concat('Sure: {"question": "Why ', user_id, '?"} ok') WHEN 2 THEN '{"question": ""}' WHEN 3 THEN '{"question": ' ELSE '' END AS raw FROM events"""


@query(
    f"SELECT event_id, stage, CASE event_id % 5 WHEN 0 THEN 'Which of ' || event_type || '?' WHEN 1 THEN 'Why ' || user_id || '?' ELSE CASE stage {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in N.STAGE_FALLBACK.items())} END END AS question FROM (SELECT r.*, e.event_type, e.user_id FROM ({_REPLIES}) r JOIN events e ON e.event_id = r.event_id)"
)
def model_question(spark, sf):
    rows = sql(spark, sf, _REPLIES)
    return rows.select("event_id", "stage", N.model_question(F.col("raw"), F.col("stage")).alias("question"))


@query(
    oracle(
        "v_ask v_vault",
        "SELECT b.chat_id, b.turn, b.insight_id, coalesce((SELECT 'Since you mentioned ' || lower(arg_min(v.label, v.answer_id)) || ',' FROM v_vault v WHERE v.insight_id = b.insight_id AND (contains(lower(b.text), lower(v.label)) OR contains(lower(b.text), lower(v.alias)))), '') AS hook FROM best b",
        ASKED,
    )
)
def context_hook(spark, sf):
    best = N.best_insight(asked(spark, sf), vault(spark, sf)).select("chat_id", "turn", "text", "insight_id")
    joined = best.join(I.insight_index(vault(spark, sf)).select("insight_id", "answers"), "insight_id", "left")
    return joined.select("chat_id", "turn", "insight_id", N.context_hook(F.col("text"), F.col("answers")).alias("hook"))


# Every conversation is asked about; the decision log has the chats of the same number.
OPEN = f"""{FOLDED},
chats AS (SELECT DISTINCT conv_id AS conv, conv_id AS chat_id FROM conversations),
opn AS MATERIALIZED (SELECT c.conv, c.chat_id, (SELECT arg_min(b.batch_id, b.batch_pos) FROM (SELECT DISTINCT batch_id, batch_pos FROM ix) b WHERE NOT EXISTS (SELECT 1 FROM lt WHERE lt.chat_id = c.chat_id AND lt.batch_id = b.batch_id) AND NOT EXISTS (SELECT 1 FROM done d WHERE d.chat_id = c.chat_id AND d.batch_id = b.batch_id AND d.is_complete)) AS batch_id FROM chats c)"""
# The batches a chat touched in its latest pass.
OPEN = OPEN.replace("chats AS (", "lt AS (SELECT DISTINCT chat_id, batch_id FROM ap WHERE status IN ('already_taken', 'take', 'question_only') QUALIFY pass_id = max(pass_id) OVER (PARTITION BY chat_id)),\nchats AS (")
_V = "v_dec v_vault v_sub"


def open_batches(spark, sf, chats):
    decided = chats.applied.filter("touched")
    last = decided.groupBy("chat_id").agg(F.max("pass_id").alias("pass_id"))
    touched = decided.join(last, ["chat_id", "pass_id"], "left_semi").select("chat_id", "batch_id").distinct()
    complete = I.fully_taken_batches(chats.state, chats.index)
    asked_about = sql(spark, sf, "SELECT DISTINCT conv_id AS conv, conv_id AS chat_id FROM conversations")
    return N.first_open_batch(asked_about, touched, complete, chats.index)


@query(oracle(_V, "SELECT conv, chat_id, coalesce(batch_id, '') AS batch_id FROM opn", OPEN))
def first_open_batch(spark, sf):
    return open_batches(spark, sf, ChatState(spark, sf)).withColumn("batch_id", F.coalesce("batch_id", F.lit("")))


TURNS = f"""{OPEN},
{ALIASES},
{_HIT},
{intents_sql('hit')},
{STATE},
tn AS MATERIALIZED (SELECT *, CASE WHEN ec IS NULL AND action <> 'show_ec_survey' THEN 'employment_category' WHEN NOT done AND action <> 'show_skills_survey' THEN 'skills' WHEN batch_id IS NOT NULL THEN 'insights' ELSE 'none' END AS stage FROM (
 SELECT i.chat_id, i.turn, s.employment_category_id AS ec, coalesce(s.done, false) AS done, o.batch_id, o.chat_id AS log_chat, CASE
  WHEN ec_hit IS NOT NULL AND ec IS NULL THEN (CASE WHEN skl AND NOT coalesce(s.done, false) THEN 'show_skills_survey' ELSE 'recorded_ec' END)
  WHEN ec_hit IS NOT NULL THEN (CASE WHEN skl AND NOT s.done THEN 'show_skills_survey' ELSE 'none' END)
  WHEN (emp OR skl) AND s.employment_category_id IS NULL THEN 'show_ec_survey'
  WHEN skl AND NOT s.done THEN 'show_skills_survey' ELSE 'none' END AS action
 FROM intents i LEFT JOIN st s ON s.chat_id = i.chat_id LEFT JOIN opn o ON o.conv = i.chat_id))"""
TURN_VIEWS = "v_dec v_vault v_sub v_seg v_ask v_uia"


def turns(spark, sf, chats):
    asks = U.find_ec_by_alias(U.rule_intents(view(spark, sf, "v_ask")), aliases(spark, sf), active(spark, sf))
    acted = U.intake_action(asks, uia_state(spark, sf), seg(spark, sf), active(spark, sf))
    opened = open_batches(spark, sf, chats).select(F.col("conv").alias("chat_id"), F.col("chat_id").alias("log_chat"), "batch_id")
    joined = acted.join(opened, "chat_id", "left")
    return joined.withColumn("stage", N.stage(F.col("ec_current"), F.col("skills_done"), F.col("action"), F.col("batch_id")))


@query(oracle(TURN_VIEWS, "SELECT chat_id, turn, action, stage FROM tn", TURNS))
def stage(spark, sf):
    return turns(spark, sf, ChatState(spark, sf)).select("chat_id", "turn", "action", "stage")
