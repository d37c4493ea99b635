"""Segment vault and intake queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake as U
from .fixtures import oracle, sql, view
from .registry import query
from .text_queries import norm

SPLIT = "1998-01-01"  # history before, new submissions from here on


def seg(spark, sf):
    return view(spark, sf, "v_seg")


def uia(spark, sf):
    return view(spark, sf, "v_uia").withColumn("skills", F.array("skill_id"))


def active(spark, sf):
    return seg(spark, sf).agg(F.max("vault_version")).scalar()


def fold_sql(where: str = "true") -> str:
    return f"""ev AS (SELECT * FROM v_uia WHERE kind <> 'message' AND {where}),
st AS MATERIALIZED (SELECT chat_id, arg_max(ec_id, (ts, event_id)) AS employment_category_id,
  arg_max(CASE WHEN kind = 'set_skills' THEN skill_id ELSE '' END, (ts, event_id)) AS skills,
  coalesce(arg_max(kind, (ts, event_id)) FILTER (kind <> 'set_ec') = 'system_decide', false) AS let_system_decide,
  arg_max(vault_version, (ts, event_id)) AS vault_version, CASE WHEN arg_min(kind, (ts, event_id)) = 'set_ec' THEN min(ts) END AS recorded_at, max(ts) AS updated_at,
  let_system_decide OR skills <> '' AS done FROM ev GROUP BY chat_id)"""


STATE = fold_sql()


def state(spark, sf):
    return U.fold_uia_state(uia(spark, sf))


@query(oracle("v_seg", "SELECT vault_version, ec_id AS id, min(ec_name) AS label, '' AS desc, min(pos) AS pos FROM v_seg GROUP BY ALL"))
def ec_options(spark, sf):
    return U.ec_options(seg(spark, sf))


@query(oracle("v_seg", "SELECT vault_version, ec_id, skill_id AS id, skill_name AS label, '' AS desc, pos FROM v_seg"))
def skill_options(spark, sf):
    return U.skill_options(seg(spark, sf))


@query(oracle("v_uia v_seg", "SELECT event_id, CASE WHEN kind = 'message' THEN 'latest' ELSE vault_version END AS requested, CASE WHEN kind = 'message' OR vault_version = 'v1' THEN 'v1' END AS resolved FROM v_uia"))
def resolve_version(spark, sf):
    asked = uia(spark, sf).select("event_id", F.when(F.col("kind") == "message", "latest").otherwise(F.col("vault_version")).alias("requested"))
    vault = seg(spark, sf)
    config = vault.groupBy(F.lit("segment_vault").alias("name")).agg(F.max("vault_version").alias("latest_version"))
    return U.resolve_version(asked, config, vault)


ALIASES = f"""al0 AS (SELECT DISTINCT vault_version, 'ec' AS type, ec_name AS alias, ec_id AS target_id, '' AS employment_category_id, 0 AS n FROM v_seg UNION ALL SELECT vault_version, 'skill', skill_name, skill_id, ec_id, 0 FROM v_seg UNION ALL SELECT vault_version, 'skill', skill_alias, skill_id, ec_id, 1 FROM v_seg),
al AS MATERIALIZED (SELECT vault_version, type, target_id, employment_category_id, {norm('alias')} AS alias_norm, arg_min(alias, n) AS alias FROM al0 GROUP BY ALL)"""


def aliases(spark, sf):
    return U.build_alias_index(seg(spark, sf))


@query(oracle("v_seg", "SELECT * FROM al", ALIASES))
def build_alias_index(spark, sf):
    return aliases(spark, sf).withColumn("employment_category_id", F.coalesce("employment_category_id", F.lit("")))


_HIT = f"hit AS (SELECT v.*, (SELECT min(target_id) FROM al WHERE type = 'ec' AND alias_norm = {norm('v.text')}) AS ec_hit FROM v_ask v)"


@query(oracle("v_seg v_ask", "SELECT chat_id, turn, coalesce(ec_hit, '') AS ec_hit FROM hit", ALIASES + ",\n" + _HIT))
def find_ec_by_alias(spark, sf):
    found = U.find_ec_by_alias(view(spark, sf, "v_ask"), aliases(spark, sf), active(spark, sf))
    return found.select("chat_id", "turn", F.coalesce("ec_hit", F.lit("")).alias("ec_hit"))


def _any(hints: list[str], text: str) -> str:
    tests = ", ".join("'" + h.replace("'", "''") + "'" for h in hints)
    return f"len(list_filter([{tests}], lambda h: contains(' ' || {text} || ' ', h))) > 0"


def intents_sql(src: str) -> str:
    return f"intents AS (SELECT *, {_any(U.EMPLOYMENT_HINTS, norm('text'))} AS emp, {_any(U.SKILLS_HINTS, norm('text'))} AS skl FROM {src})"


@query(oracle("v_ask", "SELECT chat_id, turn, emp AS employment_intent, skl AS skills_intent FROM intents", intents_sql("v_ask")))
def rule_intents(spark, sf):
    return U.rule_intents(view(spark, sf, "v_ask")).drop("text")


_SAID = """SELECT chat_id, turn, text, CASE (chat_id + turn) % 4 WHEN 0 THEN '{"employment_intent": true, "skills_intent": false, "ec_hit": "Brand#1", "confidence": 1}' WHEN 1 THEN '{"employment_intent": "true", "skills_intent": true, "ec_hit": null}' WHEN 2 THEN '{"employment_intent": true}' ELSE 'no' END AS raw FROM v_ask"""


@query(
    oracle(
        "v_ask",
        "SELECT chat_id, turn, CASE c WHEN 0 THEN true WHEN 1 THEN false ELSE emp END AS employment_intent, CASE c WHEN 0 THEN false WHEN 1 THEN true ELSE skl END AS skills_intent, CASE c WHEN 0 THEN 'Brand#1' ELSE '' END AS ec_hit, CASE WHEN c < 2 THEN 'model' ELSE 'rules' END AS detected_by FROM (SELECT *, (chat_id + turn) % 4 AS c FROM intents)",
        intents_sql("v_ask"),
    )
)
def ingest_intents(spark, sf):
    read = U.ingest_intents(sql(spark, sf, _SAID))
    return read.drop("text", "raw").withColumn("ec_hit", F.coalesce("ec_hit", F.lit("")))


@query(oracle("v_uia", "SELECT chat_id, done FROM st", STATE))
def skills_done(spark, sf):
    return state(spark, sf).select("chat_id", U.skills_done(F.col("let_system_decide"), F.col("skills_selected")).alias("done"))


@query(
    oracle(
        "v_seg v_ask v_uia",
        """SELECT chat_id, turn, CASE
  WHEN ec_hit IS NOT NULL AND ec IS NULL THEN (CASE WHEN skl AND NOT done THEN 'show_skills_survey' ELSE 'recorded_ec' END)
  WHEN ec_hit IS NOT NULL THEN (CASE WHEN skl AND NOT done AND known THEN 'show_skills_survey' ELSE 'none' END)
  WHEN emp AND ec IS NULL THEN 'show_ec_survey'
  WHEN skl AND ec IS NULL THEN 'show_ec_survey'
  WHEN skl AND NOT done AND known THEN 'show_skills_survey' ELSE 'none' END AS action
FROM (SELECT i.chat_id, i.turn, i.emp, i.skl, i.ec_hit, s.employment_category_id AS ec, coalesce(s.done, false) AS done, s.employment_category_id IN (SELECT ec_id FROM v_seg) AS known FROM intents i LEFT JOIN st s ON s.chat_id = i.chat_id)""",
        f"{ALIASES},\n{_HIT},\n{intents_sql('hit')},\n{STATE}",
    )
)
def intake_action(spark, sf):
    turns = U.find_ec_by_alias(U.rule_intents(view(spark, sf, "v_ask")), aliases(spark, sf), active(spark, sf))
    return U.intake_action(turns, state(spark, sf), seg(spark, sf), active(spark, sf)).select("chat_id", "turn", "action")


@query(oracle("v_seg", f"SELECT '{U.EC_SURVEY['type']}' AS type, '{U.EC_SURVEY['title']}' AS title, '{U.EC_SURVEY['help']}' AS help, vault_version, ec_id AS id, min(ec_name) AS label, '' AS desc, min(pos) AS pos FROM v_seg GROUP BY vault_version, ec_id"))
def ec_survey(spark, sf):
    return U.ec_survey(seg(spark, sf))


@query(oracle("v_seg", f"SELECT '{U.SKILLS_SURVEY['type']}' AS type, '{U.SKILLS_SURVEY['title']}' AS title, '{U.SKILLS_SURVEY['help']}' AS help, vault_version, ec_id, skill_id AS id, skill_name AS label, '' AS desc, pos, 4 AS max, true AS let_system_decide FROM v_seg"))
def skills_survey(spark, sf):
    return U.skills_survey(seg(spark, sf))


_PAST = fold_sql(f"ts < TIMESTAMP '{SPLIT}'")


def past(spark, sf):
    return U.fold_uia_state(uia(spark, sf).filter(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")))


def fresh(spark, sf, kind: str):
    new = uia(spark, sf).filter(F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz"))
    return new.filter(F.col("kind").isin(*kind.split()))


@query(
    oracle(
        "v_uia v_seg",
        f"SELECT event_id, CASE WHEN vault_version <> 'v1' THEN '409 version changed' WHEN p.employment_category_id IS NOT NULL THEN '409 already set' WHEN e.claimed NOT IN (SELECT ec_id FROM v_seg) THEN '400 invalid category' ELSE 'ok' END AS status FROM (SELECT event_id, chat_id, vault_version, CASE WHEN event_id % 5 = 0 THEN 'nope' ELSE ec_id END AS claimed FROM v_uia WHERE ts >= TIMESTAMP '{SPLIT}' AND kind = 'set_ec') e LEFT JOIN (SELECT chat_id, employment_category_id FROM st) p ON p.chat_id = e.chat_id",
        _PAST,
    )
)
def validate_employment(spark, sf):
    """New category submissions against the state before them; some name an unknown category."""
    subs = fresh(spark, sf, "set_ec").withColumn("ec_id", F.when(F.col("event_id") % 5 == 0, "nope").otherwise(F.col("ec_id")))
    return U.validate_employment(subs, past(spark, sf), seg(spark, sf), active(spark, sf)).select("event_id", "status")


@query(
    oracle(
        "v_uia v_seg",
        f"""SELECT event_id AS submission_id, status, CASE WHEN status = 'ok manual' THEN len(sel) ELSE 0 END AS skills_count FROM (SELECT e.*, CASE
  WHEN e.vault_version <> 'v1' THEN '409 version changed'
  WHEN p.employment_category_id <> e.ec_id THEN '400 category mismatch'
  WHEN coalesce(p.done, false) THEN '409 already recorded'
  WHEN e.kind = 'system_decide' THEN 'ok system_decide'
  WHEN len(sel) NOT BETWEEN 1 AND 4 THEN '400 pick 1 to 4'
  WHEN event_id % 7 = 3 AND e.ec_id <> (SELECT ec_id FROM v_seg WHERE skill_id = 'sk0') THEN '400 foreign skill'
  ELSE 'ok manual' END AS status
 FROM (SELECT *, CASE event_id % 7 WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN [skill_id, skill_id, skill_id, skill_id, skill_id] WHEN 3 THEN [skill_id, 'sk0'] ELSE [skill_id] END AS sel FROM v_uia WHERE ts >= TIMESTAMP '{SPLIT}' AND kind IN ('set_skills', 'system_decide')) e LEFT JOIN (SELECT chat_id, employment_category_id, done FROM st) p ON p.chat_id = e.chat_id)""",
        _PAST,
    )
)
def validate_skills(spark, sf):
    """New skills submissions: empty, over-long and foreign selections mixed in."""
    own = F.col("skill_id")
    selected = (
        F.when(F.col("event_id") % 7 == 1, F.array().cast("array<string>"))
        .when(F.col("event_id") % 7 == 2, F.array(own, own, own, own, own))
        .when(F.col("event_id") % 7 == 3, F.array(own, F.lit("sk0")))
        .otherwise(F.array(own))
    )
    subs = fresh(spark, sf, "set_skills system_decide").select(
        F.col("event_id").alias("submission_id"), "chat_id", "ec_id", "vault_version", (F.col("kind") == "system_decide").alias("let_system_decide"), selected.alias("skills_selected")
    )
    checked = U.validate_skills(subs, past(spark, sf), seg(spark, sf), active(spark, sf))
    return checked.select("submission_id", "status", "skills_count")


@query(oracle("v_uia", "SELECT chat_id, employment_category_id, skills, let_system_decide, vault_version, recorded_at, updated_at FROM st", STATE))
def fold_uia_state(spark, sf):
    skills = F.coalesce(F.array_join("skills_selected", ","), F.lit(""))
    return state(spark, sf).withColumn("skills", skills).drop("skills_selected")


@query(oracle("v_uia", "SELECT c.c_custkey AS chat_id, coalesce(employment_category_id, '') AS ec, coalesce(skills, '') AS skills, coalesce(let_system_decide, false) AS let_system_decide, coalesce(s.vault_version, '') AS vault_version FROM customer c LEFT JOIN st s ON s.chat_id = c.c_custkey", STATE))
def uia_state_or_default(spark, sf):
    chats = sql(spark, sf, "SELECT c_custkey AS chat_id FROM customer")
    full = U.uia_state_or_default(chats, state(spark, sf))
    return full.select(
        "chat_id",
        F.coalesce("employment_category_id", F.lit("")).alias("ec"),
        F.coalesce(F.array_join("skills_selected", ","), F.lit("")).alias("skills"),
        "let_system_decide",
        F.coalesce("vault_version", F.lit("")).alias("vault_version"),
    )


@query(oracle("v_uia", "SELECT chat_id, true AS has_ec, done AS has_skills, done AS surveys_allowed, CASE WHEN done THEN '' ELSE 'prereqs_not_met' END AS skip_reason FROM st", STATE))
def prereq_gate(spark, sf):
    return U.prereq_gate(state(spark, sf))
