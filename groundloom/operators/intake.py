"""Segment vault and intake: options, aliases, intents, decisions, submissions and per-chat state.

The vault is a flat frame, one row per skill: ``vault_version, ec_id, ec_name, skill_id, skill_name,
skill_alias, pos``. Options are rows, never one list, so a category may hold any number of skills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.modeljson import field, has_field, is_json_object
from ..functions.text import alias_normalize, let

VERSIONED_EC = ["vault_version", "ec_id"]


def flatten_vault(vaults: DataFrame) -> DataFrame:
    """Nested vault documents to the flat form; aliases stay as arrays."""
    ecs = vaults.select("vault_version", F.posexplode("employment_categories").alias("ec_pos", "ec"))
    skills = ecs.select("*", F.posexplode_outer("ec.skills").alias("sk_pos", "sk"))
    return skills.select(
        "vault_version",
        F.col("ec.id").alias("ec_id"),
        F.col("ec.name").alias("ec_name"),
        F.coalesce("ec.description", F.lit("")).alias("ec_desc"),
        F.col("ec.aliases").alias("ec_aliases"),
        F.col("sk.id").alias("skill_id"),
        F.col("sk.name").alias("skill_name"),
        F.coalesce("sk.description", F.lit("")).alias("skill_desc"),
        F.col("sk.aliases").alias("skill_aliases"),
        (F.col("ec_pos").cast("bigint") * (1 << 32) + F.coalesce("sk_pos", F.lit(0))).alias("pos"),
    )


def ec_options(vault: DataFrame) -> DataFrame:
    """Categories of each version as (id, label, desc) with the position of their first row."""
    desc = F.min_by("ec_desc", "pos") if "ec_desc" in vault.columns else F.lit("")
    return vault.groupBy("vault_version", F.col("ec_id").alias("id")).agg(
        F.min_by("ec_name", "pos").alias("label"), desc.alias("desc"), F.min("pos").alias("pos")
    )


def skill_options(vault: DataFrame) -> DataFrame:
    """Skills of each category as (id, label, desc)."""
    desc = F.col("skill_desc") if "skill_desc" in vault.columns else F.lit("")
    return vault.filter(F.col("skill_id").isNotNull()).select(
        *VERSIONED_EC, F.col("skill_id").alias("id"), F.col("skill_name").alias("label"), desc.alias("desc"), "pos"
    )


def resolve_version(requests: DataFrame, config: DataFrame, vault: DataFrame) -> DataFrame:
    """Resolve requested versions; ``latest`` follows the pointer, an absent version becomes null.

    ``config`` is (name, latest_version).
    """
    pointer = config.filter("name = 'segment_vault'").agg(F.max("latest_version")).scalar()
    wanted = F.when(F.col("requested") == "latest", pointer).otherwise(F.col("requested"))
    known = vault.select(F.col("vault_version").alias("resolved")).distinct()
    return requests.withColumn("_v", wanted).join(known, F.col("_v") == F.col("resolved"), "left").drop("_v")


def build_alias_index(vault: DataFrame) -> DataFrame:
    """Normalised names and aliases of categories and skills, first spelling per target and form."""
    blank = F.array().cast("array<string>")
    ec_names = F.concat(F.array("ec_name"), F.coalesce("ec_aliases", blank) if "ec_aliases" in vault.columns else blank)
    sk_alias = F.coalesce("skill_aliases", blank) if "skill_aliases" in vault.columns else F.array("skill_alias")
    sk_names = F.concat(F.array("skill_name"), F.coalesce(sk_alias, blank))

    def rows(kind: str, target: str, names: Column, parent: Column) -> DataFrame:
        return vault.select(
            "vault_version",
            F.lit(kind).alias("type"),
            F.col(target).alias("target_id"),
            parent.alias("employment_category_id"),
            "pos",
            F.posexplode(names).alias("n", "alias"),
        ).filter(F.col("target_id").isNotNull() & F.col("alias").isNotNull())

    both = rows("ec", "ec_id", ec_names, F.lit(None).cast("string")).union(rows("skill", "skill_id", sk_names, F.col("ec_id")))
    keys = ["vault_version", "type", "target_id", "employment_category_id"]
    # Equal spellings collapse first, so normalising runs once per spelling and target.
    spelled = both.groupBy(*keys, "alias").agg(F.min(F.struct("n", "pos")).alias("at"))
    normed = spelled.withColumn("alias_norm", alias_normalize(F.col("alias")))
    return normed.groupBy(*keys, "alias_norm").agg(F.min_by("alias", "at").alias("alias"))


def find_ec_by_alias(texts: DataFrame, alias_index: DataFrame, version: Column) -> DataFrame:
    """Category whose alias equals the normalised text; null where there is none."""
    names = (
        alias_index.filter((F.col("type") == "ec") & (F.col("vault_version") == version))
        .groupBy("alias_norm")
        .agg(F.min("target_id").alias("ec_hit"))
    )
    return texts.withColumn("alias_norm", alias_normalize(F.col("text"))).join(names, "alias_norm", "left").drop("alias_norm")


# Phrases that hint at an intent. They are sought in normalised text.
EMPLOYMENT_HINTS = [
    "i am a ", "i'm a ", "i work as", "my job", "my role", "position", "employment",
    "engineer", "developer", "analyst", "designer", "teacher", "nurse", "manager", "accountant",
]
SKILLS_HINTS = [
    "skills", "learn", "upskill", "improve", "develop", "teach me", "pick skills",
    "help me choose skills", "skill plan", "curriculum", "roadmap",
]


def _hinted(text: Column, hints: list[str]) -> Column:
    listed = F.array(*[F.lit(h) for h in hints])
    return let(F.concat(F.lit(" "), text, F.lit(" ")), lambda t: F.exists(listed, lambda h: t.contains(h)))


def rule_intents(texts: DataFrame) -> DataFrame:
    """Add ``employment_intent`` and ``skills_intent`` by phrase."""
    normed = texts.withColumn("_norm", alias_normalize(F.col("text")))
    return normed.withColumns(
        {
            "employment_intent": _hinted(F.col("_norm"), EMPLOYMENT_HINTS),
            "skills_intent": _hinted(F.col("_norm"), SKILLS_HINTS),
        }
    ).drop("_norm")


def ingest_intents(texts: DataFrame) -> DataFrame:
    """Intents from the model reply in ``raw``; only JSON ``true`` counts as true.

    Where the reply is unusable the phrases decide and no category is hit.
    """
    raw = F.col("raw")
    names = ["employment_intent", "skills_intent", "ec_hit"]
    usable = is_json_object(raw)
    for name in names:
        usable = usable & has_field(raw, f"$.{name}")
    ruled = rule_intents(texts).withColumn("_usable", F.coalesce(usable, F.lit(False)))

    def strict(name: str) -> Column:
        said = F.to_json(field(raw, f"$.{name}", "variant")) == "true"
        return F.when(F.col("_usable"), said).otherwise(F.col(name))

    return ruled.withColumns(
        {
            "employment_intent": strict("employment_intent"),
            "skills_intent": strict("skills_intent"),
            "ec_hit": F.when(F.col("_usable"), field(raw, "$.ec_hit", "string")),
            "detected_by": F.when(F.col("_usable"), "model").otherwise("rules"),
        }
    ).drop("_usable")


def skills_done(let_system_decide: Column, skills: Column) -> Column:
    return F.coalesce(let_system_decide, F.lit(False)) | (F.coalesce(F.size(skills), F.lit(0)) > 0)


def intake_action(turns: DataFrame, state: DataFrame, vault: DataFrame, version: Column) -> DataFrame:
    """What to do with each turn: record the category, show a survey, or nothing.

    ``turns`` carries chat_id, the two intents and ec_hit.
    """
    current = vault.filter(F.col("vault_version") == version)
    counts = current.groupBy("ec_id").agg(F.count("skill_id").alias("n_skills"))
    known = state.select(
        "chat_id",
        F.col("employment_category_id").alias("ec_current"),
        skills_done(F.col("let_system_decide"), F.col("skills_selected")).alias("skills_done"),
    )
    joined = (
        turns.join(known, "chat_id", "left")
        .withColumn("survey_ec", F.coalesce("ec_current", "ec_hit"))
        .join(counts.withColumnRenamed("ec_id", "survey_ec"), "survey_ec", "left")
    )
    emp, skl = F.col("employment_intent"), F.col("skills_intent")
    done = F.coalesce("skills_done", F.lit(False))
    new = F.col("ec_current").isNull()
    can_ask = skl & ~done & (F.coalesce("n_skills", F.lit(0)) > 0)
    hit = F.col("ec_hit").isNotNull()
    action = (
        F.when(hit & can_ask, "show_skills_survey")
        .when(hit & new, "recorded_ec")
        .when(hit, "none")
        .when((emp | skl) & new, "show_ec_survey")
        .when(can_ask, "show_skills_survey")
        .otherwise("none")
    )
    return joined.withColumn("action", action).drop("n_skills")


# Survey headers.
EC_SURVEY = {
    "type": "single-select",
    "title": "Choose your employment category",
    "help": "Pick the one that best describes you.",
}
SKILLS_SURVEY = {
    "type": "multi-select-with-limit",
    "title": "Pick up to 4 skills to focus on",
    "help": "You can choose 1–4, or let the system decide for you.",
}


def _headed(options: DataFrame, header: dict[str, str]) -> DataFrame:
    return options.select([F.lit(v).alias(k) for k, v in header.items()] + ["*"])


def ec_survey(vault: DataFrame) -> DataFrame:
    """Category survey of each version, one row per option."""
    return _headed(ec_options(vault), EC_SURVEY)


def skills_survey(vault: DataFrame, max_select: int = 4) -> DataFrame:
    """Skills survey of each category, one row per option."""
    headed = _headed(skill_options(vault), SKILLS_SURVEY)
    return headed.withColumns({"max": F.lit(max_select), "let_system_decide": F.lit(True)})


# --- submissions ----------------------------------------------------------------------------------


def _checked(subs: DataFrame, state: DataFrame, vault: DataFrame) -> DataFrame:
    known = state.select(
        "chat_id",
        F.col("employment_category_id").alias("_ec"),
        skills_done(F.col("let_system_decide"), F.col("skills_selected")).alias("_done"),
    )
    categories = vault.select(*VERSIONED_EC).distinct().withColumn("_known", F.lit(True))
    return subs.join(known, "chat_id", "left").join(categories, VERSIONED_EC, "left")


def _version_status(active: Column) -> Column:
    return F.when(active.isNull(), F.lit("404 no active vault")).when(
        F.col("vault_version") != active, F.lit("409 version changed")
    )


def validate_employment(subs: DataFrame, state: DataFrame, vault: DataFrame, active: Column) -> DataFrame:
    """Status of each category submission ``(chat_id, ec_id, vault_version)`` against the state."""
    status = F.coalesce(
        _version_status(active),
        F.when(F.col("_ec").isNotNull(), F.lit("409 already set")),
        F.when(F.col("_known").isNull(), F.lit("400 invalid category")),
        F.lit("ok"),
    )
    return _checked(subs, state, vault).withColumn("status", status).drop("_ec", "_done", "_known")


def validate_skills(subs: DataFrame, state: DataFrame, vault: DataFrame, active: Column, max_select: int = 4) -> DataFrame:
    """Status of each skills submission ``(submission_id, chat_id, ec_id, vault_version,
    let_system_decide, skills_selected)``.

    Selected skills are checked by a join per skill; lists over the limit are refused before it.
    """
    size = F.coalesce(F.size("skills_selected"), F.lit(0))
    counted = size.between(1, max_select)
    asked = subs.filter(counted).select("submission_id", *VERSIONED_EC, F.explode(F.array_distinct("skills_selected")).alias("skill_id"))
    foreign = asked.join(vault, [*VERSIONED_EC, "skill_id"], "left_anti").select("submission_id").distinct()
    marked = _checked(subs, state, vault).join(foreign.withColumn("_foreign", F.lit(True)), "submission_id", "left")
    decide = F.coalesce("let_system_decide", F.lit(False))
    status = F.coalesce(
        _version_status(active),
        F.when(F.col("_known").isNull(), F.lit("400 invalid category")),
        F.when(F.col("_ec") != F.col("ec_id"), F.lit("400 category mismatch")),
        F.when(F.coalesce("_done", F.lit(False)), F.lit("409 already recorded")),
        F.when(decide, F.lit("ok system_decide")),
        F.when(~counted, F.lit("400 pick 1 to 4")),
        F.when(F.col("_foreign"), F.lit("400 foreign skill")),
        F.lit("ok manual"),
    )
    n = F.when(status == "ok manual", size).otherwise(0).cast("bigint")
    return marked.withColumn("status", status).withColumn("skills_count", n).drop("_ec", "_done", "_known", "_foreign")


# --- state ----------------------------------------------------------------------------------------


def fold_uia_state(events: DataFrame) -> DataFrame:
    """Latest intake state per chat from ``(chat_id, ts, event_id, kind, ec_id, skills, vault_version)``.

    A category event clears skills, a skills event sets them, a system-decide event clears them. All parts
    are maxima over the event order, so they are combined map-side and a busy chat costs no more than others.
    """
    is_kind = F.col("kind")
    applied = events.filter(is_kind.isin("set_ec", "set_skills", "system_decide"))
    folded = applied.groupBy("chat_id").agg(
        F.max(F.struct("ts", "event_id", "kind", "ec_id", "skills", "vault_version")).alias("last"),
        F.max(F.when(is_kind != "set_ec", F.struct("ts", "event_id", "kind"))).alias("last_choice"),
        F.min(F.struct("ts", "event_id", "kind")).alias("opened"),
    )
    return folded.select(
        "chat_id",
        F.col("last.ec_id").alias("employment_category_id"),
        F.when(F.col("last.kind") == "set_skills", F.col("last.skills")).alias("skills_selected"),
        F.coalesce(F.col("last_choice.kind") == "system_decide", F.lit(False)).alias("let_system_decide"),
        "last.vault_version",
        F.when(F.col("opened.kind") == "set_ec", F.col("opened.ts")).alias("recorded_at"),
        F.col("last.ts").alias("updated_at"),
    )


def uia_state_or_default(chats: DataFrame, state: DataFrame) -> DataFrame:
    """State of every chat asked for; an empty one where nothing is recorded."""
    joined = chats.select("chat_id").join(state, "chat_id", "left")
    return joined.withColumn("let_system_decide", F.coalesce("let_system_decide", F.lit(False)))


def prereq_gate(state: DataFrame) -> DataFrame:
    """Whether insight surveys may be built for a chat, and why not."""
    has_ec = F.coalesce(F.col("employment_category_id") != "", F.lit(False))
    done = skills_done(F.col("let_system_decide"), F.col("skills_selected"))
    return state.select(
        "chat_id",
        has_ec.alias("has_ec"),
        done.alias("has_skills"),
        (has_ec & done).alias("surveys_allowed"),
        F.when(~(has_ec & done), "prereqs_not_met").otherwise("").alias("skip_reason"),
    )
