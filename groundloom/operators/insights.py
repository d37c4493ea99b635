"""Insight vault and per-chat insight state.

The vault is a flat frame, one row per answer: ``batch_id, batch_name, batch_active, batch_pos, insight_id,
pos, question, is_multi, insight_active, answer_id, label, alias``. Only the answers of one insight are ever
gathered into an array. A batch may have a ``language``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import materialize
from .expansion import expand

# Fixed value: label of the write-in option.
OTHER_LABEL = "Other (write-in)"
TAKE_AT = 0.75
ASK_AT = 0.60
BATCH = ["batch_id", "batch_name", "batch_pos"]
INSIGHT = ["insight_id", "pos", "question", "is_multi"]
STATE_KEY = ["chat_id", "insight_id"]


def flatten_batches(batches: DataFrame) -> DataFrame:
    """Nested batch documents (answers as a map) to the flat form; aliases joined into one row each."""
    ins = batches.select(
        F.col("batchId").alias("batch_id"),
        F.col("name").alias("batch_name"),
        F.col("isActive").alias("batch_active"),
        F.col("position").alias("batch_pos"),
        (F.col("language") if "language" in batches.columns else F.lit(None).cast("string")).alias("language"),
        F.posexplode("insights").alias("pos", "i"),
    )
    answers = ins.select("*", F.explode("i.answers").alias("answer_id", "a"))
    return answers.select(
        "batch_id", "batch_name", "batch_active", "batch_pos", "language",
        F.col("i.insightId").alias("insight_id"), "pos", F.col("i.question").alias("question"),
        F.col("i.isMultiSelect").alias("is_multi"), F.col("i.isActive").alias("insight_active"),
        "answer_id", F.col("a.text").alias("label"), F.explode_outer("a.aliases").alias("alias"),
    )


# --- vault reads ----------------------------------------------------------------------------------


def of_version(vaults: DataFrame, version: str) -> DataFrame:
    """One version of a table of vaults; every read of the vault goes through it where the table has versions.

    The operators below take one version: rows of two would be merged into one vault.
    """
    return vaults.filter(F.col("vault_version") == version).drop("vault_version")


def active_batches(vault: DataFrame) -> DataFrame:
    return vault.filter("batch_active").select(*BATCH).distinct()


def known_batches(vault: DataFrame) -> DataFrame:
    """Ids of active batches; of a stored index those with active insights."""
    rows = vault if "answers" in vault.columns else vault.filter("batch_active")
    return rows.select("batch_id").distinct()


def active_answers(vault: DataFrame) -> DataFrame:
    return vault.filter("batch_active AND insight_active")


def insight_index(vault: DataFrame) -> DataFrame:
    """Active insights with their answers as a sorted array of (answer_id, label, aliases).

    An index is returned as it is, so every operator that takes the vault also takes a stored index.
    """
    if "answers" in vault.columns:
        return vault
    language = [c for c in ("language",) if c in vault.columns]
    per_answer = active_answers(vault).groupBy(*BATCH, *language, *INSIGHT, "answer_id").agg(
        F.first("label").alias("label"), F.array_sort(F.collect_set("alias")).alias("aliases")
    )
    return per_answer.groupBy(*BATCH, *language, *INSIGHT).agg(
        F.array_sort(F.collect_list(F.struct("answer_id", "label", "aliases"))).alias("answers")
    )


def vault_pack(vault: DataFrame, version: str | None = None) -> DataFrame:
    """The vault for a prompt: one JSON row for its version, one per batch and one per insight, in stored order.

    A batch without a language has no such field. The pieces stay rows, so the pack may be larger than one record; a consumer
    concatenates them.
    """
    index = insight_index(vault)
    fields = [F.col("batch_id").alias("batchId"), F.col("batch_name").alias("name")]
    kept = [*BATCH]
    if "language" in vault.columns:
        fields.append(F.nullif("language", F.lit("")).alias("language"))
        kept.append("language")
    none = F.lit(-1).cast("bigint")
    batches = vault.filter("batch_active").select(*kept).distinct()
    batches = batches.select(F.lit("batches").alias("part"), "batch_pos", none.alias("pos"), F.to_json(F.struct(*fields)).alias("json"))
    answers = F.map_from_entries(
        F.transform("answers", lambda a: F.struct(a.answer_id, F.struct(a.label.alias("text"), a.aliases.alias("aliases"))))
    )
    insights = index.select(
        F.lit("insights").alias("part"),
        "batch_pos",
        F.col("pos").cast("bigint").alias("pos"),
        F.to_json(
            F.struct(
                F.col("insight_id").alias("insightId"),
                F.col("batch_id").alias("batchId"),
                "question",
                answers.alias("answers"),
                F.col("is_multi").alias("isMultiSelect"),
                F.lit(True).alias("isActive"),
            )
        ).alias("json"),
    )
    pack = batches.union(insights)
    if version is None:
        return pack
    head = vault.sparkSession.range(1).select(F.lit("vault"), none, none, F.to_json(F.struct(F.lit(version).alias("vaultVersion"))))
    return pack.union(head)


def validate_insight_answer(claims: DataFrame, vault: DataFrame) -> DataFrame:
    """Batch and arity of claimed ``(insight_id, answer_id)`` where both exist; an absent answer id is not checked."""
    index = insight_index(vault).select("insight_id", "batch_id", "is_multi", F.col("answers.answer_id").alias("_ids"))
    ok = F.col("_ids").isNotNull() & (F.col("answer_id").isNull() | F.array_contains("_ids", F.col("answer_id")))
    joined = claims.join(index, "insight_id", "left")
    return joined.withColumns(
        {"batch_id": F.when(ok, F.col("batch_id")), "is_multi": F.when(ok, F.col("is_multi")), "valid": F.coalesce(ok, F.lit(False))}
    ).drop("_ids")


def batches_in_order(vault: DataFrame) -> DataFrame:
    """Active insights with the stored place of their batch and their 1-based place within it.

    Batches without active insights do not appear.
    """
    w = W.partitionBy("batch_id").orderBy("pos")
    return insight_index(vault).withColumn("insight_no", F.row_number().over(w))


def vault_readiness(vaults: DataFrame, version: str) -> DataFrame:
    """``ready`` when the version has an active row, else why not. ``vaults`` has vault_version, batch_active."""
    counts = vaults.agg(
        F.count("*").alias("n"), F.count_if((F.col("vault_version") == version) & F.col("batch_active")).alias("n_ready")
    )
    status = F.when(F.col("n_ready") > 0, "ready").when(F.col("n") == 0, "collection is empty").otherwise("version not found")
    return counts.select(F.lit(version).alias("vault_version"), status.alias("status"))


# --- decisions ------------------------------------------------------------------------------------


def parse_answer_ids(raw: Column, valid: Column) -> Column:
    """Valid ids of a delimited string, upper-cased, first occurrences in order."""
    parts = F.split(F.upper(strip(raw)), r"[|,/\s]+")
    return F.coalesce(
        F.array_distinct(F.filter(parts, lambda p: (p != "") & (p != "NULL") & F.array_contains(valid, p))),
        F.array().cast("array<string>"),
    )


def single_answer_id(raw: Column, valid: Column) -> Column:
    """First valid id; only a delimited value is upper-cased, and ``null`` in any case means none."""
    given = F.when(F.lower(raw) != "null", raw)
    listed = F.get(parse_answer_ids(given, valid), F.lit(0))
    return F.when(given.rlike("[|, /]"), listed).otherwise(F.when(F.array_contains(valid, given), given))


def judge_decisions(decisions: DataFrame, vault: DataFrame) -> DataFrame:
    """Outcome of each decision by itself, before looking at what the chat has already taken.

    ``decisions``: event_id, chat_id, ts, pass_id, insight_id, batch_id, match_type, answer_raw, confidence.
    """
    index = insight_index(vault).select(
        "insight_id", F.col("batch_id").alias("_batch"), "is_multi", F.col("answers.answer_id").alias("_ids")
    )
    joined = decisions.join(index, "insight_id", "left")
    multi = F.col("is_multi")
    parsed = joined.withColumns(
        {
            "answer_id": F.when(~multi, single_answer_id(F.col("answer_raw"), F.col("_ids"))),
            "answer_ids": F.when(multi, parse_answer_ids(F.col("answer_raw"), F.col("_ids"))),
        }
    )
    answered = F.when(multi, F.size("answer_ids") > 0).otherwise(F.col("answer_id").isNotNull())
    takes = F.col("match_type").isin("QUESTION_AND_ANSWER", "ANSWER_ONLY")
    asks = F.col("match_type") == "QUESTION_ONLY"
    judged = (
        F.when(F.col("_batch").isNull(), "unknown_insight")
        .when(F.col("_batch") != F.col("batch_id"), "batch_mismatch")
        .when(~(takes | asks), "bad_match_type")
        .when(takes & (F.col("confidence") >= TAKE_AT), F.when(answered, "take").otherwise("no_valid_answer"))
        .when(asks & (F.col("confidence") >= ASK_AT), "question_only")
        .otherwise("below_threshold")
    )
    mode = F.when(F.col("match_type") == "QUESTION_AND_ANSWER", "qa").otherwise("answer_only")
    taken = F.col("status") == "take"
    return (
        parsed.withColumn("status", judged)
        .withColumns(
            {
                "mode": F.when(taken, mode),
                "answer_id": F.when(taken, F.col("answer_id")),
                "answer_ids": F.when(taken, F.col("answer_ids")),
            }
        )
        .drop("_batch", "_ids", "is_multi")
    )


def first_taken(judged: DataFrame, surveys: DataFrame | None = None) -> DataFrame:
    """Per chat and insight the earliest point from which it counts as taken.

    Within a pass the last accepted decision stands; a pass takes the insight when that one is a take.
    ``surveys`` adds (chat_id, insight_id, seq).
    """
    accepted = judged.filter(F.col("status").isin("take", "question_only"))
    standing = accepted.groupBy(*STATE_KEY, "pass_id").agg(F.max_by("status", "event_id").alias("kept"))
    taken = standing.filter("kept = 'take'").select(*STATE_KEY, F.col("pass_id").cast("double").alias("seq"))
    if surveys is not None:
        taken = taken.union(surveys.select(*STATE_KEY, F.col("seq").cast("double")))
    return taken.groupBy(*STATE_KEY).agg(F.min("seq").alias("taken_from"))


def apply_decisions(decisions: DataFrame, vault: DataFrame, surveys: DataFrame | None = None) -> DataFrame:
    """Every decision with its final status and whether it touches its batch.

    A valid decision on an insight taken in an earlier pass touches the batch and changes nothing. The set
    form needs one small aggregate per (chat, insight, pass) and one join back, no ordered window.
    """
    return settle_decisions(judge_decisions(decisions, vault), surveys)


def settle_decisions(judged: DataFrame, surveys: DataFrame | None = None) -> DataFrame:
    """The second half of :func:`apply_decisions`, for judged decisions that are stored."""
    joined = judged.join(first_taken(judged, surveys), STATE_KEY, "left")
    known = ~F.col("status").isin("unknown_insight", "batch_mismatch")
    already = known & (F.coalesce(F.col("taken_from"), F.lit(float("inf"))) < F.col("pass_id"))
    status = F.when(already, "already_taken").otherwise(F.col("status"))
    cleared = {c: F.when(~already, F.col(c)) for c in ("answer_id", "answer_ids", "mode")}
    return (
        joined.withColumns(cleared)
        .withColumn("status", status)
        .withColumn("touched", F.col("status").isin("already_taken", "take", "question_only"))
        .drop("taken_from")
    )


def decision_counts(applied: DataFrame) -> DataFrame:
    """Accepted decisions per chat and pass."""
    return applied.groupBy("chat_id", "pass_id").agg(
        F.count_if(F.col("status") == "take").alias("auto_taken_count"),
        F.count_if(F.col("status") == "question_only").alias("question_only_count"),
    )


def fold_insight_state(applied: DataFrame, surveys: DataFrame | None = None) -> DataFrame:
    """One row per (chat, insight): the last write that counted.

    ``surveys``: chat_id, insight_id, batch_id, seq, event_id, ts, answer_id, answer_ids. The fold is a maximum
    over write order, combined map-side, so a chat with very many events is no hot spot. Decisions and surveys may carry the
    ``evidence`` and the ``vault_version`` that they rest on; the row has those of its last write.
    """

    def meta(rows: DataFrame) -> list[Column]:
        kinds = (("evidence", "array<string>"), ("vault_version", "string"))
        return [F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds]

    rows = applied.filter(F.col("status").isin("take", "question_only"))
    writes = rows.select(
        *STATE_KEY, "batch_id", F.col("pass_id").cast("double").alias("seq"), "event_id", "ts",
        F.when(F.col("status") == "take", True).alias("taken"), "answer_id", "answer_ids",
        F.when(F.col("status") == "question_only", "question_only").alias("pending_reason"),
        F.lit("auto-inference").alias("source"), "mode", "confidence", *meta(rows),
    )
    if surveys is not None:
        none = F.lit(None).cast("string")
        writes = writes.unionByName(
            surveys.select(
                *STATE_KEY, "batch_id", F.col("seq").cast("double"), "event_id", "ts", F.lit(True).alias("taken"),
                "answer_id", "answer_ids", none.alias("pending_reason"), F.lit("survey").alias("source"),
                none.alias("mode"), F.lit(1.0).alias("confidence"), *meta(surveys),
            )
        )
    write = F.struct("seq", "event_id", "ts", "batch_id", "taken", "answer_id", "answer_ids", "pending_reason", "source", "mode", "confidence", "evidence", "vault_version")
    folded = writes.groupBy(*STATE_KEY).agg(
        F.max(write).alias("w"), F.min(F.struct("seq", "event_id", "ts")).alias("first")
    )
    return folded.select(
        *STATE_KEY, "w.batch_id", "w.taken", "w.answer_id", "w.answer_ids", "w.pending_reason", "w.source", "w.mode",
        "w.confidence", "w.evidence", "w.vault_version", F.col("first.ts").alias("created_at"), F.col("w.ts").alias("updated_at"),
    )


def touched_batches(applied: DataFrame) -> DataFrame:
    """Distinct touched batches, one row per (chat, batch)."""
    return applied.filter("touched").select("chat_id", "batch_id").distinct()


def batch_expand(touched: DataFrame, vault: DataFrame, state: DataFrame) -> DataFrame:
    """Pending rows for the active insights of touched batches that have no row yet.

    A touched batch adds a row per insight, far more than there are decisions; the rows are opened in place and never shuffled.
    """
    filled = _filled(touched.select("chat_id", "batch_id"), _placed(insight_index(vault).select("batch_id", "insight_id", "pos")), state)
    return filled.select(
        *STATE_KEY, "batch_id", F.lit("batch_fill").alias("pending_reason"), F.lit("batch-expansion").alias("source"), F.lit(1.0).alias("confidence")
    )


def _placed(items: DataFrame) -> DataFrame:
    """Insights with their place in the batch, from 0 in stored order. The vault alone passes through, not the chats."""
    place = F.row_number().over(W.partitionBy("batch_id").orderBy("pos", "insight_id")) - 1
    return materialize(items.withColumn("_place", place), "places")


def _known(items: DataFrame, state: DataFrame) -> DataFrame:
    """Per (chat, batch) the places of the insights that the chat has a row of."""
    own = state.select(*STATE_KEY).distinct().join(items.select("batch_id", "insight_id", "_place"), "insight_id")
    return own.groupBy("chat_id", "batch_id").agg(F.collect_list("_place").alias("_known"))


def _filled(touched: DataFrame, items: DataFrame, state: DataFrame) -> DataFrame:
    """``touched`` with the items of each batch that the chat has no row of, numbered from 1 in ``_no``."""
    none = F.array().cast("array<int>")
    rows = touched.join(_known(items, state), ["chat_id", "batch_id"], "left").withColumn("_known", F.coalesce("_known", none))
    filled = expand(rows, items, ["batch_id"]).where(~F.array_contains("_known", F.col("_place")))
    before = F.size(F.filter("_known", lambda k: k < F.col("_place")))
    return filled.withColumn("_no", F.col("_place") - before + 1).drop("_known")


def _added(touched: DataFrame, index: DataFrame, state: DataFrame) -> DataFrame:
    """The number ``n`` of rows that :func:`batch_expand` adds per (chat, batch), counted without them; none are left out."""
    totals = index.groupBy("batch_id").agg(F.count("*").alias("n"))
    own = state.select(*STATE_KEY).distinct().join(index.select("batch_id", "insight_id"), "insight_id")
    held = own.groupBy("chat_id", "batch_id").agg(F.count("*").alias("_held"))
    counted = touched.select("chat_id", "batch_id").join(totals, "batch_id").join(held, ["chat_id", "batch_id"], "left")
    return counted.select("chat_id", "batch_id", (F.col("n") - F.coalesce("_held", F.lit(0))).alias("n")).where("n > 0")


@dataclass(frozen=True)
class ExpandedState:
    """State after batch expansion, with the pending rows that expansion adds left unwritten.

    These are as many as chats times insights. Every read of the state below takes this form as well as the rows: counts follow from
    ``folded``, the rows that were written, and the distinct ``touched`` batches; only reads that return the rows open them.
    """

    folded: DataFrame
    touched: DataFrame
    index: DataFrame

    def rows(self) -> DataFrame:
        return self.folded.unionByName(batch_expand(self.touched, self.index, self.folded), allowMissingColumns=True)

    def added(self) -> DataFrame:
        return _added(self.touched, self.index, self.folded)


def expanded_state(state: DataFrame, touched: DataFrame, vault: DataFrame) -> ExpandedState:
    return ExpandedState(state, touched, insight_index(vault))


# --- state reads ----------------------------------------------------------------------------------


def pending_by_batch(state: DataFrame | ExpandedState, touched: DataFrame) -> DataFrame:
    """Pending rows of the touched batches; of all batches for chats that touched none."""
    in_touched = touched.select("chat_id", "batch_id").withColumn("_hit", F.lit(True))
    any_touched = touched.select("chat_id").distinct().withColumn("_any", F.lit(True))

    def wanted(rows: DataFrame) -> DataFrame:
        joined = rows.join(any_touched, "chat_id", "left").join(in_touched, ["chat_id", "batch_id"], "left")
        return joined.filter(F.col("_any").isNull() | F.col("_hit")).drop("_any", "_hit")

    columns = ["chat_id", "batch_id", "insight_id", "pending_reason", "confidence"]
    written = state.folded if isinstance(state, ExpandedState) else state
    pending = wanted(written.filter("taken IS NULL").select(*columns))
    if isinstance(state, ExpandedState):
        return pending.unionByName(batch_expand(wanted(state.touched), state.index, state.folded).select(*columns))
    return pending


def insight_stats(state: DataFrame | ExpandedState) -> DataFrame:
    if isinstance(state, ExpandedState):
        written = state.folded.select("chat_id", "taken", F.lit(1).cast("bigint").alias("n"))
        rows = written.unionByName(state.added().select("chat_id", F.lit(None).cast("boolean").alias("taken"), "n"))
    else:
        rows = state.select("chat_id", "taken", F.lit(1).cast("bigint").alias("n"))
    taken = F.when(F.coalesce("taken", F.lit(False)), F.col("n")).otherwise(0)
    pending = F.when(F.col("taken").isNull(), F.col("n")).otherwise(0)
    return rows.groupBy("chat_id").agg(F.sum(taken).alias("taken_count"), F.sum(pending).alias("pending_count"))


def build_surveys(state: DataFrame | ExpandedState, touched: DataFrame, vault: DataFrame, questions: bool = True) -> DataFrame:
    """Follow-up questions per touched batch, one row per question in asking order.

    Question-only items come first, then by confidence; ties keep vault order. The options of one question
    are a JSON list; a write-in may always be given instead. A batch without a language is asked in English.
    Without ``questions`` one row per survey, ``(chat_id, batch_id, questions)`` with the number of its questions.
    """
    options = F.to_json(F.transform("answers", lambda a: F.struct(a.answer_id.alias("answerId"), a.label.alias("label"))))
    index = insight_index(vault)
    language = F.col("language") if "language" in index.columns else F.lit(None).cast("string")
    defs = index.select(
        "batch_id", "insight_id", "pos", F.coalesce(F.nullif(language, F.lit("")), F.lit("en")).alias("language"), F.concat("batch_name", F.lit(" (Follow-up)")).alias("title"), "question",
        F.when(F.col("is_multi"), "multi").otherwise("single").alias("type"), options.alias("options"),
    )
    open_batches = touched.select("chat_id", "batch_id")
    key = ["chat_id", "batch_id"]
    lazy = isinstance(state, ExpandedState)
    written = state.folded if lazy else state
    asked = written.filter("taken IS NULL").join(open_batches, key, "left_semi").join(defs, ["batch_id", "insight_id"])
    first = F.when(F.col("pending_reason") == "question_only", 0).otherwise(1)
    w = W.partitionBy(*key).orderBy(first, F.desc("confidence"), "pos")
    shown = [*key, "title", "language", "insight_id", "question", "type", "options"]

    def made(rows: DataFrame, number: Column) -> DataFrame:
        return rows.select(*shown, F.lit(True).alias("include_other"), F.lit(OTHER_LABEL).alias("other_label"), number.cast("int").alias("question_no"))

    if not lazy:
        return made(asked, F.row_number().over(w)) if questions else asked.groupBy(*key).agg(F.count("*").alias("questions"))
    filling = state.touched.join(open_batches, key, "left_semi")
    items = state.index.select("batch_id", "insight_id").join(defs, ["batch_id", "insight_id"])
    if not questions:
        counts = asked.select(*key, F.lit(1).cast("bigint").alias("n")).unionByName(_added(filling, items, state.folded))
        return counts.groupBy(*key).agg(F.sum("n").alias("questions"))
    # Added rows rank as ones of confidence 1 that are not question-only: each list is numbered by itself, then moved by the rows of the other before it.
    items = _placed(items)
    confidence = F.col("confidence")
    ahead, level = (first == 0) | (confidence > 1.0), (first == 1) & (confidence == 1.0)
    heads = asked.groupBy(*key).agg(F.count_if(ahead).alias("_ahead"), F.collect_list(F.when(level, F.struct("pos"))).alias("_level"))
    none = F.array().cast(heads.schema["_level"].dataType)
    with_heads = filling.join(heads, key, "left").withColumns({"_ahead": F.coalesce("_ahead", F.lit(0)), "_level": F.coalesce("_level", none)})
    moved = F.col("_ahead") + F.size(F.filter("_level", lambda x: x.pos <= F.col("pos")))
    added = made(_filled(with_heads, items, state.folded), F.col("_no") + moved)
    places = items.groupBy("batch_id", "pos").agg(F.min("_place").alias("_at"))
    totals = items.groupBy("batch_id").agg(F.count("*").alias("_total"))
    own = asked.join(places, ["batch_id", "pos"], "left").join(totals, "batch_id", "left").join(_known(items, state.folded), key, "left")
    own = own.join(filling.withColumn("_filled", F.lit(True)), key, "left")
    at = F.coalesce("_at", F.lit(0))
    before = F.when(F.coalesce(ahead, F.lit(False)) | F.col("_filled").isNull(), 0).when(level, at - F.size(F.filter("_known", lambda k: k < at))).otherwise(F.col("_total") - F.size("_known"))
    return made(own, F.row_number().over(w) + before).unionByName(added)


def submit_survey(responses: DataFrame, vault: DataFrame) -> DataFrame:
    """Status of each response and of its whole submission, which stands or falls as a unit.

    ``responses``: submission_id, batch_id, insight_id, answer_id or answer_ids.
    """
    index = insight_index(vault).select(
        "insight_id", F.col("batch_id").alias("_of"), "is_multi", F.col("answers.answer_id").alias("_ids")
    )
    batches = known_batches(vault).withColumn("_batch", F.lit(True))
    joined = responses.join(batches, "batch_id", "left").join(index, "insight_id", "left")
    listed = F.coalesce(F.size("answer_ids"), F.lit(0)) > 0
    status = (
        F.when(F.col("_batch").isNull(), "unknown_batch")
        .when(F.col("_of").isNull() | (F.col("_of") != F.col("batch_id")), "insight_not_in_batch")
        .when(F.col("answer_id").isNotNull() == listed, "not_exactly_one")
        .when(F.col("is_multi") & ~listed, "expects_multiple")
        .when(F.col("is_multi"), F.when(F.forall("answer_ids", lambda a: F.array_contains("_ids", a)), "ok").otherwise("invalid_answer"))
        .when(F.array_contains("_ids", F.col("answer_id")), "ok")
        .otherwise("invalid_answer")
    )
    checked = joined.withColumn("status", status).drop("_of", "_ids", "_batch")
    whole = checked.groupBy("submission_id").agg(F.min(F.col("status") == "ok").alias("accepted"))
    return checked.join(whole, "submission_id")


def state_quality(state: DataFrame | ExpandedState) -> DataFrame:
    """Violations of the row rules and of key uniqueness, counted per rule.

    An added row has no answer, and its key is new: insights that the index has once, of chats with an id, are counted without
    opening them. The others, whose keys may meet, are checked row by row.
    """
    plain = None
    if isinstance(state, ExpandedState):
        often = state.index.groupBy("insight_id").agg(F.count("*").alias("_n"))
        once = state.index.join(often.where("_n = 1").select("insight_id"), "insight_id", "left_semi")
        others = state.index.join(once.select("insight_id").distinct(), "insight_id", "left_anti")
        known, nameless = state.touched.where("chat_id IS NOT NULL"), state.touched.where("chat_id IS NULL")
        plain = _added(known, once, state.folded).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_plain"))
        opened = batch_expand(known, others, state.folded).unionByName(batch_expand(nameless, state.index, state.folded))
        state = state.folded.unionByName(opened, allowMissingColumns=True)
    single = F.col("answer_id").isNotNull()
    multi = F.coalesce(F.size("answer_ids"), F.lit(0)) > 0
    pending = F.col("taken").isNull()
    per_key = state.groupBy(*STATE_KEY).agg(
        F.count("*").alias("n"),
        F.count_if(pending & (single | multi)).alias("pending_with_answer"),
        F.count_if(~pending & (single == multi)).alias("taken_without_one_answer"),
    )
    totals = per_key.agg(
        F.sum("pending_with_answer").alias("pending_with_answer"),
        F.sum("taken_without_one_answer").alias("taken_without_one_answer"),
        F.count_if(F.col("n") > 1).alias("duplicate_key"),
        F.sum("n").alias("rows"),
    )
    if plain is not None:
        totals = totals.withColumn("rows", F.coalesce("rows", F.lit(0)) + plain.scalar())
    names = ["pending_with_answer", "taken_without_one_answer", "duplicate_key", "rows"]
    return totals.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(n, F.lit(0)).alias("violations")) for n in names])))


def batch_ranks(vault: DataFrame) -> DataFrame:
    """Batches with active insights and the number of these, ranked from 1 in stored order.

    One row per batch passes through the ranking task, an id and two numbers each.
    """
    places = insight_index(vault).groupBy("batch_id").agg(F.min("batch_pos").alias("batch_pos"), F.count("*").alias("total"))
    return places.withColumn("rank", F.row_number().over(W.orderBy("batch_pos", "batch_id")))


def untouched_ranks(state: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per chat the batches in which it has no row, as intervals ``(chat_id, first_rank, last_rank)``: the gaps between its ranks.

    ``state`` has the chats and their batches, ``ranks`` is :func:`batch_ranks`.
    """
    last = ranks.agg(F.max("rank")).first()[0] or 0
    seen = state.select("chat_id", "batch_id").distinct().join(ranks.select("batch_id", "rank"), "batch_id").select("chat_id", "rank")
    ends = state.select("chat_id").distinct().withColumn("rank", F.lit(0))
    following = F.lead("rank", 1, last + 1).over(W.partitionBy("chat_id").orderBy("rank"))
    gaps = seen.unionByName(ends).select("chat_id", (F.col("rank") + 1).alias("first_rank"), (following - 1).alias("last_rank"))
    return gaps.where("first_rank <= last_rank")


def batch_completion(state: DataFrame | ExpandedState, vault: DataFrame, dense: bool = False) -> DataFrame:
    """Totals per (chat, batch) for the batches a chat has rows in; with ``dense`` also for all others, where it has taken nothing.

    Only active insights count, and batches without any do not appear. The others are the gaps between a chat's batches, expanded in
    place; chats and batches are not paired.
    """
    index = insight_index(vault).select("batch_id", "insight_id")
    ranks = materialize(batch_ranks(vault), "batch-ranks")
    written = state.folded if isinstance(state, ExpandedState) else state
    rows = written.select(*STATE_KEY, "taken").join(index, "insight_id").select("chat_id", "batch_id", "taken")
    seen = written.select("chat_id")
    if isinstance(state, ExpandedState):
        # Added rows have taken nothing: a chat has some in each batch that an insight of a touched batch belongs to.
        own = state.index.select(F.col("batch_id").alias("_from"), "insight_id").join(index, "insight_id").select("_from", "batch_id").distinct()
        added = state.added().select("chat_id", F.col("batch_id").alias("_from"))
        rows = rows.unionByName(added.join(own, "_from").select("chat_id", "batch_id", F.lit(None).cast("boolean").alias("taken")))
        seen = seen.unionByName(added.select("chat_id"))
    taken = F.count_if(F.coalesce("taken", F.lit(False))).alias("taken")
    counted = rows.groupBy("chat_id", "batch_id").agg(taken)
    done = counted.join(ranks.select("batch_id", "total"), "batch_id").withColumn("is_complete", F.col("taken") == F.col("total"))
    if not dense:
        return done
    counted = materialize(done, "completion")
    chats = seen.distinct().withColumn("batch_id", F.lit(None).cast("string"))
    gaps = untouched_ranks(counted.select("chat_id", "batch_id").unionByName(chats), ranks)
    open_ranks = gaps.select("chat_id", F.explode(F.sequence("first_rank", "last_rank")).alias("rank"))
    none = open_ranks.join(ranks.select("rank", "batch_id", "total"), "rank")
    return counted.unionByName(none.select("chat_id", "batch_id", F.lit(0).cast("bigint").alias("taken"), "total", F.lit(False).alias("is_complete")))


def fully_taken_batches(state: DataFrame | ExpandedState, vault: DataFrame) -> DataFrame:
    return batch_completion(state, vault).filter("is_complete").select("chat_id", "batch_id")


def survey_message_progress(messages: DataFrame, submissions: DataFrame) -> DataFrame:
    """Submitted batches of each survey message and whether all of them are in.

    ``messages`` is (msg_id, batch_id), one row per batch of the survey; ``submissions`` is (msg_id, batch_id, ts)
    and the latest one per batch counts.
    """
    latest = submissions.groupBy("msg_id", "batch_id").agg(F.max("ts").alias("submitted_at"))
    joined = messages.select("msg_id", "batch_id").distinct().join(latest, ["msg_id", "batch_id"], "left")
    return joined.groupBy("msg_id").agg(
        F.count("*").alias("batches"),
        F.count("submitted_at").alias("submitted"),
        F.max("submitted_at").alias("last_submitted_at"),
        (F.count("*") == F.count("submitted_at")).alias("is_submitted"),
    )
