"""Ingesting model replies around an answer: selection, sufficiency, plan, validation.

Replies arrive as a text column. Each function maps Columns to Columns and falls back the way the
caller would when the reply is not JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.modeljson import field, has_field, is_json_object
from ..functions.text import let, strip


def ingest_selection(reply: Column, candidates: Column, fallback_n: int = 10) -> Column:
    """Selected ids in the order given; the first candidates when the reply is not JSON."""
    chosen = F.coalesce(field(reply, "$.selected", "array<string>"), F.array().cast("array<string>"))
    return F.when(is_json_object(reply), chosen).otherwise(F.slice(candidates, 1, fallback_n))


def ingest_keep(reply: Column, ids: Column, cap: int = 12, mode: str = "live") -> Column:
    """Relevance filter. ``live`` passes all ids; ``strict`` keeps what the reply lists, else the first ``cap``."""
    if mode == "live":
        return ids
    kept = field(reply, "$.keep", "array<string>")
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(ids, 1, cap))


def dedupe_keep_order(ids: Column, top: int = 10) -> Column:
    return F.slice(F.array_distinct(ids), 1, max(12, top))


def sufficiency(reply: Column, kept_n: Column) -> Column:
    """Estimated coverage in 0..1; by the number of kept chunks when the reply cannot be read."""
    value = F.when(has_field(reply, "$.sufficiency"), field(reply, "$.sufficiency", "double")).otherwise(F.lit(0.5))
    read = F.when(is_json_object(reply), value)
    guessed = 0.4 + F.least(kept_n, F.lit(10)) * 0.05
    return let(F.coalesce(read, guessed), lambda s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def missing_aspects(reply: Column) -> Column:
    return F.coalesce(field(reply, "$.missing_aspects", "array<string>"), F.array().cast("array<string>"))


def allow_general(by_setting: Column, by_plan: Column, coverage: Column) -> Column:
    """General knowledge may be used when permitted and the evidence is thin."""
    return (by_setting | F.coalesce(by_plan, F.lit(False))) & (coverage < 0.7)


# Defaults of a query plan.
PLAN_DEFAULTS = {
    "link_prev": False,
    "why": "",
    "doc_filters": [],
    "style": "concise",
    "tone": "plain",
    "format": ["sections", "bullets"],
    "audience": "practitioner",
    "allow_general_knowledge": False,
    "notes": "",
}
PLAN_FAILED = "planner-json-parse-failed; defaulting to unrelated"


def _literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast("array<string>")
    return F.lit(value)


def plan_defaults(reply: Column, question: Column, mode: str = "live") -> Column:
    """Query plan struct. ``live`` keeps an explicit empty query list; ``older`` replaces it by the question
    and rescues quoted queries from a broken reply."""
    ok = is_json_object(reply)
    asked = F.array(question)

    def value(name: str, default, kind: str) -> Column:
        read = F.when(has_field(reply, f"$.{name}"), field(reply, f"$.{name}", kind)).otherwise(_literal(default))
        return F.when(ok, read).otherwise(_literal(default))

    columns = []
    for name, default in PLAN_DEFAULTS.items():
        kind = "boolean" if isinstance(default, bool) else "array<string>" if isinstance(default, list) else "string"
        column = value(name, default, kind)
        if mode == "live" and name == "why":
            column = F.when(ok, column).otherwise(F.lit(PLAN_FAILED))
        if mode == "older" and name == "notes":
            column = F.when(ok, column).otherwise(F.lit("fallback parse"))
        columns.append(column.alias(name))
    listed = field(reply, "$.queries", "array<string>")
    if mode == "live":
        queries = F.when(ok & has_field(reply, "$.queries"), listed).otherwise(asked)
    else:
        inner = F.regexp_extract(reply, r'(?s)"queries"\s*:\s*\[(.*?)\]', 1)
        rescued = F.regexp_extract_all(inner, F.lit('"([^"]+)"'), F.lit(1))
        queries = let(F.when(ok, listed).otherwise(rescued), lambda q: F.when(F.size(q) > 0, q).otherwise(asked))
    return F.struct(queries.alias("queries"), *columns)


# Fixed value: the note that introduces the previous question.
CONTEXT_NOTE = (
    "\n\n[Context from previous turn — use ONLY to clarify the current prompt; do NOT answer it independently.]\n"
    "Previous question: "
)


def compose_question(current: Column, previous: Column, link: Column) -> Column:
    """The question to answer, with the previous one attached when the plan links them."""

    def attach(prev: Column) -> Column:
        short = F.when(F.length(prev) > 500, F.concat(F.substring(prev, 1, 500), F.lit("..."))).otherwise(prev)
        return F.concat(current, F.lit(CONTEXT_NOTE), short)

    linked = F.coalesce((previous != "") & link, F.lit(False))
    return F.when(linked, let(strip(previous), attach)).otherwise(current)


def apply_validation(reply: Column, draft: Column) -> Column:
    """The reply's revision when it reports a problem and offers one, else the draft."""
    # A null verdict is no "yes"; only an absent one is taken for it.
    off_topic = ~F.coalesce(field(reply, "$.on_topic", "boolean"), ~has_field(reply, "$.on_topic"))
    contradicts = F.coalesce(field(reply, "$.contradiction", "boolean"), F.lit(False))
    revision = field(reply, "$.revision", "string")
    use = is_json_object(reply) & (off_topic | contradicts) & (F.coalesce(revision, F.lit("")) != "")
    return F.when(use, revision).otherwise(draft)
