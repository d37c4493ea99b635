"""Choosing and wording the next question.

Text is matched against labels and aliases as lower-case substrings. Texts and phrases meet through
:func:`phrase_hits`, which never forms all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.modeljson import extract_json_object, field
from ..functions.text import is_generic_answer, let, oxford_join, strip
from ..session import materialize
from .expansion import expand
from .insights import active_answers, batch_ranks, insight_index

ASK = ["chat_id", "turn"]
#: Characters of the phrases that one automaton holds, about.
SHARD_CHARS = 1 << 21


def phrase_hits(texts: DataFrame, phrases: DataFrame, keys: list[str] = ASK) -> DataFrame:
    """(keys, phrase) for every distinct ``phrase`` that occurs in the lower-cased ``text``.

    Phrases are cut by hash into shards of about ``SHARD_CHARS`` characters, each small enough to be sent to every task. A task
    builds an Aho-Corasick automaton of a shard and runs over each of its texts once, whatever phrases share their beginnings. Texts
    are not shuffled; they are read once per shard.
    """
    wanted = materialize(phrases.select(F.lower("phrase").alias("phrase")).filter("phrase <> ''").distinct(), "phrases")
    total = wanted.agg(F.sum(F.char_length("phrase"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_CHARS))
    lowered = texts.select(*keys, F.lower("text").alias("_text")).where("_text <> ''")
    kinds = ", ".join(f"`{c}` {lowered.schema[c].dataType.simpleString()}" for c in keys)
    found = None
    for shard in range(shards):
        own = wanted if shards == 1 else wanted.where(F.pmod(F.xxhash64("phrase"), F.lit(shards)) == shard)
        sent = texts.sparkSession.sparkContext.broadcast([r["phrase"] for r in own.collect()])
        hits = lowered.mapInArrow(_occurrences(sent, len(keys)), f"{kinds}, phrase string")
        found = hits if found is None else found.unionByName(hits)
    return found


def _occurrences(sent, width: int):
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase in sent.value:
            automaton.add_word(phrase, phrase)
        if not len(automaton):
            return
        automaton.make_automaton()
        for batch in batches:
            rows, phrases = [], []
            for row, text in enumerate(batch.column(width).to_pylist()):
                for phrase in {p for _, p in automaton.iter(text)}:
                    rows.append(row)
                    phrases.append(phrase)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(width)), pa.array(phrases, pa.string())], names=[*batch.schema.names[:width], "phrase"])

    return run


def label_tokens(label: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9+]+"), lambda t: t != "")


def said_phrases(asks: DataFrame, phrases: DataFrame, group: str) -> DataFrame:
    """(keys, group, said): the sorted phrases of the ask's group that its text has; asks without any are left out.

    ``phrases`` is (group, phrase). What asks of one group with equal lists find in it is the same, so it is looked up once per list.
    """
    hits = phrase_hits(asks, phrases).join(asks.select(*ASK, group), ASK)
    own = hits.join(phrases.select(group, "phrase").distinct(), [group, "phrase"], "left_semi")
    return own.groupBy(*ASK, group).agg(F.array_sort(F.collect_list("phrase")).alias("said"))


def _with_said(asks: DataFrame, said: DataFrame, group: str) -> DataFrame:
    """Keys and group of all asks with what they say, an empty list where that is nothing."""
    joined = asks.select(*ASK, group).join(said, [*ASK, group], "left")
    return materialize(joined.withColumn("said", F.coalesce("said", F.array().cast("array<string>"))), "said")


def shortlist(asks: DataFrame, options: DataFrame, k: int = 4) -> DataFrame:
    """Top ``k`` options of each ask's list by label tokens found in the text; ties keep list order.

    ``asks``: chat_id, turn, list_id, text. ``options``: list_id, id, label, pos. Options without a hit are
    only needed to fill up, and the first ``k`` of a list are enough for that. Options of a list with equal tokens score alike, so
    the first ``k`` of them stand for all; asks of a list that say the same tokens share their ranks.
    """
    tokens = options.select("list_id", "id", F.explode(label_tokens(F.col("label"))).alias("phrase"))
    kinds = materialize(tokens.groupBy("list_id", "id").agg(F.array_sort(F.collect_list("phrase")).alias("kind")), "kinds")
    alike = W.partitionBy("list_id", "kind").orderBy("pos")
    stand = options.select("list_id", "id", "pos").join(kinds, ["list_id", "id"]).withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= k)
    weighed = kinds.select("list_id", "kind").distinct().select("list_id", "kind", F.explode("kind").alias("phrase")).groupBy("list_id", "kind", "phrase").agg(F.count("*").alias("n"))
    said = _with_said(asks, said_phrases(asks, weighed.select("list_id", "phrase"), "list_id"), "list_id")
    sets = said.select("list_id", "said").distinct()
    scored = sets.select("list_id", "said", F.explode("said").alias("phrase")).join(weighed, ["list_id", "phrase"]).groupBy("list_id", "said", "kind").agg(F.sum("n").alias("score"))
    found = scored.join(stand.select("list_id", "kind", "id"), ["list_id", "kind"]).select("list_id", "said", "id", "score")
    first = W.partitionBy("list_id").orderBy("pos")
    spare = options.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).select("list_id", "id")
    filler = sets.join(spare, "list_id").select("list_id", "said", "id", F.lit(0).cast("bigint").alias("score"))
    best = found.unionByName(filler).groupBy("list_id", "said", "id").agg(F.max("score").alias("score"))
    of_set = W.partitionBy("list_id", "said").orderBy(F.desc("score"), "pos")
    top = best.join(options, ["list_id", "id"]).withColumn("_n", F.row_number().over(of_set)).filter(F.col("_n") <= k).drop("_n")
    w = W.partitionBy(*ASK).orderBy(F.desc("score"), "pos")
    rest = [c for c in options.columns if c not in ("list_id", "id")]
    ranked = said.distinct().join(top, ["list_id", "said"]).select("list_id", "id", *ASK, "score", *rest).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k)


def _phrases(vault: DataFrame) -> DataFrame:
    """Labels (weight 2) and aliases (weight 1) of active answers, lower-cased."""
    answers = active_answers(vault)
    labels = answers.select("batch_id", "insight_id", "pos", "answer_id", F.lower("label").alias("phrase"), F.lit(2).alias("weight")).distinct()
    aliases = answers.select("batch_id", "insight_id", "pos", "answer_id", F.lower("alias").alias("phrase"), F.lit(1).alias("weight"))
    return labels.union(aliases).filter("phrase <> ''")


@dataclass(frozen=True)
class Relevance:
    """Scores by what is said: asks of one batch that say the same phrases share them.

    An ask may find something in every answer of its batch, so the rows are far more than the asks and the answers; only reads that
    return them open them.
    """

    said: DataFrame  # keys, batch_id, said
    scores: DataFrame  # batch_id, said, insight_id, pos[, answer_id], score

    def rows(self) -> DataFrame:
        return expand(self.said, self.scores, ["batch_id", "said"]).drop("said")


def shared_answer_relevance(asks: DataFrame, vault: DataFrame) -> Relevance:
    phrases = _phrases(vault)
    said = materialize(said_phrases(asks, phrases, "batch_id"), "said")
    each = said.select("batch_id", "said").distinct().select("batch_id", "said", F.explode("said").alias("phrase"))
    scores = each.join(phrases, ["batch_id", "phrase"]).groupBy("batch_id", "said", "insight_id", "pos", "answer_id").agg(F.sum("weight").alias("score"))
    return Relevance(said, scores)


def shared_insight_relevance(asks: DataFrame, vault: DataFrame) -> Relevance:
    answers = shared_answer_relevance(asks, vault)
    return Relevance(answers.said, answers.scores.groupBy("batch_id", "said", "insight_id", "pos").agg(F.sum("score").alias("score")))


def answer_relevance(asks: DataFrame, vault: DataFrame, shared: bool = False) -> DataFrame | Relevance:
    """Score of every answer of the ask's batch that the text mentions; absent rows score nothing.

    ``asks``: chat_id, turn, batch_id, text. With ``shared`` the scores are left by what is said, see :class:`Relevance`.
    """
    found = shared_answer_relevance(asks, vault)
    return found if shared else found.rows()


def insight_relevance(asks: DataFrame, vault: DataFrame, shared: bool = False) -> DataFrame | Relevance:
    found = shared_insight_relevance(asks, vault)
    return found if shared else found.rows()


def with_unmentioned(scores: DataFrame | Relevance, asks: DataFrame, vault: DataFrame) -> DataFrame:
    """Scores of all answers (or, from :func:`insight_relevance`, all insights) of each ask's batch, 0 where nothing is mentioned.

    An ask meets the answers of its own batch only; one of a closed batch has none.
    """
    held = scores.scores if isinstance(scores, Relevance) else scores
    level = [c for c in ("answer_id",) if c in held.columns]
    known = active_answers(vault).select("batch_id", "insight_id", "pos", *level).distinct()
    keys = [*ASK, "batch_id", "insight_id", "pos", *level]
    if not isinstance(scores, Relevance):
        every = asks.select(*ASK, "batch_id").join(known, "batch_id")
        return every.join(scores, keys, "left").withColumn("score", F.coalesce("score", F.lit(0)))
    said = _with_said(asks, scores.said, "batch_id")
    listed = said.select("batch_id", "said").distinct().join(known, "batch_id").join(held, ["batch_id", "said", "insight_id", "pos", *level], "left")
    listed = listed.withColumn("score", F.coalesce("score", F.lit(0)))
    return expand(said, listed, ["batch_id", "said"]).select(*keys, "score")


def best_insight(asks: DataFrame, vault: DataFrame) -> DataFrame:
    """The most relevant insight of the ask's batch, the earliest of equals, the first where none is mentioned.

    An ask of a batch that is closed or has no open insight keeps its row, with a null insight and score 0.
    """
    relevance = insight_relevance(asks, vault, shared=True)
    entry = F.struct(F.col("score"), (-F.col("pos")).alias("early"), F.col("insight_id").alias("id"))
    tops = relevance.scores.groupBy("batch_id", "said").agg(F.max(entry).alias("b"))
    best = relevance.said.join(tops, ["batch_id", "said"]).groupBy(*ASK).agg(F.max("b").alias("b"))
    first = active_answers(vault).groupBy("batch_id").agg(F.min_by("insight_id", "pos").alias("_first"))
    joined = asks.join(first, "batch_id", "left").join(best, ASK, "left")
    return joined.withColumn("insight_id", F.coalesce("b.id", "_first")).withColumn("score", F.coalesce("b.score", F.lit(0))).drop("b", "_first")


def _mentions(text: Column, answer: Column) -> Column:
    label = F.when(text.contains(F.lower(answer.label)) & (answer.label != ""), 2).otherwise(0)
    aliases = F.size(F.filter(answer.aliases, lambda a: (a != "") & text.contains(F.lower(a))))
    return label + aliases


def mention_answers(asks: DataFrame, vault: DataFrame, k_items: int = 3, k_answers: int = 3) -> DataFrame:
    """For the first insights of the ask's batch the answers worth mentioning.

    Those the text mentions come first by score; if it mentions none, the first ones. Generic answers never.
    """
    first = W.partitionBy("batch_id").orderBy("pos")
    items = insight_index(vault).withColumn("item_no", F.row_number().over(first)).filter(F.col("item_no") <= k_items)
    items = items.select("batch_id", "insight_id", "item_no", "question", F.filter("answers", lambda a: ~is_generic_answer(a.label)).alias("_answers"))
    joined = asks.join(items, "batch_id")
    scored = let(
        F.lower("text"),
        lambda t: F.transform("_answers", lambda a, i: F.struct((-_mentions(t, a)).alias("s"), i.alias("i"), a.label.alias("label"))),
    )
    ranked = joined.withColumn("_scored", F.sort_array(scored))
    hit = F.filter("_scored", lambda x: x.s < 0)
    picked = ranked.withColumn("_hit", hit).withColumn("_pick", F.when(F.size("_hit") > 0, F.col("_hit")).otherwise(F.col("_scored")))
    return picked.select(*ASK, "batch_id", "insight_id", "item_no", "question", F.slice("_pick", 1, k_answers).label.alias("mention_answers"))


def canonical_labels(answers: Column) -> Column:
    """Labels worth naming, in answer order; ``answers`` is sorted by answer id."""
    named = F.transform(answers, lambda a: strip(a.label))
    return F.filter(named, lambda s: (s != "") & ~is_generic_answer(s))


def deterministic_question(question: Column, is_multi: Column, labels: Column) -> Column:
    """One sentence that lists the options word for word."""
    asked = F.rtrim(F.coalesce(question, F.lit("Which option applies to you")), F.lit(" ?"))
    chooser = F.when(is_multi, "choose any of").otherwise("choose one of")
    return F.concat(asked, F.lit("—"), chooser, F.lit(": "), oxford_join(labels), F.lit(" (reply with the exact words)?"))


def mentions_any(question: Column, labels: Column) -> Column:
    lowered = F.lower(F.coalesce(question, F.lit("")))
    return let(lowered, lambda q: F.exists(labels, lambda t: (t != "") & q.contains(F.lower(t))))


def question_guard(question: Column, labels: Column, fallback: Column) -> Column:
    """The model's question if it names an option, else the fallback."""
    return F.when(mentions_any(question, labels), question).otherwise(fallback)


# Question asked when the model gives none.
STAGE_FALLBACK = {
    "employment_category": "Which employment category should we focus on next?",
    "skills": "For this role, which skill areas would you like to prioritize next?",
    "insights": "Where do you feel most stuck within this area right now?",
}


def model_question(reply: Column, stage: Column) -> Column:
    """The reply's question closed by a question mark, or the stage's own question."""
    asked = strip(F.coalesce(field(extract_json_object(reply), "$.question", "string"), F.lit("")))
    fallback = F.create_map(*[F.lit(x) for pair in STAGE_FALLBACK.items() for x in pair])[stage]
    closed = F.when(asked.endswith("?"), asked).otherwise(F.concat(asked, F.lit("?")))
    return F.when(asked != "", closed).otherwise(fallback)


def context_hook(text: Column, answers: Column) -> Column:
    """A short lead-in naming the first answer the text mentions, or empty text."""

    def hits(lowered: Column) -> Column:
        def hit(a: Column) -> Column:
            named = strip(a.label)
            return (named != "") & (lowered.contains(F.lower(named)) | F.exists(a.aliases, lambda x: lowered.contains(F.lower(x))))

        return F.filter(answers, hit)

    first = F.get(let(F.lower(F.coalesce(text, F.lit(""))), hits), F.lit(0)).label
    return F.coalesce(F.concat(F.lit("Since you mentioned "), F.lower(strip(first)), F.lit(",")), F.lit(""))


def first_open_batch(chats: DataFrame, touched: DataFrame, complete: DataFrame, vault: DataFrame) -> DataFrame:
    """First batch in stored order that a chat has neither touched nor completed.

    Batches have ranks from 1 without gaps. As long as a chat's closed ranks, sorted, equal their own places, all before them are
    closed; the first open one follows the last of these. No list of batches is compared with a chat.
    """
    ranks = materialize(batch_ranks(vault).select("batch_id", "rank"), "batch-ranks")
    closed = touched.select("chat_id", "batch_id").union(complete.select("chat_id", "batch_id")).distinct().join(ranks, "batch_id")
    place = F.row_number().over(W.partitionBy("chat_id").orderBy("rank"))
    gap = closed.withColumn("_place", place).where("rank = _place").groupBy("chat_id").agg((F.max("_place") + 1).alias("rank"))
    joined = chats.join(gap, "chat_id", "left").withColumn("rank", F.coalesce("rank", F.lit(1)))
    return joined.join(ranks, "rank", "left").drop("rank")


def stage(ec: Column, done: Column, action: Column, open_batch: Column) -> Column:
    """What to ask about next; a stage whose survey is being shown is passed over."""
    return (
        F.when(ec.isNull() & (action != "show_ec_survey"), "employment_category")
        .when(~F.coalesce(done, F.lit(False)) & (action != "show_skills_survey"), "skills")
        .when(open_batch.isNotNull(), "insights")
        .otherwise("none")
    )

