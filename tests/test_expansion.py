"""Reads of large expansions against plain loops, and at sizes where the rows themselves could not be written."""

import random
from collections import Counter

from pyspark.sql import functions as F

from groundloom.operators import insights as I
from groundloom.operators import questions as N
from groundloom.operators.expansion import expand

INDEX = "batch_id string, batch_name string, batch_pos long, language string, insight_id string, pos long, question string, is_multi boolean, answers array<struct<answer_id:string,label:string,aliases:array<string>>>"
FOLDED = "chat_id long, insight_id string, batch_id string, taken boolean, answer_id string, answer_ids array<string>, pending_reason string, source string, confidence double"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def histories(spark, odd):
    """Chats with some rows; with ``odd`` also a chat without id and insights that the index has in two batches."""
    rng = random.Random(5)
    index = [(f"b{i % 4}", f"n{i % 4}", i % 4, None, f"i{i}", i // 2 * 3, f"q{i}", False, [("A", "a", [])]) for i in range(40)]
    if odd:
        index += [("b3", "n3", 3, None, f"i{i}", 100 + i, "again", False, [("A", "a", [])]) for i in (0, 4, 5)]
    folded, touched = [], set()
    for chat in [*range(12), *([None] if odd else [])]:
        for i in rng.sample(range(44), 14):
            taken = rng.choice([True, None])
            batch = f"b{i % 4}"
            reason = None if taken else rng.choice(["question_only", "later"])
            folded.append((chat, f"i{i}", batch, taken, "A" if taken else None, None, reason, "x", rng.choice([0.6, 1.0, 1.5, None]) if reason == "later" else 0.5 + i / 100))
            if rng.random() < 0.4:
                touched.add((chat, batch))
    return spark.createDataFrame(folded, FOLDED), spark.createDataFrame(sorted(touched, key=str), "chat_id long, batch_id string"), spark.createDataFrame(index, INDEX)


def test_reads_of_an_expanded_state_equal_those_of_its_rows(spark):
    for odd in (False, True):
        folded, touched, index = histories(spark, odd)
        state = I.expanded_state(folded, touched, index)
        rows = state.rows()
        have = {(r.chat_id, r.insight_id) for r in folded.collect() if r.chat_id is not None}
        want = Counter((t.chat_id, x.insight_id, t.batch_id) for t in touched.collect() for x in index.collect() if t.batch_id == x.batch_id and (t.chat_id, x.insight_id) not in have)
        assert rows_of(rows.where("source = 'batch-expansion'").select("chat_id", "insight_id", "batch_id")) == want
        some = touched.where("chat_id % 2 = 0")
        for read in (
            I.insight_stats,
            I.state_quality,
            lambda s: I.batch_completion(s, index),
            lambda s: I.batch_completion(s, index, dense=True),
            lambda s: I.fully_taken_batches(s, index),
            lambda s: I.pending_by_batch(s, touched),
            lambda s: I.pending_by_batch(s, some),
            lambda s: I.build_surveys(s, touched, index, questions=False),
            lambda s: I.build_surveys(s, some, index).drop("question_no"),
        ):
            assert rows_of(read(state)) == rows_of(read(rows))
        numbered = I.build_surveys(state, touched, index).groupBy("chat_id", "batch_id").agg(F.array_sort(F.collect_list("question_no")).alias("n"))
        assert all(r.n == list(range(1, len(r.n) + 1)) for r in numbered.collect())


def test_order_of_questions(spark):
    """Added rows have confidence 1: written ones come before, between and behind them. No two insights of a batch share a place."""
    folded, touched, index = histories(spark, False)
    index = index.withColumn("pos", F.substring("insight_id", 2, 9).cast("long"))
    state = I.expanded_state(folded, touched, index)
    assert rows_of(I.build_surveys(state, touched, index)) == rows_of(I.build_surveys(state.rows(), touched, index))


def test_counts_without_two_thousand_million_rows(spark):
    n, m = 100_000, 20_000
    index = spark.range(n).selectExpr("'b' AS batch_id", "'n' AS batch_name", "0L AS batch_pos", "concat('i', id) AS insight_id", "id AS pos", "'q' AS question", "false AS is_multi", "array(struct('A' AS answer_id, 'a' AS label, array('x') AS aliases)) AS answers")
    one = "concat('i', id) AS insight_id", "'b' AS batch_id", "true AS taken", "'A' AS answer_id", "CAST(NULL AS array<string>) AS answer_ids", "CAST(NULL AS string) AS pending_reason", "'x' AS source", "1D AS confidence"
    folded, touched = spark.range(m).selectExpr("id AS chat_id", *one), spark.range(m).selectExpr("id AS chat_id", "'b' AS batch_id")
    state = I.expanded_state(folded, touched, index)
    stats = I.insight_stats(state).groupBy("taken_count", "pending_count").count().collect()
    assert [tuple(r) for r in stats] == [(1, n - 1, m)]
    assert {r.rule: r.violations for r in I.state_quality(state).collect()} == {"pending_with_answer": 0, "taken_without_one_answer": 0, "duplicate_key": 0, "rows": n * m}
    done = I.batch_completion(state, index).groupBy("taken", "total", "is_complete").count().collect()
    assert [tuple(r) for r in done] == [(1, n, False, m)]
    assert I.build_surveys(state, touched, index, questions=False).agg(F.sum("questions")).first()[0] == (n - 1) * m


def test_expand(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (5, "c")], "n int, k string")
    right = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("b", 1), (None, 7)], "k string, v int")
    assert rows_of(expand(left, right, ["k"], block_rows=8).select("n", "k", "v")) == rows_of(left.join(right, "k").select("n", "k", "v"))


def test_tasks_follow_the_rows_to_open(spark):
    """Few bytes that open many rows are dealt out to many tasks, also where one key has them all."""
    left = spark.range(2000).selectExpr("id AS n", "'a' AS k")
    right = spark.range(1000).selectExpr("'a' AS k", "id AS v")
    made = [r["count"] for r in expand(left, right, ["k"], block_rows=100, task_rows=50_000).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 2_000_000 and len(made) >= 10 and max(made) <= 500_000


def vault(spark):
    rows = [(f"b{i % 2}", i % 5 != 4, f"i{i}", i, a, label, alias) for i in range(12) for a, label, alias in [("A", "Red", "x1"), ("B", f"Blue {i % 3}", "red"), ("C", "", "zz")]]
    return spark.createDataFrame(rows, "batch_id string, insight_active boolean, insight_id string, pos long, answer_id string, label string, alias string").withColumn("batch_active", F.lit(True))


def test_scores_equal_a_loop(spark):
    """Also for prompts that come twice, whose hits meet one another, and for those without a number or a batch."""
    asks = [(1, 0, "b0", "RED and blue 1"), (2, 0, "b1", "blue 0 blue 2"), (3, 1, "b1", "none"), (3, 2, "b1", None), (4, 0, "b0", "x1"), (4, 0, "b0", "x1"), (None, 0, "b0", "red"), (5, 0, None, "red"), (6, 0, "b9", "red")]
    df, rows = spark.createDataFrame(asks, "chat_id long, turn int, batch_id string, text string"), vault(spark)
    score = Counter()
    for chat, turn, batch, _ in asks:
        for chat2, turn2, _, text in asks:
            if (chat, turn) == (chat2, turn2) and chat is not None:
                for r in rows.where("insight_active").collect():
                    if r.batch_id == batch and text:
                        points = 2 * (r.label != "" and r.label.lower() in text.lower()) + (r.alias in text.lower())
                        score[chat, turn, batch, r.insight_id, r.pos, r.answer_id] += points
    want = {k: v for k, v in score.items() if v}
    answers = N.answer_relevance(df, rows)
    assert {tuple(r)[:-1]: r.score for r in answers.collect()} == want and answers.count() == len(want)
    by_insight = Counter()
    for key, v in want.items():
        by_insight[key[:-1]] += v
    insights = N.insight_relevance(df, rows)
    assert {tuple(r)[:-1]: r.score for r in insights.collect()} == by_insight
    for shared, plain in ((N.answer_relevance(df, rows, shared=True), answers), (N.insight_relevance(df, rows, shared=True), insights)):
        assert rows_of(N.with_unmentioned(shared, df, rows)) == rows_of(N.with_unmentioned(plain, df, rows))
    best = {(r.chat_id, r.turn): (r.insight_id, r.score) for r in N.best_insight(df, rows).collect()}
    for ask in {a[:3] for a in asks}:
        own = sorted((-v, k[4], k[3]) for k, v in by_insight.items() if k[:2] == ask[:2])
        first = {"b0": ("i0", 0), "b1": ("i1", 0)}.get(ask[2], (None, 0))
        assert best[ask[:2]] == ((own[0][2], -own[0][0]) if own else first)


def test_best_of_a_thousand_million_equal_scores(spark):
    rows = spark.range(50_000).selectExpr("'b' AS batch_id", "true AS batch_active", "true AS insight_active", "concat('i', id) AS insight_id", "id AS pos", "'A' AS answer_id", "'yes' AS label", "concat('w', id) AS alias")
    asks = spark.range(20_000).selectExpr("id AS chat_id", "0 AS turn", "'b' AS batch_id", "CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'yes, w777 ' END AS text")
    got = N.best_insight(asks, rows).groupBy("insight_id", "score").count().collect()
    assert {tuple(r) for r in got} == {("i0", 2, 10_000), ("i7", 3, 10_000)}


def test_shortlist_equals_a_loop(spark):
    rng = random.Random(3)
    words = ["red", "blue", "bolt", "nut", "gear"]
    options = [(f"l{i % 2}", i, " ".join(rng.choices(words, k=3)), rng.randrange(10_000)) for i in range(60)] + [("l0", 0, "gear gear", 10_001), ("l1", 98, None, 10_002)]
    asks = [(c, 0, f"l{c % 3}", " ".join(rng.choices([*words, "other"], k=rng.randrange(4)))) for c in range(30)]
    got = {(r.chat_id, r["rank"]): (r.id, r.label, r.score) for r in N.shortlist(spark.createDataFrame(asks, "chat_id long, turn int, list_id string, text string"), spark.createDataFrame(options, "list_id string, id long, label string, pos long")).collect()}
    want = {}
    for chat, _, list_id, text in asks:
        scores = Counter()
        for own, key, label, _ in options:
            if own == list_id and label:
                scores[key] += sum(t in text for t in label.split())
        ranked = sorted((-scores[key], pos, key, label) for own, key, label, pos in options if own == list_id)[:4]
        want |= {(chat, n): (key, label, -s) for n, (s, _, key, label) in enumerate(ranked, 1)}
    assert got == want
