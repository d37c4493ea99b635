"""The set-based state folds against a plain loop over random histories."""

import random

from pyspark.sql import functions as F

from groundloom.operators import insights as I
from groundloom.operators import intake as U
from groundloom.operators import questions as N

VAULT = "batch_id string, batch_name string, batch_active boolean, batch_pos long, insight_id string, pos long, question string, is_multi boolean, insight_active boolean, answer_id string, label string, alias string"
DECISIONS = "event_id long, chat_id long, ts long, pass_id long, insight_id string, batch_id string, match_type string, answer_raw string, confidence double"


def vault(spark):
    rows = []
    for i in range(6):
        for a in "ABC":
            rows.append((f"b{i // 3}", "n", True, i // 3, f"i{i}", i, "q", i % 2 == 1, i != 5, a, f"L{a}", "x"))
    return spark.createDataFrame(rows, VAULT)


def loop(history):
    """One decision after the other, passes in order; what was taken is read at the start of a pass."""
    state, touched, status = {}, set(), {}
    for p in sorted({d[3] for d in history}):
        before = {key for key, v in state.items() if v[0] == "take"}
        for event, chat, _, pass_id, insight, batch, match, raw, confidence in sorted(history):
            if pass_id != p:
                continue
            number = int(insight[1:])
            if number > 4:
                status[event] = "unknown_insight"
                continue
            if batch != f"b{number // 3}":
                status[event] = "batch_mismatch"
                continue
            if (chat, insight) in before:
                status[event] = "already_taken"
                touched.add((chat, batch))
                continue
            if match == "NO_MATCH":
                status[event] = "bad_match_type"
            elif match == "QUESTION_ONLY":
                status[event] = "question_only" if confidence >= 0.6 else "below_threshold"
            elif confidence < 0.75:
                status[event] = "below_threshold"
            else:
                picked = [x for x in raw.replace("|", " ").upper().split() if x in "ABC"]
                valid = bool(picked) if number % 2 or "|" in raw else raw in ("A", "B", "C")
                status[event] = "take" if valid else "no_valid_answer"
            if status[event] in ("take", "question_only"):
                state[(chat, insight)] = (status[event], event)
                touched.add((chat, batch))
    return state, touched, status


def test_decisions_equal_the_loop(spark):
    rng = random.Random(11)
    history = []
    for event in range(3000):
        insight = rng.randrange(7)
        batch = f"b{insight // 3}" if rng.random() < 0.9 else "b9"
        match = rng.choice(["QUESTION_AND_ANSWER", "ANSWER_ONLY", "QUESTION_ONLY", "QUESTION_ONLY", "NO_MATCH"])
        history.append((event, rng.randrange(60), event, event // 40, f"i{insight}", batch, match, rng.choice(["A", "b", "A|C", "z|b", "Z"]), rng.choice([0.5, 0.6, 0.7, 0.75, 0.9])))
    state, touched, status = loop(history)
    applied = I.apply_decisions(spark.createDataFrame(history, DECISIONS), vault(spark))
    assert {r.event_id: r.status for r in applied.collect()} == status
    assert {tuple(r) for r in I.touched_batches(applied).collect()} == touched
    folded = {(r.chat_id, r.insight_id): ("take" if r.taken else "question_only", r.updated_at) for r in I.fold_insight_state(applied).collect()}
    assert folded == state


def test_submission_stands_or_falls_as_a_unit(spark):
    rows = [(1, "b0", "i0", "A", None), (1, "b0", "i1", None, ["A", "B"]), (2, "b0", "i0", "A", None), (2, "b0", "i1", "A", None), (3, "b7", "i0", "A", None), (4, "b0", "i4", "A", None)]
    responses = spark.createDataFrame(rows, "submission_id long, batch_id string, insight_id string, answer_id string, answer_ids array<string>")
    got = {(r.submission_id, r.insight_id): (r.status, r.accepted) for r in I.submit_survey(responses, vault(spark)).collect()}
    assert got == {
        (1, "i0"): ("ok", True), (1, "i1"): ("ok", True), (2, "i0"): ("ok", False), (2, "i1"): ("expects_multiple", False),
        (3, "i0"): ("unknown_batch", False), (4, "i4"): ("insight_not_in_batch", False),
    }


def test_uia_fold(spark):
    events = [(1, 1, 1, "set_skills", "a", ["s"], "v"), (1, 2, 2, "set_ec", "b", None, "v"), (2, 1, 3, "set_ec", "a", None, "v"), (2, 2, 4, "system_decide", "a", None, "w"), (3, 1, 5, "message", "a", None, "v")]
    df = spark.createDataFrame(events, "chat_id long, ts long, event_id long, kind string, ec_id string, skills array<string>, vault_version string")
    got = {r.chat_id: (r.employment_category_id, r.skills_selected, r.let_system_decide, r.vault_version, r.recorded_at) for r in U.fold_uia_state(df).collect()}
    assert got == {1: ("b", None, False, "v", None), 2: ("a", None, True, "w", 1)}


def test_nested_vaults_flatten(spark):
    nested = spark.createDataFrame(
        [("v1", [("e", "Data", None, ["DS"], [("s", "SQL", None, ["sql", "Structured"])])])],
        "vault_version string, employment_categories array<struct<id:string,name:string,description:string,aliases:array<string>,skills:array<struct<id:string,name:string,description:string,aliases:array<string>>>>>",
    )
    flat = U.flatten_vault(nested)
    index = {(r.type, r.target_id, r.alias_norm, r.alias) for r in U.build_alias_index(flat).collect()}
    assert index == {("ec", "e", "data", "Data"), ("ec", "e", "ds", "DS"), ("skill", "s", "sql", "SQL"), ("skill", "s", "structured", "Structured")}


def many_batches(spark, n):
    index = spark.range(n).selectExpr("concat('b', id) AS batch_id", "id * 2 AS batch_pos", "concat('i', id) AS insight_id", "'n' AS batch_name", "0L AS pos", "'q' AS question", "false AS is_multi")
    return index.withColumn("answers", F.array().cast("array<struct<answer_id:string,label:string,aliases:array<string>>>"))


def test_first_gap_of_100000_batches(spark):
    """Chats with nothing closed, a closed beginning, a gap in the middle, and everything closed."""
    n = 100_000
    closed = spark.range(n).selectExpr("5L AS chat_id", "concat('b', id) AS batch_id").unionByName(spark.createDataFrame([(2, "b0"), (2, "b1"), (3, "b1"), (4, "b0"), (4, "b2"), (2, "unknown"), (2, "b1")], "chat_id long, batch_id string"))
    chats = spark.createDataFrame([(k,) for k in range(1, 6)], "chat_id long")
    none = spark.createDataFrame([], "chat_id long, batch_id string")
    for touched, complete in ((closed, none), (none, closed)):
        got = {r.chat_id: r.batch_id for r in N.first_open_batch(chats, touched, complete, many_batches(spark, n)).collect()}
        assert got == {1: "b0", 2: "b2", 3: "b0", 4: "b1", 5: None}


def test_completion_of_every_batch(spark):
    rng = random.Random(9)
    rows = {(rng.randrange(6), f"i{rng.randrange(40)}"): rng.choice([True, None]) for _ in range(60)} | {(9, "closed"): True}
    state = spark.createDataFrame([(c, i, "b" + i[1:], t) for (c, i), t in rows.items()], "chat_id long, insight_id string, batch_id string, taken boolean")
    dense = {(r.chat_id, r.batch_id): (r.taken, r.total, r.is_complete) for r in I.batch_completion(state, many_batches(spark, 40), dense=True).collect()}
    want = {(c, f"b{b}"): (int(rows.get((c, f"i{b}")) is True), 1, rows.get((c, f"i{b}")) is True) for c in {c for c, _ in rows} for b in range(40)}
    assert dense == want
    sparse = I.batch_completion(state, many_batches(spark, 40)).count()
    assert sparse == len([1 for _, i in rows if i != "closed"])
