"""Streams against batches and plain loops, on disordered and repeated input."""

import random
from datetime import datetime, timedelta

import pytest
from test_state import DECISIONS, vault

from groundloom.operators import insights as I
from groundloom.streaming import events as K
from groundloom.streaming import keyed

START = datetime(2024, 1, 1)


def files(spark, path, parts, schema):
    """One file per micro-batch, in order of time."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{n:03}")
    return f"{path}/*"


def one_by_one(spark, path, schema):
    df = spark.createDataFrame([], schema)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_sessions_of_a_disordered_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "request_id long, ts timestamp, event_id long, type string, label string"
    rows, number = [], 0
    for request in range(12):
        at = START
        for _ in range(25):
            at += timedelta(seconds=rng.choice([0, 1, 60, 299, 300, 301, 900]))
            number += 1
            kind = rng.choice(["step", "step", "step", "done", "error"])
            rows.append((request, at, number, kind, f"{kind} {number}"))
    by_time = sorted(rows, key=lambda r: r[1])
    parts = [by_time[i : i + 40] for i in range(0, len(by_time), 40)]
    for a, b in zip(parts[::2], parts[1::2], strict=False):
        # Some events come one file late, but within the watermark's delay.
        late = [r for r in a if rng.random() < 0.3]
        a[:] = [r for r in a if r not in late]
        b[:] = late + b
        rng.shuffle(b)
    end = (99, START + timedelta(days=9), 10**6, "step", "end")
    path = files(spark, f"{tmp_path}/in", [*parts, [end], [(98, *end[1:])]], schema)
    stream = one_by_one(spark, path, schema).withWatermark("ts", "3 hours")
    out = f"{tmp_path}/out"
    K.write_files(K.progress_sessions(stream), out).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()), key=str)
    batch = K.progress_sessions(spark.createDataFrame(rows, schema)).collect()
    assert got == sorted(map(tuple, batch), key=str)
    assert any(r.closed for r in batch) and not all(r.closed for r in batch)


def test_insight_state_in_any_order_equals_the_batch(spark, tmp_path):
    """Decisions come shuffled, some of them twice, in many micro-batches; the log is compacted on the way."""
    rng = random.Random(7)
    schema = DECISIONS.replace("ts long", "ts timestamp") + ", evidence array<string>, vault_version string"
    history = []
    for event in range(900):
        insight = rng.randrange(6)
        match = rng.choice(["QUESTION_AND_ANSWER", "ANSWER_ONLY", "QUESTION_ONLY", "QUESTION_ONLY", "NO_MATCH"])
        history.append((event, rng.randrange(25), START + timedelta(seconds=event), event // 30, f"i{insight}", f"b{insight // 3}", match, rng.choice(["A", "b", "A|C", "Z"]), rng.choice([0.6, 0.75, 0.9]), [f"e{event}"], f"v{event % 2}"))
    arriving = history + rng.sample(history, 200)
    rng.shuffle(arriving)
    path = files(spark, f"{tmp_path}/in", [arriving[i : i + 100] for i in range(0, len(arriving), 100)], schema)
    at = f"{tmp_path}/state"
    K.upsert_insight_state(one_by_one(spark, path, schema), vault(spark), at, every=3).start().awaitTermination()
    want = I.fold_insight_state(I.apply_decisions(spark.createDataFrame(history, schema), vault(spark)))
    columns = sorted(want.columns)
    got = sorted((tuple(r) for r in K.read_insight_state(spark, at).select(columns).collect()), key=str)
    assert got == sorted((tuple(r) for r in want.select(columns).collect()), key=str)
    log = K.insight_log(at)
    assert len(log._listed(spark, "changes", True)) < 8 and log._listed(spark, "snapshots", True)


def test_a_micro_batch_run_again_changes_nothing(spark, tmp_path):
    log = keyed.ChangeLog(f"{tmp_path}/log", ["k"], every=2)
    for epoch, rows in enumerate([[(1, "a"), (2, "a")], [(2, "b")], [(3, "c")], [(1, "d")], [(1, "e")]]):
        for _ in range(2):
            log.write(spark.createDataFrame(rows, "k long, v string"), epoch)
    assert sorted(map(tuple, log.read(spark).collect())) == [(1, "e"), (2, "b"), (3, "c")]


@pytest.mark.parametrize("fan", [2, 8])
def test_replays_after_any_delay(spark, tmp_path, monkeypatch, fan):
    """Keys come again much later, several times in one micro-batch, and micro-batches are run again."""
    monkeypatch.setattr(keyed.KeyLog, "FAN", fan)
    log = keyed.KeyLog(spark, f"{tmp_path}/keys", "k", buckets=3)
    rng, seen, null_seen = random.Random(fan), set(), False
    for epoch in range(7):
        keys = [epoch * 100 + n for n in range(60)] + rng.sample(sorted(seen), len(seen) // 3) + [epoch * 100] * 3
        batch = spark.createDataFrame([(k, "x") for k in [*keys, None, None]], "k long, v string")
        fresh = set(keys) - seen | (set() if null_seen else {None})
        for _ in range(2):
            got = [r.k for r in log.fresh(batch, epoch).collect()]
            assert len(got) == len(set(got)) and set(got) == fresh
        seen, null_seen = seen | set(keys), True
    assert len(log.files()) <= (4 if fan == 2 else 7)


def test_insight_state_is_kept_by_plain_aggregates(spark, tmp_path):
    """No Python per key: the stream's state is a maximum and a minimum per pass. A decision of an earlier pass that comes later takes over."""
    schema = DECISIONS.replace("ts long", "ts timestamp")
    row = [
        (5, 1, START + timedelta(seconds=5), 2, "i0", "b0", "QUESTION_AND_ANSWER", "B", 0.9),
        (3, 1, START + timedelta(seconds=3), 1, "i0", "b0", "QUESTION_AND_ANSWER", "A", 0.9),
        (1, 1, START + timedelta(seconds=1), 0, "i0", "b0", "QUESTION_ONLY", "", 0.9),
    ]
    stream = one_by_one(spark, files(spark, f"{tmp_path}/in", [[r] for r in row], schema), schema)
    changes = keyed.insight_changes(I.judge_decisions(stream, vault(spark)))
    plan = changes._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan
    K.upsert_insight_state(stream, vault(spark), f"{tmp_path}/state").start().awaitTermination()
    got = K.read_insight_state(spark, f"{tmp_path}/state").collect()
    assert [(r.answer_id, r.taken, r.updated_at, r.created_at) for r in got] == [("A", True, row[1][2], row[2][2])]
