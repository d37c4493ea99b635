"""Inputs at the edges: very wide tables, replies that are not quite JSON, odd user rules, closing events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from groundloom.functions.modeljson import extract_json_object, is_json_object
from groundloom.operators import answering, blocks, chat, cleaning
from groundloom.operators.cleaning import CleaningRules
from groundloom.operators.retrieval import vector_index
from groundloom.streaming.events import progress_sessions


def test_table_of_many_columns(spark):
    wide = "|" + "a|" * 20_000 + "\n|" + "---|" * 20_000 + "\n|" + "1|" * 20_000
    text = f"# t\n\n{wide}\n\nend"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kinds = [r.block_type for r in blocks.build_blocks(docs).orderBy("block_index").collect()]
    assert kinds == ["heading", "table", "paragraph"]
    assert docs.select(cleaning.clean_text(F.col("text"), "aggressive")).first()[0].endswith("end")


@pytest.mark.parametrize("line, separator", [("|---|---|", True), ("---|---", True), ("| :-- | --: |", True), (":-:|:-:|", True), ("---", False), ("|---|", False), ("|--- ---|---|", False), ("||---|", False)])
def test_separators(spark, line, separator):
    docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
    assert blocks.classify_lines(docs).first().is_separator == separator


@pytest.mark.parametrize("text, good", [('{"a": 1}', True), ('\n  {"a": [1, {"b": null}]} \n', True), ('{"a": 1} trailing', False), ('{"a": 1} {"b": 2}', False), ('{"a": 1}]', False), ('{"a": 1}, {"b": 2}', False), ("[1]", False), ("null", False), ("", False), (None, False), ('{"a": 1', False)])
def test_json_objects(spark, text, good):
    row = spark.createDataFrame([(text,)], "t string").select(is_json_object(F.col("t")).alias("ok"), extract_json_object(F.col("t")).alias("x")).first()
    assert row.ok == good
    if good:
        assert row.x == text.strip()


def test_two_objects_do_not_pass_the_gate(spark):
    replies = spark.createDataFrame([('{"proceed": true} x {"b": 2}',)], "reply string")
    assert replies.select(extract_json_object(F.col("reply"))).first()[0] == "{}"


@pytest.mark.parametrize("reply, used", [('{"on_topic": null, "revision": "new"}', True), ('{"revision": "new"}', False), ('{"on_topic": false, "revision": "new"}', True), ('{"on_topic": true, "revision": "new"}', False), ('\n{"contradiction": true, "revision": "new"}', True)])
def test_null_verdict(spark, reply, used):
    row = spark.createDataFrame([(reply, "draft")], "r string, d string").select(answering.apply_validation(F.col("r"), F.col("d"))).first()
    assert row[0] == ("new" if used else "draft")


def test_user_rules(spark):
    rules = CleaningRules(
        remove_lines_matching=["^drop(?P<n>x)", "(", "[[:alpha:"],
        replace=[("usd", "US$"), ("back", r"a\\b"), (r"(?P<n>\d+)kg", r"\g<n> kilos"), (r"(\w)!", r"\1?"), ("(a", "x"), ("one", r"\2"), ("", "y")],
    )
    text = "usd back 12kg\ndropx\nhi! one"
    got = spark.createDataFrame([(text,)], "t string").select(cleaning.apply_rules(F.col("t"), rules)).first()[0]
    assert got == "US$ a\\\\b 12 kilos\nhi? one"


def test_incomplete_index_fails(spark):
    chunks = spark.createDataFrame([(1, "", "a"), (2, "", "b")], "chunk_id long, embedding_text string, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, embedding array<double>")
    with pytest.raises(Exception, match="no vector for chunk 2"):
        vector_index(chunks, vectors).collect()


def test_sessions_end_at_closing_events(spark):
    at = dt.datetime(2024, 1, 1)
    events = [(1, 7, at, "step"), (2, 7, at + dt.timedelta(seconds=1), "done"), (3, 7, at + dt.timedelta(seconds=2), "step")]
    rows = spark.createDataFrame([(e, r, t, k, k) for e, r, t, k in events], "event_id long, request_id long, ts timestamp, type string, label string")
    got = progress_sessions(rows, closing=["done"]).orderBy("started_at").collect()
    assert [(r.events, r.closed) for r in got] == [(2, True), (1, False)]


def test_document_of_many_sections(spark):
    """Paths, packing and overlap of 20,000 sections in time that a quadratic fold doesn't keep."""
    import time

    from groundloom.operators import chunks

    text = "\n\n".join(f"{'#' * (1 + i % 3)} h{i}\n\nword word {i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.time()
    rows = blocks.build_blocks(docs).where("block_type = 'heading'").select("block_index", "section_path").collect()
    assert len(rows) == 20_000
    path = []
    for i, row in enumerate(sorted(rows)):
        level = 1 + i % 3
        path = (path[: level - 1] if len(path) >= level else path) + [f"h{i}"]
        assert row.section_path == path
    assert chunks.build_chunks(blocks.with_blocks(docs)).count() > 1000
    assert time.time() - started < 60
