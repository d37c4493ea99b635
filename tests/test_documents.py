"""Blocks and chunks on hand-made documents and on random ones with their parts known in advance."""

import random

from groundloom.operators import blocks as B
from groundloom.operators import chunks as C


def docs(spark, *texts):
    return spark.createDataFrame([(i, "v1", t) for i, t in enumerate(texts)], "doc_id int, version string, text string")


def blocks(spark, text):
    rows = B.build_blocks(docs(spark, text)).orderBy("block_index").collect()
    return [(r.block_type, r.text, "/".join(r.section_path)) for r in rows]


def test_fence_hides_markers_and_may_stay_open(spark):
    assert blocks(spark, "```\n# no\n| a |\n```\n# yes\n````\nrest") == [
        ("code", "```\n# no\n| a |\n```", ""),
        ("heading", "# yes", "yes"),
        ("code", "````\nrest", "yes"),
    ]


def test_table_runs_to_blank_and_stops_paragraph(spark):
    assert blocks(spark, "text\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n\n\nafter") == [
        ("paragraph", "text", ""),
        ("table", "| a | b |\n|---|---|\n| 1 | 2 |\n```", ""),
        ("paragraph", "after", ""),
    ]


def test_sections_nest_by_stack_depth(spark):
    got = [p for _, _, p in blocks(spark, "## a\n## b\nx\n# c\n### d\n## e")]
    assert got == ["a", "a/b", "a/b", "c", "c/d", "c/e"]


def test_list_items_are_single_lines(spark):
    assert blocks(spark, "- a\n  more\n2) b\r\n-c") == [
        ("list_item", "- a", ""),
        ("paragraph", "  more", ""),
        ("list_item", "2) b", ""),
        ("paragraph", "-c", ""),
    ]


def test_very_long_document(spark):
    text = "```\n" + "code\n" * 150_000 + "```\n" + "line\n" * 150_000
    assert [(k, len(t)) for k, t, _ in blocks(spark, text)] == [("code", 150_000 * 5 + 7), ("paragraph", 150_000 * 5 - 1)]


def test_blocks_give_back_all_visible_lines(spark):
    rng = random.Random(5)
    parts = ["# h", "## h", "- i", "1. i", "p q", "", "```", "| a | b |", "|---|---|", "  ", "tail |"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = B.build_blocks(docs(spark, *texts)).orderBy("doc_id", "block_index").collect()
    for i, text in enumerate(texts):
        kept = [ln for r in rows if r.doc_id == i for ln in r.text.split("\n") if ln.strip()]
        assert kept == [ln for ln in text.split("\n") if ln.strip()]
        assert [r.block_index for r in rows if r.doc_id == i] == list(range(sum(r.doc_id == i for r in rows)))


def test_nested_and_stored_blocks_pack_alike(spark):
    nested = B.with_blocks(docs(spark, "# a\nb c\n\nd\n\n```\nx\n```\ne", "f"))
    again = B.nest_blocks(B.explode_blocks(nested))
    ids = lambda df: sorted(r.chunk_id for r in C.build_chunks(df).collect())
    assert ids(nested) == ids(again)


def test_overlap_repeats_the_prefixed_tail(spark):
    cfg = C.ChunkConfig(target_tokens=3, max_tokens=4, min_tokens=1, overlap_tokens=2)
    rows = C.build_chunks(B.with_blocks(docs(spark, "a b c\n\nd e f\n\n```\nx\n```\n\ng h i")), cfg).orderBy("chunk_index").collect()
    assert [r.text for r in rows] == ["a b c", "b c\n\nd e f", "```\nx\n```", "x ```\n\ng h i"]
    assert [r.overlap_with_prev for r in rows] == [None, 2, None, 2]


def test_contract_counts_absent_columns(spark):
    rows = C.chunk_contract_check(C.build_chunks(B.with_blocks(docs(spark, "a", "b")))).collect()
    counts = {r.rule: r.violations for r in rows}
    assert counts["missing_page_start"] == 2 and counts["missing_chunk_id"] == 0 and counts["enum_doc_id"] == 2
