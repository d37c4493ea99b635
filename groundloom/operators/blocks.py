"""Markdown text to typed blocks with their section path.

A document is one row and stays one row until its blocks are known: a single regular expression cuts the
text into runs of whole lines (a fence region, a table, a heading, a list item, a paragraph, a blank), so
nothing is shuffled. Quantifiers over line groups are possessive, which the JVM's matcher runs as a loop
and never by recursion, so document length is not limited by the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HS, explode_once, let, line_terminated, lines, long_fold, strip

# One line including its end. All texts matched here are line-terminated.
_LINE = "[^\n]*\n"
_FENCE = "`{3,}"
_CELL = f"{HS}*+:?-++:?{HS}*+"
_SEPARATOR = rf"{HS}*+\|?{_CELL}(?:\|{_CELL})++\|?{HS}*+\n"
_TABLE_HEAD = rf"(?=[^\n|]*\|){_LINE}{_SEPARATOR}"
_BLANK = f"{HS}*+\n"
_HEADING = f"#{{1,6}}{HS}{_LINE}"
_LIST = rf"{HS}*+(?:[-*+•]|\p{{Nd}}+[.)]){HS}{_LINE}"

_CODE = f"{_FENCE}{_LINE}(?:(?!{_FENCE}){_LINE})*+(?:{_FENCE}{_LINE})?"
_TABLE = f"{_TABLE_HEAD}(?:(?!{_BLANK}){_LINE})*+(?:{_BLANK})?"
_PARAGRAPH = f"{_LINE}(?:(?!{_BLANK}|{_FENCE}|{_HEADING}|{_LIST}|{_TABLE_HEAD}){_LINE})*+"

RUN = f"{_CODE}|{_TABLE}|{_HEADING}|{_BLANK}|{_LIST}|{_PARAGRAPH}"
_NOT_HEADING = f"(?:{_CODE}|{_TABLE}|(?!{_HEADING}){_LINE})"
SECTION = f"(?:{_NOT_HEADING}|{_HEADING}){_NOT_HEADING}*+"


def run_kind(run: Column) -> Column:
    """Kind of one run cut out by ``RUN``."""
    return (
        F.when(run.startswith("```"), "code")
        .when(run.rlike(rf"\A{_TABLE_HEAD}"), "table")
        .when(run.rlike(rf"\A{_HEADING}"), "heading")
        .when(run.rlike(rf"\A{HS}*\n\z"), "blank")
        .when(run.rlike(rf"\A{_LIST}"), "list_item")
        .otherwise("paragraph")
    )


def line_runs(text: Column) -> Column:
    """Array of runs; every line belongs to exactly one."""
    return F.regexp_extract_all(line_terminated(text), F.lit(RUN), F.lit(0))


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line with its 0-based position."""
    return docs.select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "line")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def classify_lines(docs: DataFrame) -> DataFrame:
    """Line table with the shape of each line taken by itself."""
    line = F.concat("line", F.lit("\n"))
    return line_table(docs).select(
        "doc_id",
        "pos",
        F.length(F.regexp_extract(line, rf"\A(#{{1,6}}){HS}", 1)).cast("bigint").alias("heading_level"),
        line.rlike(rf"\A{HS}*[-*+•]{HS}").alias("is_bullet"),
        line.rlike(rf"\A{HS}*\p{{Nd}}+[.)]{HS}").alias("is_numbered"),
        line.rlike(rf"\A{_FENCE}").alias("is_fence"),
        line.rlike(rf"\A{_SEPARATOR}\z").alias("is_separator"),
        line.rlike(rf"\A{_BLANK}\z").alias("is_blank"),
    )


def line_regions(docs: DataFrame) -> DataFrame:
    """Mode of every line: ``code``, ``table`` or ``text``."""
    run = F.col("run")
    tagged = explode_once(docs, line_runs(F.col("text")), "run_no", "run", keep=["doc_id"]).withColumn("kind", run_kind(run))
    # A blank that closes a table is part of the run but not of the table.
    per_line = tagged.select(
        "doc_id",
        "run_no",
        "kind",
        F.posexplode(F.split(F.substring(run, 1, F.length(run) - 1), "\n", -1)).alias("line_in_run", "line"),
    )
    blank_tail = (F.col("kind") == "table") & F.col("line").rlike(rf"\A{HS}*\z")
    mode = F.when(F.col("kind").isin("code", "table") & ~blank_tail, F.col("kind")).otherwise("text")
    return per_line.select(
        "doc_id", F.col("run_no").cast("bigint").alias("run_no"), F.col("line_in_run").cast("bigint").alias("line_in_run"), mode.alias("mode")
    )


def with_blocks(docs: DataFrame) -> DataFrame:
    """Add ``blocks``: the ordered block structs of each document, still one row per document."""
    sections = F.regexp_extract_all(line_terminated(F.col("text")), F.lit(SECTION), F.lit(0))

    def cut(section: Column) -> Column:
        headed = section.rlike(rf"\A{_HEADING}") & ~section.rlike(rf"\A{_TABLE_HEAD}")
        runs = F.filter(
            F.regexp_extract_all(section, F.lit(RUN), F.lit(0)), lambda r: ~r.rlike(rf"\A{HS}*\n\z")
        )
        return F.struct(
            F.when(headed, F.length(F.regexp_extract(section, rf"\A(#{{1,6}}){HS}", 1))).otherwise(0).alias("level"),
            strip(F.regexp_extract(section, rf"\A#{{1,6}}{HS}([^\n]*)\n", 1)).alias("title"),
            runs.alias("runs"),
        )

    placed = "array<struct<path:array<string>,base:int,runs:array<string>>>"
    start = {"path": F.array().cast("array<string>"), "n": F.lit(0)}

    def place(state: Column, sec: Column) -> Column:
        # The stack is cut back only where it is already as deep as the new heading's level.
        kept = F.when(
            F.size(state.path) >= sec.level, F.slice(state.path, F.lit(1), F.greatest(sec.level - 1, F.lit(0)))
        ).otherwise(state.path)
        path = F.when(sec.level > 0, F.concat(kept, F.array(sec.title))).otherwise(state.path)
        entry = F.struct(path.alias("path"), state.n.alias("base"), sec.runs.alias("runs"))
        return F.struct(
            path.alias("path"),
            (state.n + F.size(sec.runs)).alias("n"),
            F.concat(state.out, F.array(entry)).alias("out"),
        )

    def finish_section(sec: Column) -> Column:
        def block(run: Column, i: Column) -> Column:
            kind = run_kind(run)
            body = F.when(kind == "table", F.regexp_replace(run, rf"\n(?:{HS}*\n)?\z", "")).otherwise(
                F.substring(run, F.lit(1), F.length(run) - 1)
            )
            return F.struct(
                (sec.base + i).alias("block_index"),
                kind.alias("block_type"),
                body.alias("text"),
                sec.path.alias("section_path"),
                F.when(kind == "heading", F.length(F.regexp_extract(run, rf"\A(#{{1,6}}){HS}", 1))).alias("heading_level"),
            )

        return F.transform(sec.runs, block)

    sections_placed = let(F.transform(sections, cut), lambda cuts: long_fold(cuts, start, placed, place))
    return docs.withColumn("blocks", F.flatten(F.transform(sections_placed, finish_section)))


def explode_blocks(nested: DataFrame) -> DataFrame:
    """One row per block from a frame that carries ``blocks``."""
    keys = [c for c in ("doc_id", "version") if c in nested.columns]
    return explode_once(nested, F.col("blocks"), "b", keep=keys).select(*keys, "b.*")


def build_blocks(docs: DataFrame) -> DataFrame:
    """Typed blocks of every document, one row per block."""
    return explode_blocks(with_blocks(docs))


def nest_blocks(blocks: DataFrame) -> DataFrame:
    """Inverse of :func:`explode_blocks` for blocks read back from storage.

    A group is one document, which was one row before, so the collected array has a row's size.
    """
    keys = [c for c in ("doc_id", "version") if c in blocks.columns]
    packed = F.struct("block_index", "block_type", "text", "section_path", "heading_level")
    return blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(packed)).alias("blocks"))


def block_stats(nested: DataFrame, mode: str = "lossless") -> DataFrame:
    """Block counts of every document, zeros for documents without blocks; counted within the document's row."""

    def count(kind: str) -> Column:
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint")

    keys = [c for c in ("doc_id", "version") if c in nested.columns]
    kinds = nested.select(*keys, F.coalesce(F.col("blocks.block_type"), F.array().cast("array<string>")).alias("kinds"))
    return kinds.select(
        *keys,
        count("paragraph").alias("paragraphs"),
        count("heading").alias("headings"),
        count("list_item").alias("list_items"),
        count("table").alias("tables"),
        F.size("kinds").cast("bigint").alias("blocks"),
        F.lit(mode).alias("mode"),
    )
