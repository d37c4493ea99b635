"""Blocks, sections and chunks over the markdown documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import cleaning
from .fixtures import oracle, view
from .registry import query
from .text_queries import REPEATED, SP, ntok

# --- check SQL: a line automaton, then gaps and islands -------------------------------------------

_SEP = "^\\s*\\|?(?:\\s*:?-+:?\\s*\\|)+\\s*:?-+:?\\s*\\|?\\s*$"


def letters(src: str) -> str:
    """CTEs giving every line of ``src`` a mode letter: F/E fence, T table, B blank after it, N other."""
    return f"""la AS (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] ELSE str_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS a FROM {src}),
lc AS (SELECT doc_id, a, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN regexp_matches(a[i], '^`{{3,}}') THEN 'f' WHEN contains(a[i], '|') AND i < len(a) AND regexp_matches(a[i + 1], '{_SEP}') THEN 't' WHEN trim(a[i], {SP}) = '' THEN 'b' ELSE 'n' END) AS c FROM la),
ls AS (SELECT doc_id, a, list_reduce(list_prepend('N', c), lambda s, x: s || CASE right(s, 1) WHEN 'F' THEN (CASE x WHEN 'f' THEN 'E' ELSE 'F' END) WHEN 'T' THEN (CASE x WHEN 'b' THEN 'B' ELSE 'T' END) ELSE (CASE x WHEN 'f' THEN 'F' WHEN 't' THEN 'T' ELSE 'N' END) END) AS s FROM lc),
lk AS MATERIALIZED (SELECT doc_id, pos, a[pos] AS ln, substr(s, pos + 1, 1) AS m, CASE WHEN m IN ('F', 'E') THEN 'code' WHEN m = 'T' THEN 'table' WHEN m = 'B' OR trim(ln, {SP}) = '' THEN 'blank' WHEN regexp_matches(ln, '^#{{1,6}}\\s') THEN 'heading' WHEN regexp_matches(ln, '^\\s*([-*+•]|\\d+[.)])\\s') THEN 'list_item' ELSE 'paragraph' END AS kind FROM ls, unnest(range(1, len(a) + 1)) t(pos)),
lg AS MATERIALIZED (SELECT *, sum(CASE WHEN kind = 'code' THEN (m = 'F' AND coalesce(pm, 'N') <> 'F')::INT WHEN kind = 'table' THEN (coalesce(pm, 'N') <> 'T')::INT WHEN kind = 'paragraph' THEN (coalesce(pk, '') <> 'paragraph')::INT ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(m) OVER w AS pm, lag(kind) OVER w AS pk FROM lk WINDOW w AS (PARTITION BY doc_id ORDER BY pos)))"""


BLOCKS = (
    letters("v_md")
    + """,
b0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS block_index, kind AS block_type, string_agg(ln, chr(10) ORDER BY pos) AS text FROM lg WHERE kind <> 'blank' GROUP BY doc_id, run, kind),
b1 AS (SELECT *, CASE WHEN block_type = 'heading' THEN length(regexp_extract(text, '^(#{1,6})\\s', 1)) END AS lv, CASE WHEN block_type = 'heading' THEN trim(regexp_replace(text, '^#{1,6}\\s+', '')) END AS title FROM b0),
b2 AS (SELECT *, CASE WHEN lv IS NOT NULL THEN count(lv) OVER (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING) END AS i FROM b1),
b3 AS (SELECT *, CASE WHEN lv IS NOT NULL THEN least(i, i + min(lv - i) OVER (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING)) END AS d FROM b2),
b4 AS (SELECT *, last_value(d IGNORE NULLS) OVER w AS depth, """
    + ", ".join(f"last_value(CASE WHEN d = {k} THEN title END IGNORE NULLS) OVER w AS p{k}" for k in range(1, 7))
    + """ FROM b3 WINDOW w AS (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING)),
blk AS MATERIALIZED (SELECT doc_id, block_index, block_type, text, coalesce(list_slice([p1, p2, p3, p4, p5, p6], 1, depth), []::VARCHAR[]) AS path, lv FROM b4)"""
)

# Limits small enough that every packing branch is taken.
CFG = C.ChunkConfig(target_tokens=60, max_tokens=80, min_tokens=15, overlap_tokens=20)
CFG_HEADINGS = C.ChunkConfig(target_tokens=60, max_tokens=80, min_tokens=15, overlap_tokens=0, include_headings_in_text=True)


def chunk_ctes(target=60, mx=80, mn=15, overlap=20, headings=False) -> str:
    """Greedy packing as a list fold over ``{n, s}``: n = tokens or running buffer, s = kind or letters."""
    skip = "" if headings else " AND block_type <> 'heading'"
    return (
        BLOCKS
        + f""",
c0 AS (SELECT doc_id, block_index, block_type, text, path, {ntok('text')} AS n, sum((block_type = 'heading' AND lv <= 2)::INT) OVER (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS seg FROM blk),
c1 AS (SELECT *, seg <> coalesce(lag(seg) OVER (PARTITION BY doc_id ORDER BY block_index), 0) AS cut, row_number() OVER (PARTITION BY doc_id ORDER BY block_index) AS ord FROM c0 WHERE true{skip}),
c2 AS (SELECT doc_id, list_reduce(list_prepend({{'n': 0::BIGINT, 's': ''}}, list({{'n': n, 's': CASE WHEN block_type IN ('table', 'code') THEN 'a' WHEN cut THEN 'k' ELSE 'p' END}} ORDER BY ord)),
  lambda acc, x: CASE
    WHEN x.s = 'a' THEN {{'n': 0::BIGINT, 's': acc.s || 'A'}}
    WHEN x.s = 'k' OR acc.n = 0 THEN {{'n': CASE WHEN x.n >= {target} THEN 0 ELSE x.n END, 's': acc.s || 'S'}}
    WHEN acc.n + x.n > {mx} AND acc.n >= {mn} THEN {{'n': CASE WHEN x.n >= {target} THEN 0 ELSE x.n END, 's': acc.s || 'M'}}
    ELSE {{'n': CASE WHEN acc.n + x.n >= {target} THEN 0 ELSE acc.n + x.n END, 's': acc.s || 'C'}} END).s AS s FROM c1 GROUP BY doc_id),
c3 AS (SELECT c1.*, substr(c2.s, ord::INT, 1) AS h, sum((substr(c2.s, ord::INT, 1) <> 'C')::INT) OVER (PARTITION BY c1.doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - 1 AS idx FROM c1 JOIN c2 USING (doc_id)),
ck AS MATERIALIZED (SELECT doc_id, idx, min(block_index) AS b_first, max(block_index) AS b_last, CASE WHEN any_value(block_type) IN ('table', 'code') THEN any_value(block_type) ELSE 'text' END AS chunk_type, coalesce(first(path ORDER BY ord) FILTER (block_type <> 'heading'), first(path ORDER BY ord)) AS path, string_agg(CASE WHEN h IN ('A', 'M') THEN text ELSE rtrim(text, {SP}) END, chr(10) || chr(10) ORDER BY ord) AS text FROM c3 GROUP BY doc_id, idx),
ov AS (SELECT doc_id, idx, text, false AS lapped FROM ck WHERE idx = 0
  UNION ALL
  SELECT doc_id, idx, CASE WHEN lapped THEN pre || chr(10) || chr(10) || text ELSE text END, lapped FROM (
    SELECT c.doc_id, c.idx, c.text, array_to_string(w[-{max(overlap, 1)}:], ' ') AS pre, {overlap} > 0 AND c.chunk_type = 'text' AND len(w) > {overlap} AND NOT starts_with(c.text, array_to_string(w[-{max(overlap, 1)}:], ' ')) AS lapped
    FROM (SELECT doc_id, idx, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM ov) o JOIN ck c ON c.doc_id = o.doc_id AND c.idx = o.idx + 1)),
ch0 AS (SELECT ck.doc_id, ck.idx AS chunk_index, b_first, b_last, chunk_type, path, ov.text, lapped, array_to_string(path[-2:], ' > ') AS breadcrumb, array_to_string(path, '|') AS section_group_id FROM ck JOIN ov ON ck.doc_id = ov.doc_id AND ck.idx = ov.idx),
ch AS MATERIALIZED (SELECT *, CASE WHEN breadcrumb <> '' THEN breadcrumb || chr(10) || chr(10) || text ELSE text END AS embedding_text, {ntok('text')} AS token_count, printf('%d:v1:%d-%d:%04d:%s', doc_id, b_first, b_last, chunk_index::BIGINT, substr(sha1(text), 1, 8)) AS chunk_id FROM ch0)"""
    )


CHUNKS = chunk_ctes()


def nested(spark, sf):
    return B.with_blocks(view(spark, sf, "v_md").withColumn("version", F.lit("v1")))


def chunks(spark, sf, cfg=CFG):
    return C.build_chunks(nested(spark, sf), cfg)


def big(name):
    return F.col(name).cast("bigint").alias(name)


# --- queries --------------------------------------------------------------------------------------


@query(oracle("v_md", "SELECT doc_id, pos - 1 AS pos, ln AS line FROM lk", letters("v_md")))
def line_table(spark, sf):
    return B.line_table(view(spark, sf, "v_md"))


@query(
    oracle(
        "v_md",
        f"SELECT doc_id, pos - 1 AS pos, length(regexp_extract(ln, '^(#{{1,6}})\\s', 1)) AS heading_level, regexp_matches(ln, '^\\s*[-*+•]\\s') AS is_bullet, regexp_matches(ln, '^\\s*\\d+[.)]\\s') AS is_numbered, regexp_matches(ln, '^`{{3,}}') AS is_fence, regexp_matches(ln, '{_SEP}') AS is_separator, trim(ln, {SP}) = '' AS is_blank FROM lk",
        letters("v_md"),
    )
)
def classify_lines(spark, sf):
    return B.classify_lines(view(spark, sf, "v_md"))


@query(
    oracle(
        "v_md",
        "SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS run_no, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) - 1 AS line_in_run, CASE WHEN kind IN ('code', 'table') THEN kind ELSE 'text' END AS mode FROM (SELECT *, CASE WHEN m = 'B' THEN max(CASE WHEN kind = 'table' THEN run END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) ELSE run0 END AS run FROM (SELECT doc_id, pos, m, kind, run AS run0, run FROM lg) q)".replace(
            "SELECT doc_id, pos, m, kind, run AS run0, run FROM lg", "SELECT doc_id, pos, m, kind, run AS run0 FROM lg"
        ).replace("kind = 'table' THEN run END", "kind = 'table' THEN run0 END"),
        letters("v_md"),
    )
)
def code_table_regions(spark, sf):
    return B.line_regions(view(spark, sf, "v_md"))


@query(oracle("v_md", "SELECT doc_id, block_index, block_type, text FROM blk", BLOCKS))
def build_blocks(spark, sf):
    return B.build_blocks(view(spark, sf, "v_md")).select("doc_id", big("block_index"), "block_type", "text")


@query(oracle("v_md", "SELECT doc_id, block_index, array_to_string(path, ' / ') AS section_path, coalesce(lv, 0) AS heading_level FROM blk", BLOCKS))
def section_path(spark, sf):
    level = F.coalesce("heading_level", F.lit(0)).cast("bigint").alias("heading_level")
    return B.build_blocks(view(spark, sf, "v_md")).select(
        "doc_id", big("block_index"), F.array_join("section_path", " / ").alias("section_path"), level
    )


@query(
    oracle(
        "v_md",
        "SELECT doc_id, " + ", ".join(f"count(*) FILTER (block_type = '{k}') AS {n}" for k, n in [("paragraph", "paragraphs"), ("heading", "headings"), ("list_item", "list_items"), ("table", "tables")]) + ", count(blk.doc_id) AS blocks, 'lossless' AS mode FROM v_md LEFT JOIN blk USING (doc_id) GROUP BY doc_id",
        BLOCKS,
    )
)
def block_stats(spark, sf):
    return B.block_stats(B.with_blocks(view(spark, sf, "v_md")))


@query(
    oracle("v_md", "SELECT doc_id, idx AS chunk_index, b_first, b_last, chunk_type, text FROM ck", CHUNKS)
)
def pack_chunks(spark, sf):
    rows = C.chunk_overlap(C.pack_chunks(nested(spark, sf), CFG), C.ChunkConfig(overlap_tokens=0))
    return rows.select("doc_id", big("chunk_index"), F.col("block_start_index").cast("bigint").alias("b_first"), F.col("block_end_index").cast("bigint").alias("b_last"), "chunk_type", "text")


@query(
    oracle("v_md", "SELECT doc_id, idx AS chunk_index, b_first, b_last, chunk_type, text, array_to_string(path, '|') AS section FROM ck", chunk_ctes(overlap=0, headings=True))
)
def pack_chunks_with_headings(spark, sf):
    rows = C.chunk_overlap(C.pack_chunks(nested(spark, sf), CFG_HEADINGS), CFG_HEADINGS)
    return rows.select("doc_id", big("chunk_index"), F.col("block_start_index").cast("bigint").alias("b_first"), F.col("block_end_index").cast("bigint").alias("b_last"), "chunk_type", "text", F.array_join("section_path", "|").alias("section"))


@query(oracle("v_md", "SELECT doc_id, chunk_index, text, CASE WHEN lapped THEN 20 ELSE 0 END AS overlap_with_prev FROM ch", CHUNKS))
def chunk_overlap(spark, sf):
    rows = chunks(spark, sf)
    return rows.select("doc_id", big("chunk_index"), "text", F.coalesce("overlap_with_prev", F.lit(0)).cast("bigint").alias("overlap_with_prev"))


@query(oracle("v_md", "SELECT doc_id, chunk_index, array_to_string(path, '|') AS section FROM ch", CHUNKS))
def chunk_section(spark, sf):
    return chunks(spark, sf).select("doc_id", big("chunk_index"), F.array_join("section_path", "|").alias("section"))


@query(oracle("v_md", "SELECT doc_id, chunk_index, breadcrumb, section_group_id FROM ch", CHUNKS))
def breadcrumb(spark, sf):
    return chunks(spark, sf).select("doc_id", big("chunk_index"), "breadcrumb", "section_group_id")


@query(oracle("v_md", f"SELECT doc_id, chunk_index, embedding_text, {ntok('embedding_text')} AS embedding_token_count FROM ch", CHUNKS))
def embedding_text(spark, sf):
    return chunks(spark, sf).select("doc_id", big("chunk_index"), "embedding_text", "embedding_token_count")


@query(oracle("v_md", "SELECT chunk_id, token_count FROM ch", CHUNKS))
def chunk_id(spark, sf):
    return chunks(spark, sf).select("chunk_id", "token_count")


@query(oracle("v_md", "SELECT chunk_id, chunk_type, chunk_type = 'table' AS contains_table, chunk_type = 'code' AS contains_code FROM ch", CHUNKS))
def chunk_flags(spark, sf):
    return chunks(spark, sf).select("chunk_id", "chunk_type", "contains_table", "contains_code")


@query(
    oracle("v_md", "SELECT doc_id, count(ch.doc_id) AS chunks, coalesce(round(avg(token_count), 1), 0) AS avg_tokens, count(*) FILTER (chunk_type = 'table') AS tables, count(*) FILTER (chunk_type = 'code') AS codes, count(*) FILTER (chunk_type = 'text') AS text_chunks FROM v_md LEFT JOIN ch USING (doc_id) GROUP BY doc_id", CHUNKS)
)
def chunk_stats(spark, sf):
    return C.chunk_stats(chunks(spark, sf), view(spark, sf, "v_md")).drop("version")


@query(
    oracle("v_md", "SELECT chunk_id, concat_ws(' ', lag(chunk_id) OVER w, lead(chunk_id) OVER w) AS neighbors FROM ch WINDOW w AS (PARTITION BY doc_id, section_group_id ORDER BY chunk_index)", CHUNKS)
)
def section_neighbors(spark, sf):
    near = C.section_neighbors(chunks(spark, sf), 1)
    return near.select("chunk_id", F.array_join("neighbors", " ").alias("neighbors"))


@query(
    oracle(
        "v_md",
        "SELECT rule, violations FROM (SELECT " + ", ".join(f"count(*) * {int(c in ('page_start', 'page_end', 'created_at'))} AS missing_{c}" for c in C.CONTRACT["required_fields"]) + ", count(*) FILTER (chunk_type = 'code') AS enum_chunk_type, count(*) AS enum_doc_id FROM ch) UNPIVOT (violations FOR rule IN (*))",
        CHUNKS,
    )
)
def chunk_contract_check(spark, sf):
    return C.chunk_contract_check(chunks(spark, sf))


_SOFT = "wrapped AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY p) AS text FROM (SELECT doc_id, min(pos) AS p, CASE WHEN kind = 'blank' THEN '' WHEN kind = 'paragraph' THEN string_agg(CASE WHEN first_pos = pos THEN ln ELSE trim(ln, {sp}) END, ' ' ORDER BY pos) ELSE string_agg(ln, chr(10) ORDER BY pos) END AS t FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, run) AS first_pos FROM lg) GROUP BY doc_id, run, kind) GROUP BY doc_id)".replace("{sp}", SP)


@query(oracle("v_md", "SELECT v.doc_id, coalesce(w.text, '') AS text FROM v_md v LEFT JOIN wrapped w ON w.doc_id = v.doc_id", letters("v_md") + ",\n" + _SOFT))
def merge_soft_wraps(spark, sf):
    return view(spark, sf, "v_md").select("doc_id", cleaning.merge_soft_wraps(F.col("text")).alias("text"))


_CLEAN = f"""safe AS (SELECT doc_id, regexp_replace(nfc_normalize(text), '([A-Za-z])-\\r?\\n([a-z])', '\\1\\2', 'g') AS text FROM v_text),
{REPEATED.replace('v_text', 'safe')},
{letters('dedup')},
{_SOFT},
ruled AS (SELECT d.doc_id, regexp_replace(coalesce(w.text, ''), '[Bb]atch (\\d+)', 'B\\1', 'g') AS text FROM dedup d LEFT JOIN wrapped w ON w.doc_id = d.doc_id)"""


@query(oracle("v_text", "SELECT v.doc_id, v.text AS lossless, s.text AS safe, r.text AS aggressive FROM v_text v JOIN safe s ON s.doc_id = v.doc_id JOIN ruled r ON r.doc_id = v.doc_id", _CLEAN))
def clean_modes(spark, sf):
    rules = cleaning.CleaningRules([], [("[Bb]atch (\\d+)", "B\\1")])
    text = F.col("text")
    return view(spark, sf, "v_text").select(
        "doc_id",
        cleaning.clean_text(text, "lossless").alias("lossless"),
        cleaning.clean_text(text, "safe").alias("safe"),
        cleaning.clean_text(text, "aggressive", rules).alias("aggressive"),
    )
