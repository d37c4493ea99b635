"""Token-budget chunks from typed blocks.

Packing is greedy over the blocks of one document. It runs as an ``aggregate`` over small integer structs
inside the document's own row; texts are put together afterwards, so no shuffle is needed and the state
carried per step is a few numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import count_tokens, let, long_fold, rstrip, words


@dataclass(frozen=True)
class ChunkConfig:
    """Packing limits in budget tokens (fixed default values)."""

    target_tokens: int = 800
    max_tokens: int = 1100
    min_tokens: int = 150
    overlap_tokens: int = 80
    include_headings_in_text: bool = False
    embed_with_breadcrumbs: bool = True
    breadcrumb_depth: int = 2
    breadcrumb_joiner: str = " > "
    break_on_heading_level: int = 2


def _spans(blocks: Column, cfg: ChunkConfig) -> Column:
    """Block ranges of the chunks: array of (first, last, raw_first, kind)."""
    span_t = "array<struct<first:int,last:int,raw_first:boolean,kind:string>>"

    def measure(b: Column) -> Column:
        heading = b.block_type == "heading"
        deep = F.coalesce(b.heading_level, F.lit(999)) <= cfg.break_on_heading_level
        skipped = heading & F.lit(not cfg.include_headings_in_text)
        return F.struct(
            b.block_index.alias("i"),
            b.block_type.alias("kind"),
            (heading & deep & F.lit(bool(cfg.break_on_heading_level))).alias("cuts"),
            skipped.alias("skipped"),
            b.block_type.isin("table", "code").alias("alone"),
            F.when(skipped, F.lit(0).cast("bigint")).otherwise(count_tokens(b.text)).alias("n"),
        )

    def span(first: Column, last: Column, raw: Column, kind: Column) -> Column:
        return F.array(F.struct(first.alias("first"), last.alias("last"), raw.alias("raw_first"), kind.alias("kind")))

    start = {"buf": F.lit(0).cast("bigint"), "first": F.lit(0), "last": F.lit(0), "raw": F.lit(False)}
    nothing = F.array().cast(span_t)
    text = F.lit("text")

    def step(s: Column, b: Column) -> Column:
        # A cutting heading empties the buffer first, also where headings themselves are packed.
        held = F.when(b.cuts, F.lit(0).cast("bigint")).otherwise(s.buf)
        plain = ~b.skipped & ~b.alone
        overfull = plain & (held > 0) & (held + b.n > cfg.max_tokens) & (held >= cfg.min_tokens)
        closes = (s.buf > 0) & (b.cuts | b.alone | overfull)
        opens = overfull | (held == 0)
        filled = F.when(b.skipped, held).when(b.alone, F.lit(0).cast("bigint")).when(opens, b.n).otherwise(held + b.n)
        full = plain & (filled >= cfg.target_tokens)
        first = F.when(plain & opens, b.i).otherwise(s["first"])
        last = F.when(plain, b.i).otherwise(s["last"])
        raw = F.when(plain & opens, overfull).otherwise(s.raw)
        out = F.concat(
            s.out,
            F.when(closes, span(s["first"], s["last"], s.raw, text)).otherwise(nothing),
            F.when(b.alone, span(b.i, b.i, F.lit(True), b.kind)).when(full, span(first, last, raw, text)).otherwise(nothing),
        )
        return F.struct(
            F.when(full, F.lit(0).cast("bigint")).otherwise(filled).alias("buf"),
            first.alias("first"),
            last.alias("last"),
            raw.alias("raw"),
            out.alias("out"),
        )

    def finish(s: Column) -> Column:
        return F.when(s.buf > 0, F.concat(s.out, span(s["first"], s["last"], s.raw, text))).otherwise(s.out)

    return let(F.transform(blocks, measure), lambda measured: long_fold(measured, start, span_t, step, finish))


def _assemble(blocks: Column, spans: Column, cfg: ChunkConfig) -> Column:
    """Chunk structs with joined text and section; still without overlap."""

    def chunk(sp: Column) -> Column:
        def from_parts(parts: Column) -> Column:
            body = F.array_join(
                F.transform(
                    parts,
                    lambda b, i: F.when((i == 0) & sp.raw_first, b.text).otherwise(rstrip(b.text)),
                ),
                "\n\n",
            )
            content = F.filter(parts, lambda b: b.block_type != "heading")
            path = F.coalesce(F.get(content, F.lit(0)).section_path, F.get(parts, F.lit(0)).section_path)
            return F.struct(
                sp["first"].alias("block_start_index"),
                sp["last"].alias("block_end_index"),
                sp.kind.alias("chunk_type"),
                body.alias("text"),
                path.alias("section_path"),
            )

        picked = F.slice(blocks, sp["first"] + 1, sp["last"] - sp["first"] + 1)
        if not cfg.include_headings_in_text:
            picked = F.filter(picked, lambda b: b.block_type != "heading")
        return let(picked, from_parts)

    return F.transform(spans, chunk)


def _overlap_prefixes(chunks: Column, n: int) -> Column:
    """Per chunk the words to repeat from the chunk before it (already prefixed), or null."""

    def last_words(a: Column, k: int) -> Column:
        return F.when(F.size(a) > k, F.slice(a, F.lit(-k), F.lit(k))).otherwise(a)

    def tail(c: Column) -> Column:
        return F.struct(
            c.text.alias("text"),
            (c.chunk_type == "text").alias("plain"),
            let(words(c.text), lambda w: last_words(w, n + 1)).alias("own"),
        )

    start = {"carry": F.array().cast("array<string>")}

    def step(s: Column, c: Column) -> Column:
        def extend(prefix: Column) -> Column:
            carried = F.when(prefix.isNull(), c.own).otherwise(
                let(F.concat(last_words(s.carry, n), c.own), lambda w: last_words(w, n + 1))
            )
            return F.struct(carried.alias("carry"), F.concat(s.out, F.array(prefix)).alias("out"))

        repeat = F.when(c.plain & (F.size(s.carry) > n), F.array_join(last_words(s.carry, n), " "))
        return let(let(repeat, lambda r: F.when(~c.text.startswith(r), r)), extend)

    return let(F.transform(chunks, tail), lambda tails: long_fold(tails, start, "array<string>", step))


def pack_chunks(nested: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks before overlap, one row per document in ``chunks``; input carries ``blocks``."""
    keys = [c for c in ("doc_id", "version") if c in nested.columns]
    chunks = let(F.col("blocks"), lambda b: let(_spans(b, cfg), lambda spans: _assemble(b, spans, cfg)))
    return nested.select(*keys, chunks.alias("chunks"))


def chunk_overlap(packed: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Explode packed chunks, giving each text chunk the tail of its predecessor."""
    keys = [c for c in ("doc_id", "version") if c in packed.columns]
    n = cfg.overlap_tokens

    def paired(chunks: Column, prefixes: Column | None) -> Column:
        def full(c: Column, i: Column) -> Column:
            prefix = F.get(prefixes, i) if prefixes is not None else F.lit(None).cast("string")
            return F.struct(
                c.block_start_index.alias("block_start_index"),
                c.block_end_index.alias("block_end_index"),
                c.chunk_type.alias("chunk_type"),
                c.section_path.alias("section_path"),
                F.when(prefix.isNull(), c.text).otherwise(F.concat(prefix, F.lit("\n\n"), c.text)).alias("text"),
                F.when(prefix.isNotNull(), F.lit(n)).alias("overlap_with_prev"),
            )

        return F.transform(chunks, full)

    if n > 0:
        z = let(F.col("chunks"), lambda ch: let(_overlap_prefixes(ch, n), lambda ps: paired(ch, ps)))
    else:
        z = paired(F.col("chunks"), None)
    return packed.select(*keys, F.posexplode(z).alias("chunk_index", "z")).select(*keys, "chunk_index", "z.*")


def breadcrumb(path: Column, depth: int = 2, joiner: str = " > ") -> Column:
    """The last ``depth`` titles of a section path."""
    return F.coalesce(
        F.when(F.size(path) > depth, F.array_join(F.slice(path, F.lit(-depth), F.lit(depth)), joiner)).otherwise(
            F.array_join(path, joiner)
        ),
        F.lit(""),
    )


def section_group_id(path: Column) -> Column:
    return F.coalesce(F.array_join(path, "|"), F.lit(""))


def embedding_text(crumb: Column, text: Column, enabled: bool = True) -> Column:
    return F.when(F.lit(enabled) & (crumb != ""), F.concat(crumb, F.lit("\n\n"), text)).otherwise(text)


def chunk_id(doc_id: Column, version: Column, first: Column, last: Column, index: Column, text: Column) -> Column:
    return F.format_string(
        "%s:%s:%d-%d:%04d:%s", doc_id.cast("string"), version, first, last, index, F.substring(F.sha1(text), 1, 8)
    )


def finalize_chunks(rows: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Full chunk records: ids, token counts, breadcrumbs, embedding text and flags."""
    crumbed = rows.withColumns(
        {
            "breadcrumb": breadcrumb(F.col("section_path"), cfg.breadcrumb_depth, cfg.breadcrumb_joiner),
            "section_group_id": section_group_id(F.col("section_path")),
        }
    ).withColumn("embedding_text", embedding_text(F.col("breadcrumb"), F.col("text"), cfg.embed_with_breadcrumbs))
    version = F.col("version") if "version" in rows.columns else F.lit("")
    return crumbed.withColumns(
        {
            "chunk_id": chunk_id(
                F.col("doc_id"), version, F.col("block_start_index"), F.col("block_end_index"), F.col("chunk_index"), F.col("text")
            ),
            "token_count": count_tokens(F.col("text")),
            "embedding_token_count": count_tokens(F.col("embedding_text")),
            "contains_table": F.col("chunk_type") == "table",
            "contains_code": F.col("chunk_type") == "code",
        }
    )


def build_chunks(nested: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Blocks (nested) to finished chunk records in one narrow stage."""
    return finalize_chunks(chunk_overlap(pack_chunks(nested, cfg), cfg), cfg)


def chunk_stats(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunk counts of every document of ``docs``, zeros for documents without chunks."""

    def count(kind: str) -> Column:
        return F.count_if(F.col("chunk_type") == kind)

    keys = [c for c in ("doc_id", "version") if c in chunks.columns and c in docs.columns]
    counted = chunks.groupBy(*keys).agg(
        F.count("*").alias("chunks"),
        F.round(F.avg("token_count"), 1).alias("avg_tokens"),
        count("table").alias("tables"),
        count("code").alias("codes"),
        count("text").alias("text_chunks"),
    )
    return docs.select(*keys).join(counted, keys, "left").fillna(0, ["chunks", "avg_tokens", "tables", "codes", "text_chunks"])


def section_neighbors(chunks: DataFrame, n: int = 1) -> DataFrame:
    """For every chunk the chunks up to ``n`` places away within its section group.

    The window key is one section of one document, so its size is bounded by a document.
    """
    w = W.partitionBy("doc_id", "section_group_id").orderBy("chunk_index")
    steps = [F.lag("chunk_id", k).over(w) for k in range(n, 0, -1)] + [F.lead("chunk_id", k).over(w) for k in range(1, n + 1)]
    return chunks.select(
        "doc_id", "section_group_id", "chunk_index", "chunk_id", F.array_compact(F.array(*steps)).alias("neighbors")
    )


# The declared chunk contract.
CONTRACT = {
    "required_fields": ["chunk_id", "doc_id", "version", "page_start", "page_end", "section_path", "chunk_type", "created_at"],
    "enums": {
        "chunk_type": ["text", "table", "figure", "other"],
        "doc_id": ["DOC01", "DOC02", "DOC03", "DOC04", "DOC05", "DOC06"],
    },
}


def chunk_contract_check(chunks: DataFrame, contract: dict | None = None) -> DataFrame:
    """Violation counts per rule in long form: one pass, combined map-side. An absent column is missing in every row."""
    contract = contract or CONTRACT
    rules = {}
    for name in contract["required_fields"]:
        value = F.col(name) if name in chunks.columns else F.lit(None)
        rules[f"missing_{name}"] = F.count_if(value.isNull())
    for name, allowed in contract["enums"].items():
        rules[f"enum_{name}"] = F.count_if(~F.col(name).cast("string").isin(allowed))
    counted = chunks.agg(*[agg.alias(rule) for rule, agg in rules.items()])
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations")) for rule in rules])
    return counted.select(F.inline(pairs))
