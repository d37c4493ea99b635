"""Retrieval: the documents are the corpus, the benchmark items the questions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..operators import chat as M
from ..operators import retrieval as R
from ..session import materialize, shared_dir
from .block_queries import CHUNKS
from .block_queries import CFG as CHUNK_CFG
from ..operators import blocks as B
from ..operators import chunks as C
from .fixtures import oracle, sql, table, view
from .registry import query
from .text_queries import SP

# --- check SQL ------------------------------------------------------------------------------------

BM25 = """tok AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) t ON t.doc_id = d.doc_id),
tot AS MATERIALIZED (SELECT count(*) AS n_docs, sum(n) / count(*) AS avgdl FROM dl),
df AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT n_docs FROM tot) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY term),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df)"""

TOPK = """qt AS (SELECT query_id, sub_id, unnest(regexp_extract_all(lower(q), '[a-z0-9_]+')) AS term FROM v_query),
bs AS MATERIALIZED (SELECT query_id, sub_id, tf.doc_id AS chunk_id, round(sum(idf.idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl.n / (SELECT avgdl FROM tot)))), 9) AS score FROM qt JOIN tf ON tf.term = qt.term JOIN idf ON idf.term = qt.term JOIN dl ON dl.doc_id = tf.doc_id GROUP BY ALL),
br AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, sub_id ORDER BY score DESC, chunk_id) AS rank FROM bs QUALIFY rank <= 50)"""

_NORM = "sqrt(list_inner_product(e, e))"
VEC = f"""vn AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vs AS (SELECT q.vec_id AS query_id, s.sub_id, c.vec_id AS chunk_id, round(list_inner_product(q.e, c.e) / ({_NORM.replace('e, e', 'q.e, q.e')} * {_NORM.replace('e, e', 'c.e, c.e')}), 9) AS score FROM vn q JOIN (SELECT DISTINCT query_id, sub_id FROM v_query) s ON s.query_id = q.vec_id CROSS JOIN vn c),
vr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, sub_id ORDER BY score DESC, chunk_id) AS rank FROM vs QUALIFY rank <= 50)"""

RANKS = f"""{BM25},
{TOPK},
{VEC},
ranks AS (SELECT query_id, sub_id, 1 AS source_no, chunk_id, rank FROM vr UNION ALL SELECT query_id, sub_id, 2, chunk_id, rank FROM br)"""

POOL = f"""{RANKS},
pool AS MATERIALIZED (SELECT query_id, chunk_id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS position FROM (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min({{'a': sub_id, 'b': source_no, 'c': rank}}) AS seen FROM ranks GROUP BY ALL))"""


# --- inputs ---------------------------------------------------------------------------------------


def corpus(spark, sf):
    """Documents as chunks; the source serves as breadcrumb."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("breadcrumb"), F.array("source").alias("section_path"), "text"
    )


#: Stores of this process by application, table and its files.
_STORES: dict[tuple, str] = {}


def lexical(spark, sf):
    """The index of all documents, built once per session for the table's files as they are and read by every question after that."""
    meta = F.col("_metadata")
    files = table(spark, sf, "documents").select(meta["file_path"].alias("p"), meta["file_size"].alias("s"), meta["file_modification_time"].cast("string").alias("m")).distinct()
    key = (spark.sparkContext.applicationId, *sorted(map(tuple, files.collect())))
    if key not in _STORES:
        path = shared_dir(spark, "lexical")
        R.bm25_index(corpus(spark, sf).select("chunk_id", "text"), store=path)
        _STORES[key] = path
    return R.LexicalStore(spark, _STORES[key]).index()


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def query_vectors(spark, sf):
    subs = view(spark, sf, "v_query").select("query_id", "sub_id")
    return subs.join(vectors(spark, sf).withColumnRenamed("chunk_id", "query_id"), "query_id")


def rank_lists(spark, sf):
    """Both searches write steps of their own, so their jobs are submitted side by side."""
    asked = view(spark, sf, "v_query"), query_vectors(spark, sf)
    with ThreadPoolExecutor(1) as other:
        by_vector = other.submit(inheritable_thread_target(spark)(lambda: R.vector_topk(asked[1], vectors(spark, sf))))
        by_terms = R.bm25_topk(asked[0], lexical(spark, sf))
        return by_vector.result().unionByName(by_terms)


def pool(spark, sf):
    return R.hybrid_pool(rank_lists(spark, sf))


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- queries --------------------------------------------------------------------------------------


def dealt(spark, sf):
    """A vector for each document: those of the table in turn."""
    own = table(spark, sf, "embeddings")
    n = own.count()
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % n).alias("vec_id")).join(own, "vec_id").select("chunk_id", "embedding")


@query(
    oracle(
        "",
        "SELECT d.doc_id AS chunk_id, md5(CASE WHEN d.doc_id % 2 = 0 THEN d.source || ': ' || d.text ELSE d.text END) AS indexed, CAST(len(v.embedding) AS BIGINT) AS dim, round(e[1] / n, 6) AS first, round(e[len(e)] / n, 6) AS last FROM documents d JOIN (SELECT *, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(e, e)) AS n FROM embeddings) v ON v.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)",
    )
)
def vector_index(spark, sf):
    """Every second document has an embedding text of its own; documents share the vectors of the table in turn."""
    text = F.when(F.col("chunk_id") % 2 == 0, F.concat("breadcrumb", F.lit(": "), F.col("text"))).otherwise(F.lit(""))
    ix = R.vector_index(corpus(spark, sf).withColumn("embedding_text", text), dealt(spark, sf))
    e = F.col("embedding")
    return ix.select("chunk_id", F.md5("indexed_text").alias("indexed"), F.size(e).cast("bigint").alias("dim"), F.round(e[0], 6).alias("first"), F.round(F.element_at(e, -1), 6).alias("last"))


@query(oracle("", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"))
def missing_vectors(spark, sf):
    """Documents that have no vector of their own number."""
    return R.missing_vectors(corpus(spark, sf), vectors(spark, sf))


@query(oracle("v_query", "SELECT query_id, sub_id, chunk_id, rank, round(score, 6) AS score FROM vr", VEC))
def vector_topk(spark, sf):
    ranks = R.vector_topk(query_vectors(spark, sf), vectors(spark, sf))
    return ranks.select("query_id", *big("sub_id"), "chunk_id", *big("rank"), F.round("score", 6).alias("score"))


@query(oracle("", "SELECT term, df, round(idf, 6) AS idf FROM idf", BM25))
def bm25_index(spark, sf):
    """Built anew: the time of a whole index."""
    return R.bm25_index(corpus(spark, sf).select("chunk_id", "text")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(oracle("v_query", "SELECT query_id, sub_id, chunk_id, rank, round(score, 6) AS score FROM br", BM25 + ",\n" + TOPK))
def bm25_topk(spark, sf):
    ranks = R.bm25_topk(view(spark, sf, "v_query"), lexical(spark, sf))
    return ranks.select("query_id", *big("sub_id"), "chunk_id", *big("rank"), F.round("score", 6).alias("score"))


@query(
    oracle(
        "v_query",
        "SELECT r.query_id, r.sub_id, r.source_no, r.chunk_id, r.rank FROM ranks r JOIN documents d ON d.doc_id = r.chunk_id WHERE r.query_id NOT IN (SELECT item_id FROM benchmark WHERE length(text) > 200) OR d.source IN (concat('src', r.query_id % 20), concat('src', (r.query_id + 1) % 20))",
        RANKS,
    )
)
def doc_filter(spark, sf):
    """Longer questions name two sources each; the others name none and are not filtered."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_source"))
    allow = sql(spark, sf, "SELECT item_id AS query_id, explode(array(concat('src', item_id % 20), concat('src', (item_id + 1) % 20))) AS doc_source FROM benchmark WHERE length(text) > 200")
    ranks = materialize(rank_lists(spark, sf).select(*R.QUERY_KEYS, "source", "chunk_id", "rank"), "ranks").join(docs, "chunk_id")
    kept = R.doc_filter(ranks, allow, by="doc_source")
    source_no = F.when(F.col("source") == "vec", 1).otherwise(2)
    return kept.select("query_id", *big("sub_id"), source_no.cast("bigint").alias("source_no"), "chunk_id", *big("rank"))


@query(oracle("v_query", "SELECT query_id, sub_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ranks GROUP BY ALL", RANKS))
def rrf(spark, sf):
    fused = R.rrf(rank_lists(spark, sf))
    return fused.select("query_id", *big("sub_id"), "chunk_id", F.round("score", 6).alias("score"))


@query(oracle("v_query", "SELECT query_id, chunk_id, position, round(score, 6) AS score FROM pool", POOL))
def hybrid_pool(spark, sf):
    return pool(spark, sf).select("query_id", "chunk_id", *big("position"), F.round("score", 6).alias("score"))


@query(
    oracle(
        "v_query",
        f"SELECT query_id, position, chunk_id, printf('[%d] %d | %s | chunk_id=%d | score=%.4f', position, chunk_id, source, chunk_id, score) AS header, CASE WHEN length(t) > 600 THEN substr(t, 1, 600) || ' …' ELSE t END AS shown FROM (SELECT p.*, d.source, replace(trim(d.text, {SP}), chr(13), '') AS t FROM pool p JOIN documents d ON d.doc_id = p.chunk_id WHERE position <= 8)",
        POOL,
    )
)
def ranked_results(spark, sf):
    shown = R.ranked_results(pool(spark, sf), corpus(spark, sf))
    return shown.select("query_id", *big("position"), "chunk_id", "header", "shown")


@query(
    oracle(
        "v_query",
        f"SELECT query_id, to_json(list({{'chunk_id': CAST(chunk_id AS VARCHAR), 'breadcrumb': d.source, 'doc_id': CAST(chunk_id AS VARCHAR), 'snippet': substr(replace(trim(d.text, {SP}), chr(13), ''), 1, 400)}} ORDER BY position)) AS candidates FROM pool JOIN documents d ON d.doc_id = chunk_id WHERE position <= 50 GROUP BY query_id",
        POOL,
    )
)
def rerank_candidates(spark, sf):
    return R.rerank_candidates(pool(spark, sf), corpus(spark, sf))


PACKED = f"""{POOL},
sized AS (SELECT query_id, position, chunk_id, d.source, '[' || chunk_id || '] ' || d.source || chr(10) || d.text || chr(10) AS block, sum(length('[' || chunk_id || '] ' || d.source || chr(10) || d.text || chr(10))) OVER (PARTITION BY query_id ORDER BY position) AS used FROM pool JOIN documents d ON d.doc_id = chunk_id),
packed AS (SELECT query_id, string_agg(block, chr(10) || '---' || chr(10) ORDER BY position) AS context, count(*) AS included, CAST(max(used) AS BIGINT) AS chars, to_json(list({{'chunk_id': CAST(chunk_id AS VARCHAR), 'breadcrumb': source}} ORDER BY position)) AS sources FROM sized WHERE used <= 24000 GROUP BY query_id)"""


def packed(spark, sf):
    chosen = pool(spark, sf)
    return R.pack_context(chosen, corpus(spark, sf))


@query(oracle("v_query", "SELECT query_id, md5(context) AS context, included, chars FROM packed", PACKED))
def pack_context(spark, sf):
    return packed(spark, sf).select("query_id", F.md5("context").alias("context"), "included", "chars")


@query(oracle("v_query", "SELECT query_id, sources FROM packed", PACKED))
def answer_sources(spark, sf):
    return packed(spark, sf).select("query_id", F.to_json("sources").alias("sources"))


# --- from markdown to context, with documents that change ------------------------------------------

_EDITED = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN concat(text, chr(10), chr(10), 'Edited document ', doc_id) ELSE text END AS text FROM v_md WHERE doc_id % 25 <> 3"

REFRESHED = f"""v_new AS MATERIALIZED ({_EDITED}),
{CHUNKS.replace("v_md", "v_new")},
idx AS MATERIALIZED (SELECT chunk_id AS doc_id, embedding_text AS text FROM ch),
{BM25.replace("documents", "idx")},
{TOPK},
lexpool AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min({{'a': sub_id, 'c': rank}}) AS seen FROM br GROUP BY ALL),
placed AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS position FROM lexpool),
blocked AS (SELECT query_id, position, '[' || chunk_id || '] ' || CASE WHEN breadcrumb <> '' THEN breadcrumb ELSE array_to_string(path, ' > ') END || chr(10) || ch.text || chr(10) AS block FROM placed JOIN ch USING (chunk_id)),
fitting AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY position) AS used FROM blocked)"""


def refreshed(spark, sf):
    """A store of all markdown documents, then of its changes: every tenth document edited, every twenty-fifth gone."""
    def built(docs):
        return C.build_chunks(B.with_blocks(docs.withColumn("version", F.lit("v1"))), CHUNK_CFG)

    def indexed(chunks):
        return chunks.select("chunk_id", "doc_id", R.index_text(F.col("embedding_text"), F.col("text")).alias("text"))

    docs = view(spark, sf, "v_md")
    edited = sql(spark, sf, _EDITED.replace("chr(10)", "'\\n'"))
    changed = docs.where("doc_id % 10 = 0 OR doc_id % 25 = 3").select("doc_id")
    before = materialize(built(docs), "chunks")
    after = materialize(built(edited.join(changed, "doc_id", "left_semi")), "chunks")
    store = R.LexicalStore(spark, shared_dir(spark, "lexical")).add(indexed(before))
    store.replace(indexed(after), changed).merge(fan=2)
    records = before.join(changed, "doc_id", "left_anti").unionByName(after)
    return store, R.store_chunks(records, shared_dir(spark, "chunks"), buckets=8)


@query(oracle("v_md v_query", "SELECT query_id, md5(string_agg(block, chr(10) || '---' || chr(10) ORDER BY position)) AS context, count(*) AS included, CAST(max(used) AS BIGINT) AS chars FROM fitting WHERE used <= 24000 GROUP BY query_id", REFRESHED))
def refreshed_context(spark, sf):
    """Markdown to blocks, chunks, index, ranks and context, over a store whose documents changed; the SQL starts from the changed ones."""
    store, records = refreshed(spark, sf)
    pool = R.hybrid_pool(R.bm25_topk(view(spark, sf, "v_query"), store.index()))
    return R.pack_context(pool, records).select("query_id", F.md5("context").alias("context"), "included", "chars")


@query(oracle("v_query", "SELECT query_id, sub_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sub_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, sub_id, chunk_id, score FROM br UNION ALL SELECT query_id, sub_id, doc_id, 0.0 FROM (SELECT DISTINCT query_id, sub_id FROM v_query), (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50) WHERE (query_id, sub_id, doc_id) NOT IN (SELECT (query_id, sub_id, chunk_id) FROM br))) WHERE rank <= 50", BM25 + ",\n" + TOPK))
def bm25_padded(spark, sf):
    """Lists of fifty for every question, filled up with chunks that match nothing."""
    asked = view(spark, sf, "v_query")
    padded = R.pad_zero(R.bm25_topk(asked, lexical(spark, sf)), asked, corpus(spark, sf))
    return padded.select("query_id", *big("sub_id"), "chunk_id", *big("rank"), F.round("score", 6).alias("score"))


@query(oracle("v_query", "SELECT query_id, to_json(list({'chunk_id': CAST(chunk_id AS VARCHAR), 'breadcrumb': source} ORDER BY position)[1:8]) AS sources FROM sized WHERE used <= 24000 GROUP BY query_id", PACKED))
def answer_sources_capped(spark, sf):
    return R.capped_sources(packed(spark, sf), top=2).select("query_id", F.to_json("sources").alias("sources"))


_PROMPTS = "SELECT conv_id AS query_id, CAST(turn AS INT) AS sub_id, text AS q FROM conversations WHERE role = 'user'"

ANSWERED = f"""v_query AS MATERIALIZED ({_PROMPTS}),
{BM25},
{TOPK},
found AS (SELECT query_id, sub_id, list({{'chunk_id': CAST(chunk_id AS VARCHAR), 'breadcrumb': d.source}} ORDER BY rank) AS sources, arg_min(substr(replace(trim(d.text, {SP}), chr(13), ''), 1, 280), rank) AS answer FROM br JOIN documents d ON d.doc_id = br.chunk_id WHERE rank <= 3 GROUP BY ALL)"""


@query(oracle("", "SELECT p.query_id AS chat_id, p.sub_id AS turn, CASE WHEN p.sub_id % 4 <> 2 THEN coalesce(answer, '') ELSE '' END AS content, CASE WHEN p.sub_id % 4 <> 2 AND coalesce(answer, '') <> '' THEN CAST(to_json(sources) AS VARCHAR) ELSE '[]' END AS sources, 'text' AS type FROM v_query p LEFT JOIN found f ON f.query_id = p.query_id AND f.sub_id = p.sub_id", ANSWERED))
def reply_with_sources(spark, sf):
    """Replies to all prompts: the beginning of the best document and the three best as sources; some answers are not used."""
    asked = sql(spark, sf, _PROMPTS)
    ranks = R.bm25_topk(asked, lexical(spark, sf), k=3)
    texts = R.with_chunks(ranks.select(*R.QUERY_KEYS, "chunk_id", "rank"), corpus(spark, sf).select("chunk_id", "breadcrumb", "text"))
    entry = F.struct("rank", F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), "breadcrumb").alias("source"))
    found = texts.groupBy(*R.QUERY_KEYS).agg(F.array_sort(F.collect_list(entry)).alias("l"), F.min_by(snippet(F.col("text"), 280), "rank").alias("answer_md"))
    rows = asked.select(*R.QUERY_KEYS).join(found, R.QUERY_KEYS, "left").select(
        "*", F.col("l.source").alias("sources"), (F.col("sub_id") % 4 != 2).alias("answer_used"), F.lit("none").alias("intake_action"), F.lit(0).alias("surveys_prepared"), F.lit("insights").alias("stage"), F.lit("").alias("question")
    )
    made = M.assemble_reply(rows)
    return made.select(F.col("query_id").alias("chat_id"), F.col("sub_id").alias("turn"), "content", F.to_json("sources").alias("sources"), "type")
