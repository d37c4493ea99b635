"""One query per operator over its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_names, embedding_dedup, fingerprints, licenses, mixing, near_dedup, negatives, packing, quality, rans, sharding, trie, warc
from .common import WORD, shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Production parameters.
SHARD_BYTES = 1 << 20


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


@query(f"""
WITH placed AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
         lpad(bin(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
prefixes AS (SELECT doc_id, bytes, d, left(bits, d::INT) AS shard FROM placed, range(0, 61) r(d)),
sums AS (SELECT shard, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM prefixes GROUP BY shard),
fitting AS (
  SELECT doc_id, d AS depth, shard, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS n
  FROM prefixes JOIN sums USING (shard) WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1)
SELECT doc_id, shard, depth, shard_bytes, shard_docs, shard_bytes > {SHARD_BYTES} AS oversized FROM fitting WHERE n = 1
""")
def op9_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return sharding.assign_shards(docs, "doc_id", "size", SHARD_BYTES).drop("size")


@query("""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 / ((rank - 1) % 3 + 1) AS room FROM ranked),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER (ORDER BY room, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / (sum(weight) OVER (ORDER BY room, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least((SELECT level FROM levels WHERE level <= room ORDER BY room, rank LIMIT 1) * weight, (3 * source_size)::DOUBLE) AS target
  FROM levels),
timed AS (
  SELECT doc_id, size, place, t.source_size, t.target,
         (sum(size) OVER (PARTITION BY s.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, size, (pass * source_size + upto) / target AS finish, place, pass
  FROM timed, range(0, 3) p(pass) WHERE size > 0 AND pass * source_size + upto - size < target),
served AS (SELECT *, sum(size) OVER (ORDER BY finish, place, pass ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM copies),
taken AS (SELECT doc_id, count(*) AS copies, sum(size)::BIGINT AS taken FROM served WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT doc_id, timed.size AS size, source_size, target, coalesce(copies, 0)::INT AS copies, coalesce(taken, 0)::BIGINT AS taken
FROM timed LEFT JOIN taken USING (doc_id)
""")
def op5_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return mixing.mix(docs).drop("source")


@query()
def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op10_token_file(spark, sf_dir):
    path = shared_path(spark, "token-file")
    rans.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return rans.read_ids(spark, path, with_ids=False)


@query()
def op3_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query("""
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS newest FROM sized)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND newest IS NOT NULL AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND newest IS NOT NULL AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM newest
""")
def op4_warc(spark, sf_dir):
    path = shared_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)

    def page(c):
        return F.regexp_extract(F.col(c), "^<urn:page:(-?\\d+)>$", 1).try_cast("long")

    return warc.read_warc(spark, path).select(page("record").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page("refers").alias("refers_to"))


@query()
def op2_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN least USING (vec_id)
""")
def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
""")
def op1_minhash_dedup(spark, sf_dir):
    return near_dedup.near_documents(table(spark, sf_dir, "documents"))


@query()
def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels"), carry=False)


@query("""
WITH ints AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM ints a JOIN ints b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""")
def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    relabelled = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(relabelled, F.col("vec_id") % 50 == 0)


@query("""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY i) AS l FROM turns GROUP BY c),
hashed AS (
  SELECT c, l, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: [ascii(s)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                               lambda crc, x: xor(xor(crc, x) >> 1, (xor(crc, x) & 1) * 3988292384)), 4294967295::BIGINT) % 6 AS h
  FROM own),
rebuilt AS (SELECT a.c, coalesce(b.l, [])[1:a.h] || a.l[a.h + 1:] AS l FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 100),
paths AS (SELECT c, len(l) AS total, d, l[1:d] AS path, l[d] AS last FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * length(coalesce(any_value(last.text), '')) AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (total = d), '')) AS ends_sha256
  FROM paths GROUP BY d, path),
up AS (SELECT d, path, conv_id, unnest(range(0, d + 1)) AS a, saved, len(path) AS n FROM nodes),
leaves AS (SELECT d, path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes m WHERE m.d = n.d + 1 AND m.path[1:n.d] = n.path)),
sums AS (SELECT a, path[1:a] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (d = a + 1) AS n_children, count(*) FILTER (EXISTS (SELECT 1 FROM leaves f WHERE f.d = up.d AND f.path = up.path)) AS n_leaves FROM up GROUP BY a, path[1:a])
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.a = n.d AND s.path = n.path LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
""")
def op12_prefix_trie(spark, sf_dir):
    conv = F.col("conv")
    shared = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(6))
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), conv - conv % 100, shared, 5)


@query("""
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
named AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM normal)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM named
""")
def op13_exact_dedup(spark, sf_dir):
    return block_names.exact_duplicates(table(spark, sf_dir, "documents"))
