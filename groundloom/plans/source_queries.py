"""Scans, manifests, conversion and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import iso_z
from ..session import shared_dir
from ..sources import files, pages
from .fixtures import oracle, sql, table
from .registry import query

_MARK = "CASE doc_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN 'Yes' WHEN 3 THEN '0' ELSE '1' END"


@query(f"SELECT doc_id, source AS filename FROM documents WHERE lower({_MARK}) IN ('true', '1', 'yes')")
def registry_scan(spark, sf):
    """Documents as a registry; only the entries marked current."""
    registry = sql(spark, sf, f"SELECT doc_id, source AS filename, {_MARK} AS is_current FROM documents")
    return files.registry_scan(registry).drop("is_current")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN sha256(d.text) ELSE 'old' END AS checksum FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def checksum_refresh(spark, sf):
    """Labelled documents are the files that exist."""
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id"))
    registry = docs.select("doc_id", name.alias("filename"), F.lit("old").alias("checksum"))
    present = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").select(name.alias("filename"), F.col("text").alias("content"))
    return files.checksum_refresh(registry, present).select("doc_id", "checksum")


@query("SELECT doc_id, lang AS version, source AS filename, CAST(octet_length(encode(text)) AS BIGINT) AS bytes_markdown, sha256(text) AS checksum, '2024-01-01T00:00:00Z' AS converted_at FROM documents")
def ingest_manifest(spark, sf):
    docs = table(spark, sf, "documents").withColumnsRenamed({"lang": "version", "source": "filename"})
    return files.ingest_manifest(docs, iso_z(F.lit("2024-01-01").cast("timestamp_ntz")))


def _html_oracle() -> str:
    expr = "html"
    for pattern, replacement in pages._DROP + pages._MARK:
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\xa0"), ("&amp;", "&")]:
        expr = f"replace({expr}, '{entity}', '{char}')"
    for pattern, replacement in pages._TIDY:
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"
    return f"SELECT page_id, url, {expr} AS text FROM pages"


@query(_html_oracle())
def html_to_markdown(spark, sf):
    return pages.pages_to_markdown(table(spark, sf, "pages"))


_VERSIONS = "SELECT doc_id // 3 AS doc_id, concat('D', doc_id // 3, '_', printf('%08d', doc_id), '.md') AS filename, length(text) AS n_text, text FROM documents"


@query(f"SELECT doc_id, filename, text FROM ({_VERSIONS}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY filename DESC) = 1")
def latest_version(spark, sf):
    """Three versions of each logical document."""
    versions = sql(spark, sf, "SELECT doc_id DIV 3 AS doc_id, concat('D', doc_id DIV 3, '_', format_string('%08d', doc_id), '.md') AS filename, text FROM documents")
    return files.latest_version(versions)




@query(
    "SELECT event_id, CAST(json_extract_string(line, '$.k') AS BIGINT) AS k, coalesce(array_to_string(CAST(json_extract_string(line, '$.section_path[*]') AS VARCHAR[]), '|'), '') AS section_group_id, '' AS breadcrumb FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{bad' WHEN 1 THEN '   ' WHEN 2 THEN concat('{\"section_path\": [\"', event_type, '\", \"x\"], \"k\": ', json_extract_string(props, '$.k'), '}') ELSE props END AS line FROM events) WHERE CASE WHEN json_valid(line) THEN true ELSE false END"
)
def tolerant_jsonl_scan(spark, sf):
    """Event properties as JSON lines, with malformed and blank ones mixed in."""
    raw = sql(
        spark,
        sf,
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{bad' WHEN 1 THEN '   ' WHEN 2 THEN concat('{\"section_path\": [\"', event_type, '\", \"x\"], \"k\": ', get_json_object(props, '$.k'), '}') ELSE props END AS value FROM events",
    )
    schema = T.StructType.fromDDL("k bigint, section_path array<string>, section_group_id string, breadcrumb string")
    return files.parse_jsonl(raw, schema).drop("section_path")


@query("SELECT doc_id, source AS version FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0 AND d.source <> 'src0')")
def pending_work(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("version"))
    done = docs.join(table(spark, sf, "labels").filter("toxic = 0"), "doc_id").filter("version <> 'src0'")
    return files.pending_work(docs, done)


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sink_round_trip(spark, sf):
    """Documents written by bucket and read back."""
    out = shared_dir(spark, "documents")
    files.write_by_document(table(spark, sf, "documents").select("doc_id", "text"), out, buckets=8)
    return spark.read.parquet(out).select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))


@query(
    "SELECT ts, event_type AS type, CAST(user_id AS VARCHAR) AS chat_id, 'v1' AS vault_version, CASE WHEN event_type = 'view' THEN '{}' ELSE props END AS payload FROM events"
)
def event_log_append(spark, sf):
    """Events appended to the log and read back."""
    events = table(spark, sf, "events")
    payload = F.when(F.col("event_type") != "view", F.col("props"))
    record = files.event_envelope(F.col("event_type"), F.col("user_id").cast("string"), F.col("ts"), payload, F.lit("v1"))
    out = shared_dir(spark, "events")
    files.append_events(events.select(*record), out)
    return spark.read.parquet(out).select("ts", "type", "meta.chat_id", "meta.vault_version", "payload")
