"""Corpus registry, manifests, tolerant JSON-lines scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.modeljson import is_json_object
from ..functions.text import strip

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("doc_id", "doc_title", "version", "filename", "is_current", "checksum", "notes")
    ]
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=REGISTRY_SCHEMA)


def registry_scan(registry: DataFrame, only: list | None = None) -> DataFrame:
    """Entries marked current (an absent mark counts as current), optionally for given documents."""
    if "is_current" in registry.columns:
        flag = F.lower(F.coalesce(F.col("is_current").cast("string"), F.lit("true")))
        registry = registry.filter(flag.isin("true", "1", "yes"))
    return registry if only is None else registry.filter(F.col("doc_id").isin(only))


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """Raw files as (filename, content)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("filename"), "content")


def checksum_refresh(registry: DataFrame, files: DataFrame) -> DataFrame:
    """SHA-256 of every file that exists; other entries keep the checksum they have.

    Digests are taken before the join, so contents are never shuffled.
    """
    digests = files.select("filename", F.sha2(F.col("content"), 256).alias("fresh"))
    return (
        registry.join(digests, "filename", "left")
        .withColumn("checksum", F.coalesce("fresh", "checksum"))
        .select(*registry.columns)
    )


def ingest_manifest(docs: DataFrame, converted_at: Column) -> DataFrame:
    """One row of statistics per document: size in bytes, digest, conversion time."""
    return docs.select(
        "doc_id",
        "version",
        "filename",
        F.octet_length("text").cast("bigint").alias("bytes_markdown"),
        F.sha2(F.col("text"), 256).alias("checksum"),
        converted_at.alias("converted_at"),
    )


def latest_version(files: DataFrame) -> DataFrame:
    """The row with the greatest file name per document.

    A limit on the rank lets Spark prune inside each partition before the shuffle, so a document with
    very many versions does not gather in one task.
    """
    w = W.partitionBy("doc_id").orderBy(F.col("filename").desc())
    return files.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def parse_jsonl(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Parse text lines; blank and malformed ones are skipped, defaults are filled in."""
    usable = lines.filter(strip(F.col(column)) != "").filter(is_json_object(strip(F.col(column))))
    rows = usable.withColumn("_row", F.from_json(column, schema))
    rows = rows.select(*[c for c in lines.columns if c != column], "_row.*")
    names = schema.fieldNames()
    if "section_path" in names:
        rows = rows.withColumn("section_path", F.coalesce("section_path", F.array().cast("array<string>")))
        if "section_group_id" in names:
            rows = rows.withColumn("section_group_id", F.coalesce("section_group_id", F.array_join("section_path", "|")))
    if "breadcrumb" in names:
        rows = rows.withColumn("breadcrumb", F.coalesce("breadcrumb", F.lit("")))
    return rows


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return parse_jsonl(spark.read.text(path), schema)


def pending_work(inputs: DataFrame, outputs: DataFrame, rebuild: bool = False, keys: tuple = ("doc_id", "version")) -> DataFrame:
    """Inputs without an output yet; all of them when rebuilding."""
    return inputs if rebuild else inputs.join(outputs.select(*keys), list(keys), "left_anti")


def write_by_document(df: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64, mode: str = "append") -> None:
    """Write rows laid out by document.

    Documents hash into a fixed number of directories: one directory per document would not survive
    billions of them. Readers prune with :func:`document_bucket`. Rows are written from where they are,
    without a shuffle.
    """
    (
        df.withColumn("doc_bucket", document_bucket(F.col("doc_id"), buckets))
        .write.mode(mode)
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy("doc_bucket")
        .format(fmt)
        .save(path)
    )


def document_bucket(doc_id: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(buckets)).cast("int")


def event_envelope(event_type: Column, chat_id: Column, ts: Column, payload: Column | None = None, vault_version: Column | None = None) -> list[Column]:
    """Columns of an event-log record; an absent payload becomes an empty object."""
    version = F.lit(None).cast("string") if vault_version is None else vault_version
    body = F.lit("{}") if payload is None else F.coalesce(payload, F.lit("{}"))
    return [
        ts.alias("ts"),
        event_type.alias("type"),
        F.struct(chat_id.alias("chat_id"), version.alias("vault_version")).alias("meta"),
        body.alias("payload"),
    ]


def append_events(events: DataFrame, path: str) -> None:
    """Append event-log records, laid out by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
