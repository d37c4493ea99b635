"""Corpus profiling: acronyms and batch mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WORD

# Acronyms too common to propose.
STOP_ACRONYMS = """PDF URL HTTP HTTPS API SQL CPU GPU AI ML NLP UI UX LLM RAG JSON CSV YAML XML DOC ID KPI OKR ETA TBD TBC
ETC TTL UTC GMT IST UTC+ WE OSS SAAS PaaS IaaS SSO MFA OTP KPI KPIE ETL ELT DAG DAGs NDA POC MVP ROI""".split()

_ACRONYM = f"(?<![{WORD}])[A-Z]{{2,6}}(?![{WORD}])"
_BATCH = rf"(?<![{WORD}])(?i:batch)[\s\u00a0]*(\p{{Nd}}+)(?![{WORD}])"
BATCH_PATTERN = r"(?i)\bBatch\s*(\d+)\b"


def acronyms(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(_ACRONYM), F.lit(0))
    return F.filter(found, lambda a: ~a.isin(STOP_ACRONYMS))


def acronyms_global(docs: DataFrame, top: int = 50) -> DataFrame:
    """The most frequent acronyms of the corpus, ties in text order."""
    found = docs.select(F.explode(acronyms(F.col("text"))).alias("acronym"))
    return found.groupBy("acronym").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "acronym").limit(top)


def acronyms_per_doc(docs: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent acronyms of each document with the characters scanned; a document without any has one row with nulls."""
    scanned = docs.select("doc_id", F.length("text").cast("bigint").alias("chars_scanned"), acronyms(F.col("text")).alias("_found"))
    found = scanned.select("doc_id", "chars_scanned", F.explode_outer("_found").alias("acronym"))
    counted = found.groupBy("doc_id", "chars_scanned", "acronym").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("acronym").isNotNull(), F.col("n")).otherwise(0))
    w = W.partitionBy("doc_id").orderBy(F.desc("n"), "acronym")
    return counted.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top)


def batch_numbers(text: Column) -> Column:
    """Sorted distinct numbers mentioned as batches."""
    found = F.regexp_extract_all(text, F.lit(_BATCH), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("bigint"))))


def batch_mentions(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", batch_numbers(F.col("text")).alias("found_batches"))


def batch_range(docs: DataFrame) -> DataFrame:
    """Smallest and largest batch number of the corpus, and the pattern where any was found."""
    found = docs.select(F.explode(batch_numbers(F.col("text"))).alias("n"))
    spread = found.agg(F.min("n").alias("min_batch"), F.max("n").alias("max_batch"))
    return spread.withColumn("pattern", F.when(F.col("min_batch").isNotNull(), F.lit(BATCH_PATTERN)).otherwise(F.lit("")))
