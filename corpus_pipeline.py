"""The corpus pipeline over ``documents``: quality, near-duplicates, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before it kept, and returns a DataFrame that is written and
read again as the next one's ``docs``; all but the last return the columns of ``documents``. Null and empty texts, null keys and
repeated rows go through each stage as its operator defines: documents without text are rejected by the first; rows with a null
key are no near-duplicates; rows that repeat a key are one document from the second stage on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundloom.llm import mixing, near_dedup, packing, quality
from groundloom.llm.common import WORD, stored, table

#: Common shingles of near-duplicates, in 100 of their joint ones.
NEAR = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the trusted ones among them, doesn't reject; their other columns pass as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "lang", "text")]
    nested = docs.select("doc_id", "lang", "text", *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest")] if others else []))
    kept = quality.classify(nested, table(spark, sf_dir, "labels")).where("keep")
    return kept.select(*(F.col(f"rest.`{c}`").alias(c) if c in others else c for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest key of each group of near-duplicates: ``NEAR`` % of their shingles of five words in common."""
    kept = near_dedup.near_documents(docs, enough=NEAR).where("kept AND doc_id IS NOT NULL").select("doc_id")
    unique = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return unique.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of all sources by target weights, a document taken twice or three times as two or three rows."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", words.alias("size"))
    return mixing.repeat(mixing.mix(sized)).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture in sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", good_quality), ("near-duplicates", one_of_each), ("mixing sources", mixture), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each stage's result written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
