"""Every registered query against its SQL at the smallest scale, and the shape of its plan."""

import pytest
from oracle_check import DATA, compare, duck

from groundloom.plans import load

QUERIES, ORACLES = load()
SF = f"{DATA}/sf0.001"
#: At this scale every document has a vector of its number, and no chat has touched half a batch.
MAY_BE_EMPTY = ["missing_vectors", "batch_expand"]
#: The vault here has one version, a constant, so Spark turns the join by version into a comparison with that single row.
ONE_ROW_SIDE = ["resolve_version"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    difference = compare(spark, con, SF, name, lambda *_: df, ORACLES[name])
    assert difference is None or name in MAY_BE_EMPTY and difference.startswith("EMPTY"), difference
    # No query pairs all rows of one side with all of the other.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert name in ONE_ROW_SIDE or not [line for line in plan.split("\n") if "CartesianProduct" in line or "NestedLoopJoin" in line]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_document_work_needs_no_shuffle_of_its_own(spark):
    from pyspark.sql import functions as F

    from groundloom.operators import blocks, chunks

    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("# a\n\nb").alias("text"))
    plan = chunks.build_chunks(blocks.with_blocks(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
