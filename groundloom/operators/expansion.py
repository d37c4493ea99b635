"""Joins whose result is far larger than both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Listed rows in one block, about; rows of the result that one task makes, about; tasks at most.
BLOCK_ROWS, TASK_ROWS, TASKS = 1024, 1 << 20, 10_000


def expand(rows: DataFrame, listed: DataFrame, on: list[str], block_rows: int = BLOCK_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Inner join of ``rows`` with the many rows that ``listed`` has for each key, opened in place.

    The rows listed for a key are gathered in blocks of bounded size. A row meets blocks and opens them in the task where it meets
    them, so what is shuffled is the rows and the blocks, never the result. Tasks are as many as the rows to open ask for, whatever
    the few bytes that they come from, and a block that many rows meet is copied to several of them.
    """
    listed, rows = materialize(listed, "listed"), materialize(rows, "opened-rows")
    items = [c for c in listed.columns if c not in on]
    counts = listed.groupBy(*on).agg(F.count("*").alias("_listed"), F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    met = rows.groupBy(*on).agg(F.count("*").alias("_rows")).join(counts, on)
    copies = F.ceil(F.col("_rows") * F.least("_listed", F.lit(block_rows)) / task_rows).cast("int").alias("_copies")
    sizes = materialize(met.select(*on, "_blocks", copies, (F.col("_rows") * F.col("_listed")).alias("_made")), "sizes")
    tasks = min(TASKS, max(1, -(-(sizes.agg(F.sum("_made")).first()[0] or 0) // task_rows)))
    sizes = sizes.drop("_made")

    def of(names: list[str], n: str) -> Column:
        return F.pmod(F.xxhash64(*names), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    at = [*on, "_block", "_copy"]
    dealt = listed.join(sizes, on).withColumn("_block", of(items, "_blocks"))
    blocks = dealt.groupBy(*on, "_block", "_copies").agg(F.collect_list(F.struct(*items)).alias("_items"))
    blocks = blocks.select(*on, "_block", every("_copies").alias("_copy"), "_items").repartition(tasks, *at)
    wide = rows.join(sizes, on).select(*rows.columns, of(rows.columns, "_copies").alias("_copy"), every("_blocks").alias("_block")).repartition(tasks, *at)
    opened = wide.join(blocks, at).select(*rows.columns, F.explode("_items").alias("_item"))
    return opened.select(*rows.columns, "_item.*")
