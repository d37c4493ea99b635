"""Sharding by extendible hashing: a directory of hash prefixes whose oversized buckets split on one more bit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KEY_BITS = 60
ROW_BITS = 60


def assign_shards(rows: DataFrame, key: str, size: str, limit_bytes: int) -> DataFrame:
    """All rows with ``shard`` (bit string of the bucket), ``depth``, ``shard_bytes``, ``shard_docs`` and ``oversized``.

    A row's address is 60 bits of the MD5 of its key, then 60 bits drawn per row. The bucket of a row is the shortest prefix of
    its address whose rows fit ``limit_bytes`` together; a single row above the limit is a bucket of its own, marked
    ``oversized``. Only prefixes whose parent is too large are ever split, so the directory follows the data. Rows that repeat one
    key, up to any share of the table, part on the second half of the address, which is written before use and so stays the same
    when tasks run again.

    Sizes are summed per cell of the finest prefix of a pass (some cells per expected shard), and the prefixes of all depths are
    sums of cells, so a pass is one aggregation; further passes see only rows of cells that are still too large.
    Null keys count as the empty key, null sizes as 0. Columns of the input named like a result column are replaced.
    """
    names = [c for c in rows.columns if c not in ("shard", "depth", "shard_bytes", "shard_docs", "oversized")]
    if rows.isEmpty():
        return rows.select(*names, *(F.lit(None).cast(t).alias(c) for c, t in (("shard", "string"), ("depth", "long"), ("shard_bytes", "long"), ("shard_docs", "long"), ("oversized", "boolean"))))
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    drawn = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - ROW_BITS)
    bits = F.concat(F.lpad(F.bin(hashed), KEY_BITS, "0"), F.lpad(F.bin(drawn), ROW_BITS, "0"))
    left = stored(rows.select(F.struct(*names).alias("_row"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"), bits.alias("_bits")), "addresses")
    total = left.agg(F.sum("_size")).first()[0]
    low, deep, done = 0, min(KEY_BITS, 6 + max(0, math.ceil(math.log2(max(1, total / limit_bytes))))), None
    while True:
        cells = left.groupBy(F.substring("_bits", 1, deep).alias("cell")).agg(F.sum("_size").alias("bytes"), F.count("*").alias("docs"))
        levels = stored(cells, "cells").withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(deep)))).withColumn("shard", F.expr("substring(cell, 1, depth)"))
        sums = stored(levels.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.first("depth").alias("depth")), "prefixes")
        fits = (F.col("bytes") <= limit_bytes) | (F.col("docs") == 1)
        large = sums.where(~fits).select(F.col("shard").alias("parent"))
        below = sums.where(fits).withColumn("parent", F.expr("substring(shard, 1, depth - 1)"))
        leaves = below.where(F.col("depth") == low).unionByName(below.where(F.col("depth") > low).join(large, "parent", "left_semi").select(below.columns))
        directory = stored(levels.select("cell", "shard").join(leaves.drop("parent"), "shard"), "directory")
        placed = left.withColumn("cell", F.substring("_bits", 1, deep)).join(directory, "cell", "left")
        part = placed.where("shard is not null").select(
            *(F.col(f"_row.`{c}`").alias(c) for c in names),
            "shard",
            F.col("depth").cast("long").alias("depth"),
            F.col("bytes").alias("shard_bytes"),
            F.col("docs").alias("shard_docs"),
            (F.col("bytes") > limit_bytes).alias("oversized"),
        )
        done = part if done is None else done.unionByName(part)
        if deep >= KEY_BITS + ROW_BITS or sums.where((F.col("depth") == deep) & ~fits).isEmpty():
            return done
        left = stored(placed.where("shard is null").select("_row", "_size", "_bits"), "addresses")
        low, deep = deep + 1, min(KEY_BITS + ROW_BITS, deep + 12)
