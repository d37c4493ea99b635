"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Words: runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the cluster's shared folder and read back, so that its lineage ends there."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of stored frames that no result needs any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession, purpose: str) -> str:
    return shared_dir(spark, purpose)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def hex_digits(rows: int, per_bucket: int) -> int:
    """Leading hex digits of a hash that cut ``rows`` rows into buckets of about ``per_bucket``, 256 buckets at least."""
    return min(8, max(2, math.ceil(math.log(max(rows, 1) / per_bucket, 16)))) if rows > per_bucket else 2


#: Keys with this share of all rows or more are hot: at most as many keys as the share's inverse can be.
HOT_SHARE = 1 / 1000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int | None = None) -> DataFrame:
    """Rows joined with a table that has one row per key and, in ``count``, at least the number of rows with that key.

    Keys with ``HOT_SHARE`` of the sum of counts or more are broadcast, at most 1000 rows as their shares add up to one; rows with
    any other key meet the table in a shuffle, where no key has more than that share. ``total`` is that sum where it is known. Keys
    must not be null.
    """
    total = (table.agg(F.sum(count)).first()[0] or 0) if total is None else total
    hot = F.broadcast(table.where(F.col(count) >= max(1, total * HOT_SHARE)))
    cold = table.where(F.col(count) < max(1, total * HOT_SHARE))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(hot, keys).unionByName(rest)
