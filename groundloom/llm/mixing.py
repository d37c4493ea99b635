"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hex_digits, stored

PASSES = 3
COLUMNS = ("source_size", "target", "copies", "taken")


def source_targets(rows: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` per source, from rows of ``(source, size)``.

    Sources in order of their code points, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the sum of all sizes by weight.
    A target is at most ``PASSES`` times its source's size; what is above is shared by weight among the others until none is
    above. In order of limit over weight, the sources before the first that its share doesn't fill stand at their limits.
    One row per source, and sources are few: this table alone passes through one task.
    """
    every = Window.orderBy("room", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("room", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("room", "rank").rowsBetween(0, Window.unboundedFollowing)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    level = ranked.withColumn("room", F.col("source_size") * PASSES / F.col("weight")).withColumn(
        "level", (F.sum("source_size").over(every) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * PASSES) / F.sum("weight").over(onward)
    )
    filled = level.withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "rank", "level"))).over(every)["level"])
    return filled.select("source", "source_size", F.least(F.col("level") * F.col("weight"), (F.col("source_size") * PASSES).cast("double")).alias("target"))


def mix(rows: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", seed: str = "mix") -> DataFrame:
    """All rows with ``source_size``, ``target``, ``copies`` (0 to ``PASSES``) and ``taken`` (copies times size).

    Each source's rows are shuffled by the MD5 of seed and key and served up to ``PASSES`` times in that order. A copy's virtual
    finish time is its source's cumulative size up to and with it, divided by the source's target; it is served if its service begins
    before time 1, when every source has its target. The copies of all sources, sorted by finish time, are cut where their total
    passes the sum of all sizes. So every source ends within a document of its target, and a huge document that doesn't fit any
    more leaves no room to others. Equal finish times are ordered by hash, then pass.

    Running sums take two steps: totals per (source, range of hashes), then rows within one range; the same over ranges of
    finish times. No step holds a source or the table in one task; the last one sorts the copies of the range that the cut falls
    into. Rows are written once in between, so the order stays when tasks run again.

    Null sizes and negative sizes count as 0, null keys as the empty key; rows that repeat a key are taken one by one. Rows of
    size 0 are never copied. An empty table gives an empty result. Other columns stay; input columns named like results go.
    """
    names = [c for c in rows.columns if c not in COLUMNS]
    keyed = rows.select(
        F.struct(*names).alias("_row"),
        F.col(source).alias("source"),
        F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("place"),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("lane"),
    )
    targets = stored(source_targets(keyed).withColumn("lane", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))).drop("source"), "targets")
    keyed = stored(keyed.drop("source"), "keyed")
    n, budget = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = hex_digits(n, 2000)
    ranged = keyed.withColumn("range", F.substring("place", 1, digits))
    totals = ranged.groupBy("lane", "range").agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("lane").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(totals.select("lane", "range", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("start")).join(targets, "lane"), "starts")
    within = Window.partitionBy("lane", "range").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = stored(ranged.withColumn("upto", F.sum("size").over(within)).join(starts, ["lane", "range"]).withColumn("upto", F.col("upto") + F.col("start")).drop("lane", "range", "start"), "timed")
    discard(keyed, starts, targets)

    def finish(at):
        upto = F.lit(at).cast("long") * F.col("source_size") + F.col("upto")
        return F.when((F.col("size") > 0) & (upto - F.col("size") < F.col("target")), upto / F.col("target"))

    ranges = 16**digits
    copies = timed.select("place", "size", F.explode(F.array(*(F.struct(finish(at).alias("finish"), F.lit(at).alias("pass")) for at in range(PASSES)))).alias("c")).select("place", "size", "c.finish", "c.pass").where("finish is not null")
    copies = copies.withColumn("span", F.floor(F.col("finish") * ranges))
    spans = copies.groupBy("span").agg(F.sum("size").alias("sum"))
    total = F.sum("sum").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0))
    cut = spans.withColumn("total", total).where(F.col("total") > budget).orderBy("span").first()
    if cut is None:
        taken = sum((F.when(finish(at).isNotNull(), 1).otherwise(0) for at in range(1, PASSES)), F.when(finish(0).isNotNull(), 1).otherwise(0))
    else:
        order = Window.orderBy("finish", "place", "pass").rowsBetween(Window.unboundedPreceding, 0)
        served = copies.where(F.col("span") == cut["span"]).withColumn("total", F.sum("size").over(order) + (cut["total"] - cut["sum"]))
        last = served.where(F.col("total") <= budget).agg(F.max(F.struct("finish", "place", "pass"))).first()[0]

        def kept(at):
            early = F.floor(finish(at) * ranges) < cut["span"]
            if last is not None:
                early |= (F.floor(finish(at) * ranges) == cut["span"]) & (F.struct(finish(at), F.col("place"), F.lit(at)) <= F.struct(F.lit(last[0]), F.lit(last[1]), F.lit(last[2])))
            return F.when(early, 1).otherwise(0)

        taken = sum((kept(at) for at in range(1, PASSES)), kept(0))
    counted = timed.withColumn("copies", taken)
    return counted.select(*(F.col(f"_row.`{c}`").alias(c) for c in names), "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(mixed: DataFrame) -> DataFrame:
    """The mixed rows, each as often as it was taken, without the mixing columns."""
    rows = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.drop("_copy", *COLUMNS)
