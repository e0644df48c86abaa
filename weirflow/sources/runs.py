"""Numbers taken from a log, kept as maximal runs without gaps.

A queue reader takes whatever is visible, so what it has taken is nearly all numbers up to some mark: a few
runs, parted by numbers of transactions that were open (or never committed). Their size follows
the gaps and not the log, and telling what is new is a range check and a look-up among few gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Numbers are joined to runs within blocks of so many, and gaps looked up by them.
BLOCK = 1 << 16


def _block(number: str) -> Column:
    return F.floor(F.col(number) / BLOCK).cast("bigint")


def joined_runs(numbers: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Maximal runs (``low, high``) of the numbers ``seq`` and of earlier ``runs``, which may overlap them.

    Numbers become runs within their block; only those, one row a block and gap, go through the one
    task that joins neighbours.
    """
    inside = W.partitionBy("block").orderBy("seq")
    distinct = numbers.select("seq").where("seq is not null").distinct().withColumn("block", _block("seq"))
    marked = distinct.withColumn("run", F.col("seq") - F.row_number().over(inside))
    ends = marked.groupBy("block", "run").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    parts = ends.select("low", "high")
    if runs is not None:
        parts = parts.unionByName(runs.select("low", "high"))
    earlier = W.orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1)
    upto = W.orderBy("low", "high").rowsBetween(W.unboundedPreceding, 0)
    new = F.coalesce(F.col("low") > F.max("high").over(earlier) + 1, F.lit(True))
    numbered = parts.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(upto))
    return numbered.groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def gaps(runs: DataFrame) -> DataFrame:
    """Gaps (``low, high``) between runs that do not overlap."""
    after = F.lead("low").over(W.orderBy("low"))
    between = runs.select((F.col("high") + 1).alias("low"), (after - 1).alias("high"))
    return between.where("low <= high")


def outside_runs(log: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Entries whose ``seq`` lies in no run: above all of them, or in a gap.

    Entries below the lowest gap are left out by a pushed-down range filter.
    """
    if runs is None:
        return log
    first, top = runs.agg(F.min("low"), F.max("high")).first()
    if top is None:
        return log
    open_ = gaps(runs).select(
        F.col("low").alias("_low"),
        F.col("high").alias("_high"),
        F.explode(F.sequence(_block("low"), _block("high"))).alias("_block"),
    )
    lowest = open_.agg(F.min("_low")).first()[0]
    seq = F.col("seq")
    fresh = log.where((seq < first) | (seq >= (top + 1 if lowest is None else lowest)))
    if lowest is None:
        return fresh
    inside = (_block("seq") == F.col("_block")) & seq.between(F.col("_low"), F.col("_high"))
    looked = fresh.join(open_, inside, "left")
    return looked.where((seq < first) | (seq > top) | F.col("_low").isNotNull()).select(*log.columns)
