"""Values at exact ranks of any number of rows, by counting and narrowing.

A window would sort all rows of a group in one task. Here a group's value range is cut into cells, rows are only
counted by cell, and the cell that holds the rank is cut again, until it holds one value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.session import materialize

CELLS = 1024


def values_at_ranks(
    df: DataFrame, value: str, ranks: Mapping[str, Column], by: Sequence[str] = (), cells: int = CELLS
) -> DataFrame:
    """``by.., n, total`` and one column per rank: the value at that place (from 0) in ascending order.

    ``ranks`` are expressions over ``n``, a group's number of rows. NULL values count nowhere. A round reads the counts by
    value, keeps at most ``cells`` rows per group and rank in any task, and leaves out the least or the greatest value at
    the very least; whole numbers take a tenth of their bits in rounds.
    """
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counted = materialize(counted, "counts").withColumn("_all", F.lit(0))
    keys = ["_all", *by]
    groups = counted.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()]))
    sought = groups.withColumn("_w", wanted).select(*keys, "n", "total", "_w.*", "low", "high")
    sought = materialize(sought, "sought")
    while not (wide := sought.where("low < high")).isEmpty():
        width = (F.col("high").cast("double") - F.col("low").cast("double")) / cells
        inside = counted.join(wide, keys).where(F.col("v").between(F.col("low"), F.col("high")))
        cell = F.when(F.col("v") == F.col("high"), cells - 1).otherwise(
            F.least(F.lit(cells - 2), F.floor((F.col("v").cast("double") - F.col("low").cast("double")) / width))
        )
        held = inside.groupBy(*keys, "n", "total", "name", "rank", cell.alias("cell")).agg(
            F.sum("c").alias("c"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        before = W.partitionBy(*keys, "name").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
        place = held.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        found = place.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        narrower = found.withColumn("rank", F.col("rank") - F.col("before")).select(*sought.columns)
        sought = materialize(sought.where("low = high").unionByName(narrower), "sought")
    at = [F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in ranks]
    return sought.groupBy(*keys).agg(F.first("n").alias("n"), F.first("total").alias("total"), *at).drop("_all")
