"""Ordered look-back and look-ahead inside key groups of any size.

A window function needs all rows of a group in one task. That is right for
ordinary keys and fatal for a key holding a third of a 100 TB log. Groups above
a row limit are therefore cut, in reading order, into segments: the window runs
inside a segment, and what crosses a segment border is carried by a table with
one row per segment (and value of the columns a look-up stays within).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.session import fits_one_task, hot_group_rows, materialize

SEG = "_seg"
_SUB = 1 << 20  # sub-segments one segment can be cut into
_SPREAD = 8  # segments per row limit, so uneven positions still fit


def order_struct(order: Sequence[str]) -> Column:
    return F.struct(*order)


def hot_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Groups above ``limit`` rows with their position range.

    At most (rows / limit) groups can exist, which bounds the result.
    """
    bounds = [F.count(F.lit(1)).alias("_n")]
    for i, name in enumerate(order):
        bounds += [F.min(name).alias(f"_lo{i}"), F.max(name).alias(f"_hi{i}")]
    return df.groupBy(*keys).agg(*bounds).filter(F.col("_n") > limit)


def has_hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> bool:
    """Is any group above the row limit? Inputs one task could process are not counted."""
    if hot_rows is None and fits_one_task(df):
        return False
    limit = hot_rows or hot_group_rows(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not sizes.filter(F.col("_n") > limit).isEmpty()


def _segment_number(order: Sequence[str], limit: int, again: bool) -> Column:
    """Equal-width cut of the first order column that varies; grows with the order.

    A segment cut again is cut as finely as can be: a far outlier then costs a few more cuts, not all.
    """
    pieces = F.lit(_SUB - 2) if again else F.least(F.ceil(F.col("_n") / F.lit(limit)) * _SPREAD, F.lit(_SUB - 2))
    number = F.lit(0).cast("bigint")
    for i in reversed(range(len(order))):
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        width = F.floor((high - low) / pieces) + 1
        cut = F.floor((F.col(order[i]) - low) / width).cast("bigint")
        number = F.when(high > low, cut).otherwise(number)
    return number


def cut_hot_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int
) -> DataFrame:
    """Add ``_seg``: an empty array for ordinary groups, one that grows in reading order for hot ones.

    A segment that is still hot (positions with far outliers, or many rows on few
    positions, such as one huge transaction) is cut again by its own range, which adds a
    number to the array, until none is hot that has more than one position. The hot
    groups found at each step are written out, so the result reads ``df`` once
    however many steps there are.
    """
    wide = list(df.columns)
    cut = df.withColumn(SEG, F.array().cast("array<bigint>"))
    varies = reduce(or_, [F.col(f"_hi{i}") > F.col(f"_lo{i}") for i in range(len(order))])
    again = False
    while True:
        narrow = cut.select(*dict.fromkeys([*keys, *order, SEG]))
        if again:
            narrow = narrow.filter(F.size(SEG) > 0)
        hot = materialize(hot_groups(narrow, [*keys, SEG], order, limit).filter(varies), "hot")
        if hot.isEmpty():
            return cut
        longer = F.concat(SEG, F.array(_segment_number(order, limit, again)))
        cut = (
            cut.join(F.broadcast(hot), [*keys, SEG], "left")
            .withColumn(SEG, F.when(F.col("_n").isNotNull(), longer).otherwise(F.col(SEG)))
            .select(*wide, SEG)
        )
        again = True


class OrderedGroups:
    """A DataFrame with key groups and a reading order, prepared for look-ups in order."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        hot_rows: int | None = None,
        skewed: bool | None = None,
    ) -> None:
        self.keys = list(keys)
        self.order = list(order)
        self.split = has_hot_groups(df, keys, hot_rows) if skewed is None else skewed
        if self.split:
            limit = hot_rows or hot_group_rows(df.sparkSession)
            df = materialize(cut_hot_groups(df, keys, order, limit), "segments")
        self.frame = df

    def _look(
        self, df: DataFrame, value: Column, out: str, back: bool, within: Sequence[str]
    ) -> DataFrame:
        function = "lag" if back else "lead"
        keys = [*self.keys, *within]
        groups = [*keys, SEG] if self.split else keys
        by, ordered = (", ".join(f"`{c}`" for c in cols) for cols in (groups, self.order))
        look = F.expr(
            f"{function}(`{out}__v`) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY {ordered})"
        )
        valued = df.withColumn(f"{out}__v", value)
        if not self.split:
            return valued.withColumn(out, look).drop(f"{out}__v")
        # One row per segment of a hot group: its last (first) value in reading order.
        pick = F.max_by if back else F.min_by
        place = F.when(F.col(f"{out}__v").isNotNull(), order_struct(self.order))
        edges = (
            valued.filter(F.size(SEG) > 0)
            .groupBy(*groups)
            .agg(pick(f"{out}__v", place).alias(f"{out}__e"))
        )
        across = ", ".join(f"`{c}`" for c in keys)
        carry = edges.withColumn(
            f"{out}__e",
            F.expr(
                f"{function}(`{out}__e`) IGNORE NULLS OVER (PARTITION BY {across} ORDER BY {SEG})"
            ),
        )
        # As a written table it has a known size, by which the optimizer chooses the join.
        return (
            valued.withColumn(out, look)
            .join(materialize(carry, "carry"), groups, "left")
            .withColumn(out, F.coalesce(out, f"{out}__e"))
            .drop(f"{out}__v", f"{out}__e")
        )

    def with_previous(
        self, df: DataFrame, value: Column, out: str, within: Sequence[str] = ()
    ) -> DataFrame:
        """Add the last non-NULL ``value`` strictly before each row, in reading order.

        ``within`` narrows the look-up to rows that also agree in these columns.
        """
        return self._look(df, value, out, True, within)

    def with_next(
        self, df: DataFrame, value: Column, out: str, within: Sequence[str] = ()
    ) -> DataFrame:
        """Add the first non-NULL ``value`` strictly after each row, in reading order."""
        return self._look(df, value, out, False, within)

    def close(self, df: DataFrame) -> DataFrame:
        return df.drop(SEG)


def running_max_before(
    df: DataFrame, at: str, values: Sequence[str], block: int = 4096
) -> DataFrame:
    """``prev_<v>``: maximum of ``v`` over all rows with a smaller ``at``, NULL for the first.

    ``df`` has one row per ``at``. Rows are scanned in blocks of ``block``
    consecutive numbers; only one row per block goes through a single task.
    """
    if not fits_one_task(df):
        df = materialize(df, "by_number")
    if fits_one_task(df):
        earlier = W.orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", *[F.max(v).over(earlier).alias(f"prev_{v}") for v in values])
    blocked = df.withColumn("_block", F.floor(F.col(at) / block))
    inside = W.partitionBy("_block").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    across = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    tops = blocked.groupBy("_block").agg(*[F.max(v).alias(f"_top_{v}") for v in values])
    carried = tops.select(
        "_block", *[F.max(f"_top_{v}").over(across).alias(f"_carry_{v}") for v in values]
    )
    local = reduce(
        lambda d, v: d.withColumn(f"_in_{v}", F.max(v).over(inside)), values, blocked
    )
    return local.join(carried, "_block", "left").select(
        *df.columns,
        *[F.greatest(f"_in_{v}", f"_carry_{v}").alias(f"prev_{v}") for v in values],
    )
