"""Comparing a copy with its source by key and fingerprint.

Verdicts are named from the copy's side: it lacks a row (missing), has it with
other values (stale), or has one the source has no more (ghost).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.documents import row_fingerprint
from weirflow.session import materialize
from weirflow.operators.changes import union_tables

KINDS = ("missing", "stale", "ghost")


def compare_rows(
    source: DataFrame, copy: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """``keys, in_source, verdict`` with verdict missing/stale/ghost or NULL when equal.

    Rows shrink to key and fingerprint before the shuffle.
    """
    keys = list(keys)

    def prints(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.unhex(row_fingerprint(columns)).alias(name))

    a, b = F.col("_a"), F.col("_b")
    verdict = F.when(b.isNull(), "missing").when(a.isNull(), "ghost").when(a != b, "stale")
    return (
        prints(source, "_a")
        .join(prints(copy, "_b"), keys, "full_outer")
        .select(*keys, a.isNotNull().alias("in_source"), verdict.alias("verdict"))
    )


def diff_counts(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by.., source_rows, missing, stale, ghost``; one row per group of ``by``."""
    return compared.groupBy(*by).agg(
        F.count_if("in_source").alias("source_rows"),
        *[F.count_if(F.col("verdict") == kind).alias(kind) for kind in KINDS],
    )


def diff_tables(
    pairs: Mapping[str, tuple[DataFrame, DataFrame, str, Sequence[str]]],
) -> DataFrame:
    """One report row per table from name -> (source, copy, key, columns)."""
    return union_tables(
        [
            diff_counts(compare_rows(src, copy, [key], [key, *columns])).select(
                F.lit(name).alias("tbl"), "source_rows", *KINDS
            )
            for name, (src, copy, key, columns) in pairs.items()
        ]
    )


# Parts a table is first compared in; one row per part reaches the driver.
PARTS = 4096


def differing_parts(
    source: DataFrame, copy: DataFrame, keys: Sequence[str], columns: Sequence[str], parts: int = PARTS
) -> DataFrame:
    """``part, source_rows, same`` for every part of the keys that either side has rows in.

    A part is summed up by the number of its rows and sums of two hashes of them, which need no order. Both
    are partial aggregates: a task shuffles one row per part, whatever the table's size.
    """

    def summed(df: DataFrame, rows: str, of: str) -> DataFrame:
        image = F.xxhash64(*keys, *[F.struct(F.col(c).alias("v")) for c in columns])
        marked = df.select(_part(keys, parts).alias("part"), image.alias("h"))
        low, high = F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned("h", 32))
        sums = F.struct(F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high"), F.bit_xor(F.xxhash64("h")).alias("x"))
        return marked.groupBy("part").agg(F.count(F.lit(1)).alias(rows), sums.alias(of))

    both = summed(source, "source_rows", "_a").join(summed(copy, "_n", "_b"), "part", "full_outer")
    same = F.col("_a").eqNullSafe(F.col("_b")).alias("same")
    return both.select("part", F.coalesce("source_rows", F.lit(0)).alias("source_rows"), same)


def _part(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def diff_by_parts(
    source: DataFrame, copy: DataFrame, keys: Sequence[str], columns: Sequence[str], parts: int = PARTS
) -> DataFrame:
    """``source_rows, missing, stale, ghost`` of one table, with rows compared only in parts that differ.

    Equal tables are read once each and not shuffled. A difference costs a second scan and the
    shuffle of its part of the keys.
    """
    found = materialize(differing_parts(source, copy, keys, columns, parts), "parts")
    wrong = [r["part"] for r in found.filter(~F.col("same")).select("part").collect()]
    rows = found.agg(F.coalesce(F.sum("source_rows"), F.lit(0)).alias("source_rows"))
    if not wrong:
        return rows.select("source_rows", *[F.lit(0).cast("bigint").alias(k) for k in KINDS])
    inside = _part(keys, parts).isin(wrong)
    compared = compare_rows(source.filter(inside), copy.filter(inside), keys, [*keys, *columns])
    counts = compared.agg(*[F.count_if(F.col("verdict") == kind).alias(kind) for kind in KINDS])
    return counts.select(rows.select("source_rows").scalar().alias("source_rows"), *KINDS)


def rows_wrong(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Missing + stale + ghost over all tables."""
    total = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    return report.groupBy(*by).agg(F.sum(total).alias("rows_wrong"))


def wrong_by_method(report: DataFrame) -> DataFrame:
    """Totals per reading method over its tables."""
    return report.groupBy("method").agg(*[F.sum(k).alias(k) for k in KINDS])


def row_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whole rows on one side only, both ways, as ``side`` and the columns.

    Rows count +1 on the left and -1 on the right; what does not add up to nothing is the
    difference, each row as often as it is over. One aggregate, combined before the shuffle.
    """
    names = list(columns)
    both = left.select(*names, F.lit(1).alias("_n")).unionByName(
        right.select(*names, F.lit(-1).alias("_n"))
    )
    over = both.groupBy(*names).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0)
    side = F.when(F.col("_n") > 0, "left").otherwise("right")
    times = F.explode(F.array_repeat(side, F.abs("_n").cast("int")))
    return over.select(times.alias("side"), *names)
