"""Checks a database would enforce: keys, open periods, NULLs, required fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held more than once: ``keys.., n_rows``. Empty means unique."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.filter(F.col("n_rows") > 1)


def duplicate_open_periods(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one open period."""
    return duplicate_keys(periods.filter(F.col("valid_to").isNull()), keys)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, null_rows`` for each column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "null_rows")


_LOG_FIELDS = ("seq", "tbl", "op", "pk", "row_data", "changed_at")
# Fields a reading method needs in the log it reads; one that reads tables needs what their declarations name.
REQUIRED_FIELDS = {
    "high_watermark": (),
    "sequence": _LOG_FIELDS,
    "queue": _LOG_FIELDS,
    "commit_order": ("commit_lsn", *_LOG_FIELDS),
}


def require_fields(df: DataFrame, method: str, more: Sequence[str] = ()) -> DataFrame:
    """Fail before the job starts when the log or table cannot serve a reading method."""
    absent = [c for c in (*REQUIRED_FIELDS[method], *more) if c not in df.columns]
    if absent:
        raise ValueError(f"{method} needs {', '.join(absent)} in what it reads")
    return df
