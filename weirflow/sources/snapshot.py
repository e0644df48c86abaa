"""Initial state: Parquet snapshots and database tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.model import TableSpec

PART_FILES = "part-*.parquet"


def declared_columns(df: DataFrame, spec: TableSpec, loaded_at: Column | None = None) -> DataFrame:
    """The declared columns plus the version column; the scan reads nothing else.

    Rows of a first load carry no version of their own and get the load time.
    """
    version = F.current_timestamp() if loaded_at is None else loaded_at
    return df.select(*spec.column_names, version.alias(spec.version))


def snapshot_scan(
    spark: SparkSession, folder: str, spec: TableSpec, loaded_at: Column | None = None
) -> DataFrame:
    """``<folder>/<table>/part-*.parquet`` as the table's first version."""
    files = spark.read.option("pathGlobFilter", PART_FILES).parquet(f"{folder}/{spec.name}")
    return declared_columns(files, spec, loaded_at)


def load_tables(
    spark: SparkSession, folder: str, specs: Sequence[TableSpec], loaded_at: Column | None = None
) -> dict[str, DataFrame]:
    return {s.name: snapshot_scan(spark, folder, s, loaded_at) for s in specs}


def table_counts(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    return {name: df.count() for name, df in tables.items()}


def jdbc_options(
    url: str, table: str, spec: TableSpec, splits: tuple[int, int, int] | None = None
) -> dict[str, str]:
    """Reader options; ``splits`` = (lowest key, highest key, tasks) reads in parallel."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000", "pushDownPredicate": "true"}
    if splits is not None:
        low, high, tasks = splits
        options |= {
            "partitionColumn": spec.key,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(tasks),
        }
    return options


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    spec: TableSpec,
    splits: tuple[int, int, int] | None = None,
    **properties: str,
) -> DataFrame:
    """A live table; a filter on the version column is pushed to the database."""
    options = {**jdbc_options(url, table, spec, splits), **properties}
    return spark.read.format("jdbc").options(**options).load().select(*spec.all_names)
