"""Canonical changes: one form for every reader, and changes derived from two versions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.documents import document_fields, document_key, row_document
from weirflow.model import DELETE, POS, UPSERT, TableSpec


def canonical_op(op: Column | str) -> Column:
    """Insert and update (by their first letter) are both an upsert; a delete stays one."""
    name = F.col(op) if isinstance(op, str) else op
    return F.when(F.upper(F.left(name, F.lit(1))) == DELETE, DELETE).otherwise(UPSERT)


def change_time(op: Column | str, version: Column | str, logged_at: Column | str) -> Column:
    """The row's own version where there is an image; a delete has none, only the log's time."""
    removed = canonical_op(op) == DELETE
    return F.when(removed, F.col(logged_at) if isinstance(logged_at, str) else logged_at).otherwise(F.coalesce(version, logged_at))


def canonical_changes(
    log: DataFrame,
    order: Sequence[str | Column],
    key: str = "pk",
    version: str = "updated_at",
    logged_at: str = "changed_at",
    keep: Sequence[str] = (),
) -> DataFrame:
    """A typed log read in ``order`` (one or two BIGINT columns) as changes."""
    places = [F.col(o) if isinstance(o, str) else o for o in order]
    if len(places) == 1:
        places.append(F.lit(0))
    return log.select(
        "tbl",
        canonical_op("op").alias("op"),
        key,
        change_time("op", version, logged_at).alias("ts"),
        *[p.cast("bigint").alias(name) for p, name in zip(places, POS, strict=True)],
        *keep,
        version,
    )


def known_tables(changes: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Fail on a change of an undeclared table instead of dropping it."""
    listed = F.col("tbl").isin(*tables)
    message = F.concat(F.lit("change of an undeclared table: "), F.coalesce("tbl", F.lit("NULL")))
    return changes.withColumn("tbl", F.when(listed, F.col("tbl")).otherwise(F.raise_error(message)))


def published(changes: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Only the listed tables are captured."""
    return changes.filter(F.col("tbl").isin(*tables))


def route(changes: DataFrame, spec: TableSpec, doc: str = "doc") -> DataFrame:
    """One table's changes with the document turned into typed columns."""
    places = [c for c in (*POS, "ts", "sent") if c in changes.columns]
    typed = document_fields(doc, spec)
    return (
        changes.filter(F.col("tbl") == spec.name)
        .select("op", "pk", *places, typed.alias("_row"))
        .select(
            "op",
            F.col("pk").alias(spec.key),
            *places,
            *[F.col(f"_row.{c}").alias(c) for c in spec.image_names],
        )
    )


def log_documents(rows: DataFrame, spec: TableSpec, op: str, columns: Sequence[str]) -> DataFrame:
    """Rows as change-log entries with the image as a document (NULL on delete)."""
    doc = row_document(columns)
    image = F.lit(None).cast("string") if op == DELETE else doc
    return rows.select(
        F.lit(spec.name).alias("tbl"),
        F.lit(op).alias("op"),
        document_key(doc, spec.key).alias("pk"),
        image.alias("row_data"),
    )


def changes_between(
    before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """The change log that turns one table version into the next.

    ``op`` I/U with the new image, D with a NULL image; unchanged rows make no
    entry. Keys are unique on both sides, so the full outer join has no hot key.
    """
    old = before.select(key, F.struct(*columns).alias("_old"))
    new = after.select(key, F.struct(*columns).alias("_new"))
    op = (
        F.when(F.col("_old").isNull(), "I")
        .when(F.col("_new").isNull(), "D")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "U")
    )
    return (
        old.join(new, key, "full_outer")
        .withColumn("op", op)
        .filter(F.col("op").isNotNull())
        .select("op", key, *[F.col(f"_new.{c}").alias(c) for c in columns])
    )


def union_tables(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def smallest_key_row(df: DataFrame, key: str) -> DataFrame:
    """The row with the smallest key; every task keeps one row."""
    return df.orderBy(key).limit(1)
