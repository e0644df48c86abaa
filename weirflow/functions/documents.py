"""Row images as JSON documents, and row fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.model import TableSpec

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# NULLs are written, times keep their microseconds.
_WRITE = {
    "ignoreNullFields": "false",
    "timestampNTZFormat": ISO_MICROS,
    "timestampFormat": f"{ISO_MICROS}XXX",
}


def row_document(columns: Iterable[str]) -> Column:
    """A row as one JSON text; NULL values are written, so absent stays different."""
    return row_document_of(F.struct(*columns))


def row_document_of(row: Column) -> Column:
    return F.to_json(row, _WRITE)


def time_from_text(text: Column, kind: T.DataType) -> Column:
    """A time of type ``kind``; text that is none is an error, not NULL.

    Text with an offset names an instant. Under a type without zone it becomes the
    session's clock time at that instant; text without offset is that clock time itself.
    """
    if not isinstance(kind, T.TimestampNTZType):
        return text.cast(kind)
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2}|[+-]\d{2})$") & text.rlike(r"\d:\d")
    return F.when(zoned, text.cast("timestamp").cast(kind)).otherwise(text.cast(kind))


def document_fields(doc: Column | str, spec: TableSpec) -> Column:
    """JSON text to the table's typed struct: unknown keys go, missing keys are NULL.

    A broken document or a value of the wrong type fails the query: taken for NULL it would lose
    version checks and end periods.
    """
    times = [f.name for f in spec.schema if isinstance(f.dataType, T.TimestampNTZType)]
    read = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in times else f.dataType) for f in spec.schema]
    )
    parsed = F.from_json(doc, read, {"mode": "FAILFAST"})
    fields = [
        (time_from_text(parsed[f.name], f.dataType) if f.name in times else parsed[f.name]).alias(f.name)
        for f in spec.schema
    ]
    return F.when(parsed.isNotNull(), F.struct(*fields))


def document_key(doc: Column | str, key: str) -> Column:
    return F.get_json_object(doc, f"$.{key}").cast("bigint")


def map_fields(values: Column, spec: TableSpec) -> list[Column]:
    """A map of text values (decoded messages) to the table's typed columns."""
    types = [*spec.columns, (spec.version, spec.version_type)]
    return [F.try_element_at(values, F.lit(n)).cast(t).alias(n) for n, t in types]


def mark_text(mark: Column, kind: T.DataType) -> Column:
    """A saved mark; instants keep their offset, so no hour of the year is ambiguous."""
    zoned = isinstance(kind, T.TimestampType)
    return F.date_format(mark, f"{ISO_MICROS}XXX" if zoned else ISO_MICROS)


def iso_text(ts: Column | str) -> Column:
    return F.date_format(ts, ISO_MICROS)


def from_iso_text(text: Column | str) -> Column:
    return F.to_timestamp(text)


def clock_text(ts: Column | str, zone: str) -> Column:
    """Time of day in a zone, as HH:mm:ss."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "HH:mm:ss")


def row_fingerprint(columns: Sequence[str]) -> Column:
    """md5 over the row's document: one explicit form for NULL, no separator collisions."""
    return F.md5(row_document(columns))


def with_fingerprint(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.select(key, row_fingerprint(columns).alias("fingerprint"))
