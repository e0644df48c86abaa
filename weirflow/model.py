"""Table declarations and the column conventions every operator shares.

A *change* is one row: ``tbl, op, <key>, ts``, its place in the reading order
``pos_hi, pos_lo`` and the row image (typed columns, or a JSON ``doc``).
DataFrame rows have no order of their own, so the order a reader saw is always
carried in the two position columns; every rule sorts by them and never by
arrival or by timestamp.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import types as T

POS_HI = "pos_hi"
POS_LO = "pos_lo"
POS = (POS_HI, POS_LO)

UPSERT = "U"
DELETE = "D"


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "double": T.DoubleType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def struct_of(fields: Iterable[tuple[str, str]]) -> T.StructType:
    """A schema from (name, type name) pairs; needs no running session."""
    return T.StructType([T.StructField(name, _TYPES[t]) for name, t in fields])


@dataclass(frozen=True)
class TableSpec:
    """One captured table: its key, its columns and what history is kept of it."""

    name: str
    key: str
    columns: tuple[tuple[str, str], ...]  # (name, Spark type), key included, version excluded
    version: str = "updated_at"
    version_type: str = "timestamp"
    tracked: str | None = None  # column whose periods are kept as history

    @property
    def column_names(self) -> list[str]:
        return [name for name, _ in self.columns]

    @property
    def all_names(self) -> list[str]:
        return [*self.column_names, self.version]

    @property
    def image_names(self) -> list[str]:
        """Everything but the key: what an upsert replaces."""
        return [c for c in self.all_names if c != self.key]

    @property
    def schema(self) -> T.StructType:
        return struct_of([*self.columns, (self.version, self.version_type)])


# Names, order and types of the two captured tables.
ORDERS = TableSpec(
    name="orders",
    key="order_id",
    columns=(
        ("order_id", "bigint"),
        ("customer_id", "bigint"),
        ("ordered_at", "timestamp"),
        ("status", "string"),
        ("channel", "string"),
        ("total_cents", "bigint"),
        ("delivered_at", "timestamp"),
    ),
    tracked="status",
)
PAYMENTS = TableSpec(
    name="payments",
    key="payment_id",
    columns=(
        ("payment_id", "bigint"),
        ("order_id", "bigint"),
        ("method", "string"),
        ("status", "string"),
        ("amount_cents", "bigint"),
        ("paid_at", "timestamp"),
    ),
)
# Columns that may be NULL in those tables; all others, the version included, may not.
NULLABLE = {"orders": ("channel", "delivered_at"), "payments": ("paid_at",)}

CHANGE_LOG_SCHEMA = struct_of(
    [
        ("seq", "bigint"),
        ("txid", "bigint"),
        ("tbl", "string"),
        ("op", "string"),
        ("pk", "bigint"),
        ("row_data", "string"),
        ("changed_at", "timestamp"),
        ("commit_lsn", "bigint"),
        ("poll_no", "bigint"),
    ]
)
MESSAGE_SCHEMA = struct_of(
    [("batch_id", "bigint"), ("msg_no", "bigint"), ("lsn", "string"), ("data", "binary")]
)
