"""Row changes out of landed logical-replication messages (protocol version 1).

A landed message is ``batch_id, msg_no, lsn, data``: the poll that fetched it,
its place in that poll (increasing, gaps allowed), the position text and the
raw bytes. Every message is parsed on its own; what a sequential decoder keeps
in memory (the open transaction, the relations seen) becomes look-ups in
``msg_no`` order inside a poll, which also hold for polls too big for one task.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weirflow.functions.documents import map_fields, row_document_of
from weirflow.functions.positions import format_lsn, parse_lsn, server_micros_to_timestamp
from weirflow.model import DELETE, MESSAGE_SCHEMA, POS_HI, POS_LO, UPSERT, TableSpec, struct_of
from weirflow.operators.ordered import OrderedGroups
from weirflow.session import fits_one_task
from weirflow.sources.capture import METHODS, Poll, Source

# The parser travels with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Message kinds that matter and the markers of a tuple and its values.
BEGIN, COMMIT, RELATION = "B", "C", "R"
ROW_KINDS = ("I", "U", "D")
NEW_TUPLE = ord("N")
OLD_TUPLES = (ord("K"), ord("O"))
VALUE_KINDS = {ord("n"): "n", ord("u"): "u", ord("t"): "t"}

_VALUES = T.ArrayType(struct_of([("kind", "string"), ("value", "string")]))
_NAMES = T.ArrayType(T.StringType())
BODY_SCHEMA = T.StructType(
    [
        T.StructField("rel_id", T.LongType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("columns", _NAMES),
        T.StructField("key_columns", _NAMES),
        T.StructField("old", _VALUES),
        T.StructField("new", _VALUES),
    ]
)


def _int(buf: bytes, at: int, size: int) -> int:
    if at + size > len(buf):
        raise ValueError("message ends inside a number")
    return int.from_bytes(buf[at : at + size], "big")


def _text(buf: bytes, at: int) -> tuple[str, int]:
    end = buf.index(0, at)
    return buf[at:end].decode("utf-8"), end + 1


class _Values:
    """Value lists of many messages as flat columns, the layout Arrow wants."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.values: list[bytes | None] = []
        self.starts: list[int | None] = []

    def none(self) -> None:
        self.starts.append(None)

    def read(self, buf: bytes, at: int) -> int:
        self.starts.append(len(self.kinds))
        count, at = _int(buf, at, 2), at + 2
        for _ in range(count):
            kind = VALUE_KINDS.get(buf[at])
            if kind is None:
                raise ValueError(f"a value is marked {chr(buf[at])!r}, which says neither text nor none")
            at, value = at + 1, None
            if kind == "t":
                stop = at + 4 + _int(buf, at, 4)
                if stop > len(buf):
                    raise ValueError("message ends inside a value")
                value, at = buf[at + 4 : stop], stop
            self.kinds.append(kind)
            self.values.append(value)
        return at

    def arrow(self) -> pa.Array:
        text = pa.array(self.values, pa.binary()).cast(pa.string())
        pairs = pa.StructArray.from_arrays([pa.array(self.kinds, pa.string()), text], ["kind", "value"])
        offsets = pa.array([*self.starts, len(self.kinds)], pa.int32())
        return pa.ListArray.from_arrays(offsets, pairs)


def _relation(buf: bytes) -> tuple[str, str, list[str], list[str]]:
    schema, at = _text(buf, 5)
    table, at = _text(buf, at)
    at += 1  # replica identity
    columns, keys = [], []
    count, at = _int(buf, at, 2), at + 2
    for _ in range(count):
        flags = buf[at]
        name, at = _text(buf, at + 1)
        _int(buf, at, 8)  # type oid and modifier, not used
        at += 8
        columns.append(name)
        if flags & 1:
            keys.append(name)
    return schema, table, columns, keys


def parse_bodies(data: pa.Array) -> pa.Array:
    """Relation and row messages to their fields, a batch at a time; others become NULL fields."""
    ids: list[int | None] = []
    relations: list[tuple | None] = []
    old, new = _Values(), _Values()
    for buf in data.to_pylist():
        kind = chr(buf[0]) if buf else ""
        row = kind in ROW_KINDS
        ids.append(_int(buf, 1, 4) if row or kind == RELATION else None)
        relations.append(_relation(buf) if kind == RELATION else None)
        at = 5
        if row and (kind == "D" or (kind == "U" and buf[at] in OLD_TUPLES)):
            at = old.read(buf, at + 1)
        else:
            old.none()
        if row and kind != "D":
            if buf[at] != NEW_TUPLE:
                raise ValueError(f"the row after the change is marked {chr(buf[at])!r}")
            new.read(buf, at + 1)
        else:
            new.none()
    fields = [
        pa.array([r and r[i] for r in relations], field.type)
        for i, field in enumerate(list(_body_type)[1:5])
    ]
    arrays = [pa.array(ids, pa.int64()), *fields, old.arrow(), new.arrow()]
    return pa.StructArray.from_arrays(arrays, fields=list(_body_type))


_body_type = to_arrow_type(BODY_SCHEMA)


@F.arrow_udf(BODY_SCHEMA)
def _bodies(data: pa.Array) -> pa.Array:
    return parse_bodies(data)


def _signed(data: Column, at: int, size: int) -> Column:
    """Big-endian integer header field, on the JVM."""
    return F.conv(F.hex(F.substring(data, at, size)), 16, -10).cast("bigint")


def parse_messages(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per message that matters, each parsed by itself; ``keep`` are columns that stay beside it.

    Begin and Commit are read with built-in functions; only relation and row
    bodies cross to Python, in Arrow batches.
    """
    data = F.col("data")
    kind = F.decode(F.substring(data, 1, 1), "ISO-8859-1")
    with_body = F.col("kind").isin(RELATION, *ROW_KINDS)
    return (
        messages.withColumn("kind", kind)
        .filter(F.col("kind").isin(BEGIN, COMMIT, RELATION, *ROW_KINDS))
        .select(
            "batch_id",
            "msg_no",
            "lsn",
            "kind",
            F.when(
                F.col("kind") == BEGIN, F.conv(F.hex(F.substring(data, 18, 4)), 16, 10)
            ).cast("bigint").alias("xid"),
            F.when(F.col("kind") == COMMIT, _signed(data, 3, 8)).alias("commit_lsn"),
            F.when(F.col("kind") == COMMIT, _signed(data, 19, 8)).alias("commit_us"),
            _bodies(F.when(with_body, data)).alias("body"),
            *keep,
        )
    )


def _value_map(columns: Column, values: Column) -> Column:
    """Column name -> text; NULL stays NULL, a value that was not sent has no entry."""
    named = F.zip_with(columns, values, lambda c, v: F.struct(c.alias("c"), v.alias("v")))
    sent = F.filter(
        named, lambda e: e["c"].isNotNull() & (e["v"]["kind"] != "u")
    )
    return F.map_from_entries(
        F.transform(sent, lambda e: F.struct(e["c"].alias("key"), e["v"]["value"].alias("value")))
    )


def decode_messages(messages: DataFrame, hot_rows: int | None = None, commits: bool = False) -> DataFrame:
    """Row changes with their transaction; with ``commits`` also one row for each commit, without a table.

    ``batch_id, msg_no, lsn, xid, commit_lsn, commit_ts, schema_name, tbl, op,
    new, old, key_columns``; ``lsn`` is the commit message's. Fails on a change or
    commit without a Begin, on a transaction without its commit in the
    poll, and on a relation the poll did not announce before. A window here keeps a poll in one task, so
    what one task should not take is decoded by ranges (``sources.ranges``), unless ``hot_rows`` says where to cut.
    """
    if hot_rows is None and not fits_one_task(messages):
        from weirflow.sources.ranges import decode_ranges  # which needs this module

        return decode_ranges(messages, commits=commits)
    parsed = parse_messages(messages).withColumn("rel_id", F.col("body.rel_id"))
    groups = OrderedGroups(parsed, ["batch_id"], ["msg_no"], hot_rows)
    kind = F.col("kind")
    frame = kind.isin(BEGIN, COMMIT)
    relation = F.when(
        kind == RELATION,
        F.struct("body.schema_name", "body.table_name", "body.columns", "body.key_columns"),
    )
    looked = groups.with_previous(groups.frame, F.when(frame, F.struct("kind", "xid")), "_begin")
    looked = groups.with_next(
        looked, F.when(frame, F.struct("kind", "lsn", "commit_lsn", "commit_us")), "_commit"
    )
    looked = groups.with_previous(looked, relation, "_rel", within=["rel_id"])
    return as_changes(groups.close(looked), commits)


def as_changes(looked: DataFrame, commits: bool = False) -> DataFrame:
    """Parsed messages that know their transaction and relation (``_begin, _commit, _rel``) as row changes."""
    kind = F.col("kind")
    row = kind.isin(*ROW_KINDS)

    def fail(text: str) -> Column:
        return F.raise_error(F.concat(F.lit(text), F.lit(" at message "), "msg_no")).cast("boolean")

    # One expression, so that no rule can separate the checks from the selection.
    checked = (
        F.when(
            (row | (kind == COMMIT)) & ~F.col("_begin.kind").eqNullSafe(BEGIN),
            fail("no Begin is open for a row or Commit"),
        )
        .when(row & ~F.col("_commit.kind").eqNullSafe(COMMIT), fail("transaction without commit"))
        .when(row & F.col("_rel").isNull(), fail("change of a table not announced in this poll"))
        .otherwise(row | (kind == COMMIT) if commits else row)
    )
    # A commit's own values, or those of the commit a row is followed by.
    ends = {c: F.when(kind == COMMIT, F.col(c)).otherwise(F.col(f"_commit.{c}")) for c in ("lsn", "commit_lsn", "commit_us")}
    own = {c: F.when(row, F.col(f"_rel.{c}")) for c in ("schema_name", "table_name")}
    return looked.filter(checked).select(
        "batch_id",
        "msg_no",
        ends["lsn"].alias("lsn"),
        F.col("_begin.xid").alias("xid"),
        ends["commit_lsn"].alias("commit_lsn"),
        server_micros_to_timestamp(ends["commit_us"]).alias("commit_ts"),
        own["schema_name"].alias("schema_name"),
        own["table_name"].alias("tbl"),
        kind.alias("op"),
        _value_map(F.col("_rel.columns"), F.col("body.new")).alias("new"),
        _value_map(F.col("_rel.columns"), F.col("body.old")).alias("old"),
        F.col("_rel.key_columns").alias("key_columns"),
    )


def transactions(decoded: DataFrame) -> DataFrame:
    """One row per transaction with its size; the changes stay rows of their own."""
    return decoded.groupBy("batch_id", "xid", "commit_lsn", "commit_ts").agg(
        F.count(F.lit(1)).alias("n_changes")
    )


def decoded_changes(decoded: DataFrame, spec: TableSpec) -> DataFrame:
    """One table's decoded rows as typed changes in commit order.

    ``sent`` lists the columns that came with the change; a column that did not
    (an unchanged large value) is NULL here until ``fill_unsent`` restores it.
    """
    removed = F.col("op") == "D"
    version = F.try_element_at("new", F.lit(spec.version)).cast("timestamp")
    image = F.when(~removed, F.struct(*map_fields(F.col("new"), spec)))
    key = F.element_at(F.when(removed, F.col("old")).otherwise(F.col("new")), spec.key)
    return (
        decoded.filter(F.col("tbl") == spec.name)
        .select(
            "tbl",
            F.when(removed, DELETE).otherwise(UPSERT).alias("op"),
            key.cast("bigint").alias(spec.key),
            F.coalesce(version, "commit_ts").alias("ts"),
            F.col("commit_lsn").alias(POS_HI),
            F.col("msg_no").alias(POS_LO),
            image.alias("_row"),
            F.when(~removed, F.map_keys("new")).alias("sent"),
        )
        .select(
            "tbl", "op", spec.key, "ts", POS_HI, POS_LO, "sent",
            *[F.col(f"_row.{c}").alias(c) for c in spec.image_names],
        )
    )


def poll_messages(
    messages: DataFrame,
    specs: Sequence[TableSpec],
    position: str | None,
    hot_rows: int | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Typed changes per table above a commit position, and the new position.

    Transactions at or below the position are decoded, as later messages may
    need their relations, and then left out; tables without a spec are not
    captured. The position is a one-row DataFrame with the text of the last commit's
    landed ``lsn``, which is what is compared too.
    """
    old = parse_lsn(F.lit(position or "0/0"))
    fresh = decode_messages(messages, hot_rows).filter(parse_lsn("lsn") > old)
    commits = messages.filter(F.decode(F.substring("data", 1, 1), "ISO-8859-1") == COMMIT)
    last = F.max(parse_lsn("lsn"))
    top = commits.agg(format_lsn(F.greatest(last, old)).alias("position"))
    return {s.name: decoded_changes(fresh, s) for s in specs}, top


def fill_unsent(
    changes: DataFrame,
    key: str,
    columns: list[str],
    stored: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Restore columns a change did not carry from the key's state before it.

    That is the key's last change in commit order that carried the column, back
    to its last delete; before the batch it is the stored row.
    """
    groups = OrderedGroups(changes, [key], [POS_HI, POS_LO], hot_rows)
    df = groups.frame
    removed = F.col("op") == DELETE
    for c in columns:
        known = F.when(removed, F.struct(F.lit(None).cast(changes.schema[c].dataType).alias("v")))
        known = known.when(F.array_contains("sent", c), F.struct(F.col(c).alias("v")))
        df = groups.with_previous(df, known, f"_before_{c}")
    df = groups.close(df)
    if stored is not None:
        lacking = reduce(
            or_,
            [~F.array_contains("sent", c) & F.col(f"_before_{c}").isNull() for c in columns],
        )
        needy = df.filter(~removed & lacking).select(key).distinct()
        # One row per key on this side: a hot key is left to the adaptive skew join.
        held = stored.join(needy, key, "left_semi").select(
            key, F.struct(*columns).alias("_stored")
        )
        df = df.join(held, key, "left")
    else:
        df = df.withColumn(
            "_stored",
            F.struct(*[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in columns]),
        )
    filled = {
        c: F.when(removed | F.array_contains("sent", c), F.col(c))
        .when(F.col(f"_before_{c}").isNotNull(), F.col(f"_before_{c}.v"))
        .otherwise(F.col(f"_stored.{c}"))
        for c in columns
    }
    return df.withColumns(filled).select(*changes.columns)


class MessageLog:
    """Reading method over landed messages; the source's log has the columns of ``MESSAGE_SCHEMA``.

    Positions are those the messages were landed with. Besides the columns of every method, changes
    have ``sent``: whoever applies them restores the other columns (``restored``).
    """

    name = "messages"

    def install(self, source: Source) -> None:
        absent = [c for c in MESSAGE_SCHEMA.names if c not in source.log.columns]
        if absent:
            raise ValueError(f"{self.name} needs {', '.join(absent)} in the log")

    def start(self, source: Source) -> str:
        return "0/0"

    def ack(self, changes: DataFrame) -> None:
        return None

    def poll(self, source: Source, position: str | None) -> Poll:
        """Changes of all captured tables above the position, decoded in one pass.

        Polls that landed nothing above it are not decoded. Every commit comes along as a row without
        a table, so transactions without a captured change move the position too.
        """
        old = parse_lsn(F.lit(position or "0/0"))
        above = source.log.filter(parse_lsn("lsn") > old).select("batch_id").distinct()
        decoded = decode_messages(source.log.join(above, "batch_id", "left_semi"), commits=True)
        removed = F.col("op") == "D"
        image = F.when(removed, F.col("old")).otherwise(F.col("new"))
        keys, documents, versions = [], [], []
        for name, spec in source.specs.items():
            own = F.col("tbl") == name
            keys.append(F.when(own, F.element_at(image, spec.key)))
            fields = F.struct(*map_fields(F.col("new"), spec))
            documents.append(F.when(own & ~removed, row_document_of(fields)))
            versions.append(F.when(own, F.try_element_at("new", F.lit(spec.version))))
        listed = F.col("tbl").isin(*source.specs) | (F.col("op") == COMMIT)
        changes = decoded.filter((parse_lsn("lsn") > old) & listed).select(
            "tbl",
            F.when(removed, DELETE).otherwise(UPSERT).alias("op"),
            F.coalesce(*keys).cast("bigint").alias("pk"),
            F.coalesce(F.coalesce(*versions).cast("timestamp"), "commit_ts").alias("ts"),
            parse_lsn("lsn").alias(POS_HI),
            F.col("msg_no").alias(POS_LO),
            F.coalesce(*documents).alias("doc"),
            F.when(~removed, F.map_keys("new")).alias("sent"),
        )
        return Poll(changes, format_lsn(F.greatest(F.max(POS_HI), old)))


METHODS[MessageLog.name] = MessageLog


def restored(changes: DataFrame, spec: TableSpec, stored: DataFrame) -> DataFrame:
    """A landed batch of typed changes with the columns that were not sent; none is looked up that always was."""
    columns = [c for c in spec.image_names if c != spec.version]
    lacks = [F.count_if(~F.array_contains("sent", c)).alias(c) for c in columns]
    row = changes.filter(F.col("op") != DELETE).agg(*lacks).first()
    needed = [c for c in columns if row[c]]
    filled = fill_unsent(changes, spec.key, needed, stored) if needed else changes
    return filled.withColumn("ts", F.col("ts").cast(spec.version_type)).drop("sent")
