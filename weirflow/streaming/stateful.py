"""Status history as a stateful stream: what is open per key lives in the state store.

The other way to keep history (``streaming.sync``) reads open periods from the store for every batch. Here Spark holds
them between batches, in buckets of keys and checkpointed, and a batch costs what its own buckets cost. Closed periods are
appended to files by the stream; the open ones are read from the state (``open_from_state``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from operator import itemgetter
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weirflow.model import DELETE, POS, POS_HI, POS_LO

# The processor travels with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# transformWithState keeps its state in this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = "open"
# Groups the keys of a stream are dealt to; a batch reads and writes the open periods of those it touches.
BUCKETS = 1 << 12


def _opened(key_type: T.DataType, key: str = "key") -> T.StructType:
    return T.StructType(
        [T.StructField(key, key_type), T.StructField("status", T.StringType()), T.StructField("from_us", T.LongType())]
    )


def _periods(key: str, key_type: T.DataType) -> T.StructType:
    return T.StructType([*_opened(key_type, key), T.StructField("to_us", T.LongType())])


class StatusHistory(StatefulProcessor):
    """Closes the open period of a key and opens the next as its status changes, in reading order.

    One call has all keys of a bucket, and state is the bucket's open periods as one value: asking for every key's by itself takes
    half a millisecond a key. The rows of a bucket in one micro-batch come in no order and are sorted by their position, so
    the micro-batch and the number of buckets bound what one call holds.
    """

    def __init__(self, key_type: T.DataType) -> None:
        self.key_type = key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState(_STATE, T.StructType([T.StructField("periods", T.ArrayType(_opened(self.key_type)))]))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:  # noqa: N803
        self.open.update(([(p["key"], p["status"], int(p["from_us"])) for p in initialState["periods"]],))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        changes: dict[Any, list[tuple]] = {}
        for row in rows:
            # Rows without a position come last.
            place = tuple((row[c] is None, row[c] or 0) for c in POS)
            changes.setdefault(row["key"], []).append((place, row["status"], row["at_us"]))
        held = self.open.get()
        before = {of: (status, from_us) for of, status, from_us in held[0]} if held else {}
        after = dict(before)
        for of, events in changes.items():
            opened = before.get(of)
            for _, status, at in sorted(events, key=itemgetter(0)):
                if status == (opened[0] if opened else None):
                    continue
                if opened:
                    yield Row(key=of, status=opened[0], from_us=opened[1], to_us=int(at))
                opened = (status, int(at)) if status is not None else None
            after[of] = opened
        after = {of: opened for of, opened in after.items() if opened}
        if before and not after:
            self.open.clear()
        elif after != before:
            self.open.update(([(of, *opened) for of, opened in after.items()],))

    def close(self) -> None:
        pass


def closed_periods(
    changes: DataFrame, key: str, status: str = "status", initial: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """A stream of periods as they end, from a stream of changes (key, op, ts, position, status).

    ``initial`` (key, status, valid_from) are periods open before the stream, such as those of a
    bootstrapped copy; Spark puts them into the state with the first micro-batch. A checkpoint keeps to its number of ``buckets``.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    of = F.col(key).alias("key")
    state = F.when(F.col("op") != DELETE, F.col(status).cast("string"))
    rows = changes.select(
        bucket, of, state.alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), POS_HI, POS_LO
    )
    first = None
    if initial is not None:
        held = initial.where(F.col(status).isNotNull())
        start = F.unix_micros(F.col("valid_from").cast("timestamp"))
        period = F.struct(of, F.col(status).cast("string").alias("status"), start.alias("from_us"))
        first = held.groupBy(bucket).agg(F.collect_list(period).alias("periods")).groupBy("bucket")
    key_type = changes.schema[key].dataType
    found = rows.groupBy("bucket").transformWithState(StatusHistory(key_type), _periods("key", key_type), "Append", "None", first)
    return found.withColumnRenamed("key", key)


def start_history(periods: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append ended periods to ``path`` until the stream has caught up; a file is listed once its batch is committed."""
    return (
        periods.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _as_times(rows: DataFrame, kind: str) -> DataFrame:
    at = lambda c: F.timestamp_micros(c).cast(kind)
    return rows.withColumns({"valid_from": at("from_us"), "valid_to": at("to_us")}).drop("from_us", "to_us")


def open_from_state(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """Open periods (key, status, from_us, to_us NULL) as of the last committed batch."""
    state = spark.read.format("statestore").option("stateVarName", _STATE).load(checkpoint)
    return state.select(F.inline("value.periods")).select(
        F.col("key").alias(key), "status", "from_us", F.lit(None).cast("bigint").alias("to_us")
    )


def history(spark: SparkSession, path: str, checkpoint: str, key: str, kind: str = "timestamp") -> DataFrame:
    """All periods: ``key, status, valid_from, valid_to``."""
    opened = open_from_state(spark, checkpoint, key)
    ended = spark.read.schema(_periods(key, opened.schema[key].dataType)).parquet(path)
    return _as_times(ended.unionByName(opened), kind)
