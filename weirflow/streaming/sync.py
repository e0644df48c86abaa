"""Incremental sync: position, poll, apply, acknowledge - by poll or as a stream."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weirflow.model import TableSpec
from weirflow.operators.changes import known_tables, route
from weirflow.sources.capture import Capture, Source
from weirflow.sources.messages import restored
from weirflow.streaming.store import Store

# Landed files stay known for ten years; the default forgets them after a week.
KEEP_FILES = "3650d"


def typed_batches(changes: DataFrame, specs: Sequence[TableSpec]) -> dict[str, DataFrame]:
    """Document changes as one typed DataFrame per table; unknown tables fail the batch."""
    checked = known_tables(changes, [s.name for s in specs])
    return {s.name: route(checked, s) for s in specs}


def sync_once(store: Store, capture: Capture, source: Source) -> bool:
    """One poll of a reading method into the store; fails on a source that lacks what the method reads.

    The source is read once: the poll is landed in the store's folder. The position and the buckets it touches are
    taken from it while it is written, the rows applied and the numbers taken from the landed copy, and all are committed
    together. A poll that dies before the commit is read again, one after it is not.
    """
    capture.install(source)
    taken = store.taken(capture.name)
    poll = capture.poll(source if taken is None else replace(source, taken=taken), store.position(capture.name))
    specs = list(store.specs.values())
    lies_in = {f"in_{i}": store.touched(s, "pk", F.col("tbl") == s.name) for i, s in enumerate(specs)}
    with store.land(capture.name, poll.changes, position=poll.top, **lies_in) as landed:
        changes = landed.rows.filter(F.col("tbl").isNotNull())
        buckets = {s.name: landed.facts.get(f"in_{i}") or [] for i, s in enumerate(specs)}
        batches = typed_batches(changes, specs)
        if "sent" in changes.columns:
            batches = {
                n: restored(df, store.specs[n], store.table(n, buckets=buckets[n])) for n, df in batches.items() if buckets[n]
            }
        position = landed.facts.get("position", store.position(capture.name))
        return store.apply(batches, capture.name, position, taken=capture.ack(changes), buckets=buckets)


def landed_log(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of landed Parquet files; every file is taken once, whatever it holds."""
    reader = spark.readStream.schema(schema).option("maxFileAge", KEEP_FILES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_sync(
    stream: DataFrame,
    store: Store,
    consumer: str,
    to_changes: Callable[[DataFrame], Mapping[str, DataFrame]],
    position: Column,
    checkpoint: str,
    compact_every: int | None = 8,
) -> StreamingQuery:
    """Apply every micro-batch of a landed log to the store, until it has caught up.

    ``to_changes`` turns a micro-batch into typed changes per table; ``position``
    is an aggregate over the micro-batch, saved as text with the data. The
    checkpoint re-delivers a batch after a crash, the store's batch number makes
    the second delivery a no-op. A table with ``compact_every`` batches since it was last compacted is compacted.
    """

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        # Landed once, as it came: everything below reads that copy.
        with store.land(consumer, batch, position=position.cast("string")) as landed:
            changes = to_changes(landed.rows)
            buckets = {n: df.agg(store.touched(store.specs[n])).first()[0] for n, df in changes.items()}
            top = landed.facts.get("position")
            saved = store.position(consumer) if top is None else top
            applied = store.apply(changes, consumer, saved, batch_id, None, buckets)
        if applied and compact_every:
            tables = store.current()["tables"]
            due = [n for n in store.specs if len(tables.get(n, {"nets": ()})["nets"]) >= compact_every]
            if due:
                store.compact(due)

    return (
        stream.writeStream.foreachBatch(apply_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def catch_up(query: StreamingQuery) -> None:
    """Wait for an available-now run; a failed batch raises here."""
    query.awaitTermination()


def write_result(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(path)


def max_sequence() -> Column:
    return F.max("seq")
