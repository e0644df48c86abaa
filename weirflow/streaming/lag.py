"""How far a running sync lags: what each micro-batch read, noted as it finishes.

The stream carries an observation, so the figures come from the pass that lands the batch and cost no
job of their own. A listener writes them beside the store, a file per batch; they outlive the run.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from weirflow.streaming.store import Files

_NAME = "lag"


def observed(stream: DataFrame, position: Column) -> DataFrame:
    """The stream with its number of rows and highest position observed."""
    return stream.observe(_NAME, F.count(F.lit(1)).alias("n"), position.cast("bigint").alias("position"))


class LagNotes(StreamingQueryListener):
    """Writes ``batch_id, n, position`` of every batch with rows to a folder of the store."""

    def __init__(self, spark: SparkSession, root: str, consumer: str) -> None:
        self.folder = f"{root.rstrip('/')}/_lag/{consumer}"
        self.files = Files(spark, root)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(_NAME)
        if seen is None or not seen["n"]:
            return
        note = {"batch_id": event.progress.batchId, "n": seen["n"], "position": seen["position"]}
        path = f"{self.folder}/{event.progress.batchId}.json"
        self.files.remove(path)  # a batch that was delivered again says the same
        self.files.publish_text(path, json.dumps(note))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def settled(notes: LagNotes, batches: int, seconds: float = 30.0) -> None:
    """Wait until the notes of so many batches are there: progress is told after a batch, from a thread of its own."""
    until = time.monotonic() + seconds
    while sum(n.endswith(".json") for n in notes.files.names(notes.folder)) < batches and time.monotonic() < until:
        time.sleep(0.05)


def lag_by_batch(spark: SparkSession, root: str, consumer: str, log: DataFrame, position: str = "commit_lsn") -> DataFrame:
    """``batch_id, position, end_lsn, lag_bytes, unread`` after each batch, against the log as it is now.

    One row per micro-batch goes through the window.
    """
    notes = spark.read.schema("batch_id long, n long, position long").json(f"{root.rstrip('/')}/_lag/{consumer}")
    upto = W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)
    end, total = log.agg(F.max(position)).scalar(), log.agg(F.count(F.lit(1))).scalar()
    at, read = F.max("position").over(upto).alias("position"), F.sum("n").over(upto).alias("read")
    ends = {"end_lsn": end, "total": total}
    return notes.select("batch_id", at, read).withColumns(ends).select(
        "batch_id", "position", "end_lsn", (F.col("end_lsn") - F.col("position")).alias("lag_bytes"),
        (F.col("total") - F.col("read")).alias("unread"),
    )
