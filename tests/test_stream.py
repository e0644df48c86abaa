"""Structured streaming into the store: restart, re-delivery, compaction on the way."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.spark_queries import COLUMNS, USERS, _queue_changes
from weirflow.operators.history import status_periods
from weirflow.operators.upsert import net_changes, net_rows
from weirflow.streaming import sync
from weirflow.streaming.store import Store

IMAGE = [*COLUMNS, "updated_at"]


def run(spark, folder, store, schema, files=None):
    query = sync.start_sync(
        sync.landed_log(spark, f"{folder}/landed", schema, files),
        store,
        "queue",
        lambda batch: {"users": _queue_changes(batch)},
        sync.max_sequence(),
        f"{folder}/checkpoint",
        compact_every=2,
    )
    sync.catch_up(query)


def land(log, folder, low, high):
    part = log.filter((F.col("poll_no") >= low) & (F.col("poll_no") < high))
    part.coalesce(1).write.mode("append").parquet(f"{folder}/landed")


@pytest.mark.parametrize("crash", [None, "append", "publish", "after"])
def test_stream_survives_crashes(spark, sf_dir, folder, monkeypatch, crash):
    log, home = fx.derive(spark, sf_dir, fx.LOG_SQL), folder()
    store = Store(spark, f"{home}/store", [USERS])
    land(log, home, 0, 4)
    run(spark, home, store, log.schema)
    land(log, home, 4, 8)
    if crash:
        target = {"append": "_write_periods", "publish": "_publish", "after": "apply"}[crash]
        whole = getattr(Store, target)

        def broken(self, *args):
            if crash == "after":
                whole(self, *args)
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(Store, target, broken)
            with pytest.raises(Exception, match="lost"):
                run(spark, home, store, log.schema)
    run(spark, home, store, log.schema)
    land(log, home, 8, 99)
    run(spark, home, store, log.schema)
    changes = _queue_changes(log)
    rows = net_rows(net_changes(changes, ["pk"], COLUMNS), ["pk"], IMAGE)
    got = store.table("users").select("pk", *IMAGE)
    assert got.count() == rows.count() and got.exceptAll(rows).count() == 0
    periods = status_periods(changes, ["pk"]).drop("seeded")
    history = store.history("users")
    assert history.count() == periods.count() and history.exceptAll(periods).count() == 0
    assert store.position("queue") == str(log.agg(F.max("seq")).first()[0])
