"""Polls over sources that go on growing, and documents that do not hold what they should."""

import datetime

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.spark_queries import USERS
from weirflow.functions.documents import document_fields, mark_text
from weirflow.functions.positions import format_lsn
from weirflow.model import TableSpec
from weirflow.operators.ordered import SEG, cut_hot_groups
from weirflow.sources.capture import METHODS, Source
from weirflow.sources.messages import MessageLog
from weirflow.streaming.store import Store
from weirflow.streaming.sync import sync_once

LOG = "seq long, tbl string, op string, pk long, row_data string, changed_at timestamp_ntz, commit_lsn long, poll_no long, txid long"


def entry(n):
    at = datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=n)
    document = f'{{"pk": {n}, "status": "s{n % 3}", "amount_cents": {n}, "updated_at": "{at.isoformat()}.000000"}}'
    return n, "users", "I", n, document, at, n * 2, 1, n


class Growing:
    """A log folder that gets more rows whenever a plan over it is started."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        self.grow()

    def grow(self):
        rows = [entry(self.n + i + 1) for i in range(5)]
        self.n += 5
        self.spark.createDataFrame(rows, LOG).write.mode("append").parquet(self.path)

    def log(self):
        self.grow()
        return self.spark.read.schema(LOG).parquet(self.path)


@pytest.mark.parametrize("method", ["sequence", "queue", "commit_order"])
def test_rows_position_and_history_come_from_one_read(spark, folder, method, monkeypatch):
    """The source grows between the landing and everything that follows."""
    source, store = Growing(spark, folder()), Store(spark, folder(), [USERS])
    land = Store.land
    monkeypatch.setattr(Store, "land", lambda self, *a, **k: (x := land(self, *a, **k), source.grow())[0])
    for _ in range(3):
        sync_once(store, METHODS[method](), Source({"users": USERS}, log=source.log()))
    log = spark.read.schema(LOG).parquet(source.path)
    sync_once(store, METHODS[method](), Source({"users": USERS}, log=log))
    assert store.table("users").count() == store.history("users").count() == log.count() > 20


def test_a_queue_poll_is_applied_once(spark, folder):
    store = Store(spark, folder(), [USERS])
    log = spark.createDataFrame([entry(n) for n in range(1, 30)], LOG)
    for _ in range(12):  # more polls than parts are kept apart
        sync_once(store, METHODS["queue"](), Source({"users": USERS}, log=log))
    assert store.history("users").count() == 29
    assert [tuple(r) for r in store.taken("queue").collect()] == [(1, 29)]
    assert store.files.names(f"{store.root}/_landed") == []


SPEC = TableSpec("t", "id", (("id", "bigint"), ("n", "int")), version_type="timestamp_ntz")


def read(spark, document, spec=SPEC):
    return spark.createDataFrame([(document,)], "doc string").select(document_fields(F.col("doc"), spec).alias("d")).first()["d"]


def test_zoned_times_become_clock_times(spark):
    at = datetime.datetime(2026, 1, 1)
    for text in ("2026-01-01T00:00:00", "2026-01-01T00:00:00Z", "2026-01-01T02:00:00+02:00", "2025-12-31 22:30:00-01:30"):
        assert read(spark, f'{{"id": 1, "updated_at": "{text}"}}')["updated_at"] == at
    assert read(spark, None) is None and read(spark, '{"id": 2, "more": []}') == (2, None, None)


@pytest.mark.parametrize("document", ['{"id": 1', '{"id": "x"}', '{"id": 1, "n": 1.5}', '{"id": 1, "updated_at": "yesterday"}'])
def test_a_document_that_cannot_be_read_is_an_error(spark, document):
    with pytest.raises(Exception, match="MALFORMED|CAST_INVALID|parse"):
        read(spark, document)


def test_the_version_column_is_the_table_s_own(spark):
    spec = TableSpec("t", "pk", (("pk", "bigint"),), version="seen_at", version_type="timestamp_ntz")
    row = (1, "t", "I", 1, '{"pk": 1, "seen_at": "2020-05-01T00:00:00"}', datetime.datetime(2026, 1, 1), 2, 1, 1)
    poll = METHODS["sequence"]().poll(Source({"t": spec}, log=spark.createDataFrame([row], LOG)), "0")
    assert poll.changes.first()["ts"] == datetime.datetime(2020, 5, 1)


def test_marks_of_instants_keep_their_offset(spark):
    df = spark.sql("select timestamp '2026-10-25 00:30:00Z' as t, timestamp_ntz '2026-10-25 00:30:00' as n")
    texts = df.select(*[mark_text(F.col(c), df.schema[c].dataType) for c in "tn"]).first()
    assert texts == ("2026-10-25T00:30:00.000000Z", "2026-10-25T00:30:00.000000")


def test_far_outliers_do_not_keep_a_segment_whole(spark):
    places = [*range(10_000), 1 << 40, 1 << 62]
    df = spark.createDataFrame([(1, p) for p in places], "k long, at long")
    cut = cut_hot_groups(df, ["k"], ["at"], 1000)
    rows = cut.groupBy(SEG).agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).orderBy(SEG).collect()
    assert max(r["n"] for r in rows) <= 1000 and sum(r["n"] for r in rows) == len(places)
    assert all(a["high"] < b["low"] for a, b in zip(rows, rows[1:], strict=False))


def test_messages_sync_rows_periods_and_position(spark, sf_dir, folder):
    """By polls with values restored from the store, and all at once: the same rows, periods and position."""
    log = fx.derive(spark, sf_dir, fx.LOG_SQL)
    messages = fx.message_table(log)
    made = []
    for polls in ((1, 4, 4, 99), (99,)):
        store = Store(spark, folder(), [USERS])
        for poll in polls:
            source = Source({"users": USERS}, log=messages.filter(F.col("batch_id") <= poll))
            MessageLog().install(source)
            sync_once(store, MessageLog(), source)
        made.append([sorted(map(str, df.collect())) for df in (store.table("users"), store.history("users"))])
        assert store.position("messages") == log.select(format_lsn(F.max("commit_lsn"))).first()[0]
    assert made[0] == made[1] and len(made[0][0]) > 10
