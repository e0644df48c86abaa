"""The source of landed messages: whole polls, restarts, acknowledgement."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.spark_queries import USERS
from weirflow.functions.positions import format_lsn, parse_lsn
from weirflow.sources import landed
from weirflow.sources.messages import decode_messages, decoded_changes
from weirflow.streaming import sync
from weirflow.streaming.store import Store


@pytest.fixture(scope="module")
def messages(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messages") / "m")
    fx.message_table(fx.derive(spark, sf_dir, fx.LOG_SQL)).write.parquet(path)
    landed.register(spark)
    return spark.read.parquet(path)


def read(spark, path):
    return spark.read.format(landed.FORMAT).load(path)


def same(a, b):
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_batch_reader_gives_whole_polls_only(spark, messages, folder):
    path = folder()
    few = messages.filter("batch_id <= 4")
    landed.land_polls(few, path)
    assert same(read(spark, path), few.select(*messages.columns))
    # A poll whose writer died before its mark, with half of its rows: not there, and written anew later.
    half = messages.filter("batch_id = 5").limit(7).withColumn("poll", F.col("batch_id"))
    half.write.partitionBy("poll").mode("append").parquet(path)
    assert same(read(spark, path), few.select(*messages.columns))
    landed.land_polls(messages, path)
    landed.land_polls(messages, path)
    assert same(read(spark, path), messages)


def test_an_empty_folder_has_no_rows(spark, messages, folder):
    path = folder()
    spark.range(0).write.parquet(path)
    assert read(spark, path).count() == 0


def run(spark, path, home, store):
    def changes(batch):
        return {"users": decoded_changes(decode_messages(batch), USERS).drop("sent")}

    stream = spark.readStream.format(landed.FORMAT).load(path)
    newest = format_lsn(F.max(parse_lsn("lsn")))
    sync.catch_up(sync.start_sync(stream, store, "wire", changes, newest, f"{home}/checkpoint"))


@pytest.mark.parametrize("crash", ["before", "after"])
def test_a_killed_run_neither_loses_nor_repeats_a_commit(spark, messages, folder, monkeypatch, crash):
    path, home = folder(), folder()
    store = Store(spark, f"{home}/store", [USERS])
    landed.land_polls(messages.filter("batch_id <= 3"), path)
    run(spark, path, home, store)
    landed.land_polls(messages, path)
    whole = Store.apply

    def broken(self, *args, **kwargs):
        if crash == "after":
            whole(self, *args, **kwargs)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "apply", broken)
        with pytest.raises(Exception, match="lost"):
            run(spark, path, home, store)
    run(spark, path, home, store)
    once = Store(spark, folder(), [USERS])
    typed = decoded_changes(decode_messages(messages), USERS).drop("sent")
    once.apply({"users": typed}, "wire", None)
    assert same(store.table("users"), once.table("users"))
    assert same(store.history("users"), once.history("users"))
    assert store.position("wire") == messages.select(format_lsn(F.max(parse_lsn("lsn")))).first()[0]


def test_polls_behind_the_acknowledgement_can_go(spark, messages, folder):
    path, home = folder(), folder()
    store = Store(spark, f"{home}/store", [USERS])
    landed.land_polls(messages.filter("batch_id <= 3"), path)
    run(spark, path, home, store)
    landed.land_polls(messages.filter("batch_id <= 6"), path)
    run(spark, path, home, store)  # the first offset is acknowledged when the next batch is planned
    assert landed.drop_acknowledged(path) > 0
    rows = store.table("users").collect()
    run(spark, path, home, store)
    assert sorted(store.table("users").collect()) == sorted(rows)
    left = {r["batch_id"] for r in read(spark, path).select("batch_id").distinct().collect()}
    assert left < {r["batch_id"] for r in messages.filter("batch_id <= 6").select("batch_id").distinct().collect()}
