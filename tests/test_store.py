"""The versioned store: commits, replays, crashes, compaction, reload."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.sequential import fold_periods, fold_rows
from tests.test_rules import random_log
from weirflow.model import TableSpec
from weirflow.streaming import store as store_module
from weirflow.streaming.store import Store

SPEC = TableSpec(
    "t", "pk", (("pk", "bigint"), ("status", "string")), version_type="bigint", tracked="status"
)
PLAIN = TableSpec("p", "pk", (("pk", "bigint"), ("status", "string")), version_type="bigint")
SCHEMA = "pk bigint, op string, pos_hi bigint, pos_lo bigint, updated_at bigint, status string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("updated_at"))


def rows_in(store, name="t"):
    return {r.pk: (r.updated_at, r.status) for r in store.table(name).collect()}


def periods_in(store):
    columns = ["pk", "status", "valid_from", "valid_to"]
    return sorted((tuple(r) for r in store.history("t").select(*columns).collect()), key=str)


def base(spark):
    rows = [(k, "old", 1) for k in range(6)]
    return spark.createDataFrame(rows, "pk bigint, status string, updated_at bigint")


@pytest.fixture
def store(spark, folder):
    made = Store(spark, folder(), [SPEC])
    made.bootstrap({"t": base(spark)}, {"c": "0"})
    return made


def test_bootstrap(store):
    assert rows_in(store) == {k: (1, "old") for k in range(6)}
    assert periods_in(store) == [(k, "old", 1, None) for k in range(6)]
    assert store.position("c") == "0" and store.position("nobody") is None


def test_batches_equal_one_by_one_application(spark, store):
    log = random_log(21, n=240, keys=9)
    stored = {k: (1, "old") for k in range(6)}
    events = [(pk, op, ts, s) for pk, op, _, _, ts, s in log]
    for i in range(4):
        part = log[i * 60 : (i + 1) * 60]
        assert store.apply({"t": batch(spark, part)}, "c", str(i), i)
        if i == 2:
            store.compact()
    assert rows_in(store) == fold_rows(events, stored)
    assert periods_in(store) == fold_periods(events, {k: ("old", 1) for k in stored})
    opened = store.open_periods("t").groupBy("pk").count().filter("count > 1").count()
    assert opened == 0
    state = store.consumers().first()
    assert (state.position, state.batch_id) == ("3", 3)


def test_replays_and_older_versions(spark, store):
    newer = batch(spark, [(1, "U", 1, 0, 2099, "shipped")])
    older = batch(spark, [(1, "U", 2, 0, 0, "canceled")])
    store.apply({"t": newer}, "c", "1")
    store.apply({"t": newer}, "c", "1")
    store.apply({"t": older}, "c", "2")
    assert rows_in(store)[1] == (2099, "shipped")
    assert store.open_periods("t").filter("pk = 1").count() == 1


def test_a_committed_batch_is_not_applied_again(spark, store):
    moves = batch(spark, [(1, "U", 1, 0, 5, "a"), (1, "U", 2, 0, 6, "b")])
    assert store.apply({"t": moves}, "c", "1", 0)
    once = periods_in(store)
    assert not store.apply({"t": moves}, "c", "1", 0)
    assert periods_in(store) == once
    assert store.apply({"t": moves}, "other", "1", 0)


@pytest.mark.parametrize("at", ["write", "publish"])
def test_a_crash_leaves_the_last_version(spark, store, monkeypatch, at):
    before = rows_in(store), periods_in(store), store.position("c")
    moves = batch(spark, [(1, "U", 1, 0, 5, "a"), (2, "D", 2, 0, 6, None)])
    with monkeypatch.context() as broken:
        if at == "publish":
            broken.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        else:
            broken.setattr(
                Store, "_write_periods", lambda *a: (_ for _ in ()).throw(OSError("lost"))
            )
        with pytest.raises(OSError, match="lost"):
            store.apply({"t": moves}, "c", "1", 0)
    assert (rows_in(store), periods_in(store), store.position("c")) == before
    assert store.apply({"t": moves}, "c", "1", 0)
    assert rows_in(store)[1] == (5, "a") and 2 not in rows_in(store)
    assert (2, "old", 1, 6) in periods_in(store)


def test_a_version_is_never_overwritten(spark, store):
    manifest = store.current()
    with pytest.raises(Exception, match="exist"):
        store._publish(manifest)


def test_full_reload_keeps_history_and_positions(spark, store):
    store.apply({"t": batch(spark, [(1, "U", 1, 0, 5, "a")])}, "c", "7", 0)
    history = periods_in(store)
    fresh = spark.createDataFrame([(9, "x", 3)], "pk bigint, status string, updated_at bigint")
    assert store.full_reload({"t": fresh}) == {"t": 1}
    assert rows_in(store) == {9: (3, "x")}
    assert periods_in(store) == history and store.position("c") == "7"


def test_tables_without_history_and_empty_batches(spark, folder):
    made = Store(spark, folder(), [PLAIN])
    empty = batch(spark, []).limit(0)
    assert made.apply({"p": empty}, "c", "0", 0)
    assert rows_in(made, "p") == {}
    made.apply({"p": batch(spark, [(1, "U", 1, 0, 5, "a"), (2, "D", 1, 1, 6, None)])}, "c", "1", 1)
    assert rows_in(made, "p") == {1: (5, "a")}
    assert made.consumers().first().position == "1"


def test_reading_does_not_depend_on_the_size_of_the_nets(spark, store, monkeypatch):
    log = random_log(22, n=120, keys=9)
    store.apply({"t": batch(spark, log[:60])}, "c", "1", 0)
    store.apply({"t": batch(spark, log[60:])}, "c", "2", 1)
    small = rows_in(store)
    monkeypatch.setattr(store_module, "SMALL_NET_BYTES", 0)
    assert rows_in(store) == small


def test_compaction_keeps_the_state_and_untouched_files(spark, folder):
    made = Store(spark, folder(), [SPEC], buckets=5)
    stored = spark.createDataFrame([(k, "old", 1) for k in range(40)], "pk bigint, status string, updated_at bigint")
    made.bootstrap({"t": stored}, {"c": "0"})
    log = random_log(23, n=200, keys=3)
    for i in range(5):
        made.apply({"t": batch(spark, log[i * 40 : (i + 1) * 40])}, "c", str(i), i)
        if i in (1, 2):
            before = rows_in(made), periods_in(made)
            made.compact()
            assert (rows_in(made), periods_in(made)) == before
            entry = made.current()["tables"]["t"]
            assert entry["nets"] == [] and len(entry["base"]) == 2  # buckets without changes keep their files
            assert made.at(made.current()["version"])["history"]["t"]["now"][-1]["cut"]
    events = [(pk, op, ts, s) for pk, op, _, _, ts, s in log]
    assert rows_in(made) == fold_rows(events, {k: (1, "old") for k in range(40)})
    assert periods_in(made) == fold_periods(events, {k: ("old", 1) for k in range(40)})


def test_expiry_deletes_what_no_kept_version_lists(spark, store):
    for i in range(3):
        store.apply({"t": batch(spark, [(i, "U", i, 0, 5 + i, "a")])}, "c", str(i), i)
    store.compact()
    state = rows_in(store), periods_in(store)
    old = store.versions()[0]
    spark.range(3).write.parquet(f"{store.root}/_landed/left-behind")
    assert store.expire(keep=1) > 2
    assert (rows_in(store), periods_in(store)) == state and store.versions() == [5]
    assert store.files.names(f"{store.root}/_landed") == [] and old not in store.versions()
    assert store.expire(keep=1) == 0
    store.apply({"t": batch(spark, [(1, "D", 9, 0, 50, None)])}, "c", "9", 9)
    assert 1 not in rows_in(store)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_batch_opens_its_buckets_only(spark, folder):
    made = Store(spark, folder(), [SPEC], buckets=8)
    rows = spark.range(400).selectExpr("id as pk", "'old' as status", "1L as updated_at")
    made.bootstrap({"t": rows}, {"c": "0"})
    made.apply({"t": batch(spark, [(7, "U", 1, 0, 5, "a")])}, "c", "1", 1)
    [touched] = made.current()["tables"]["t"]["nets"][0]["buckets"]
    opened = made.open_periods("t", buckets=[touched])
    filters = plan(opened).split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket#" in filters and "kind#" in filters and 20 < opened.count() < 100
    read = made._read("t", made.current()["tables"]["t"]["base"], SPEC.schema, [touched])
    files = read.select(F.regexp_extract(F.input_file_name(), "bucket=([0-9]+)", 1).alias("b")).distinct().collect()
    assert [r["b"] for r in files] == [str(touched)]


def test_nets_and_periods_share_one_shuffle(spark, folder, monkeypatch):
    made = Store(spark, folder(), [SPEC])
    made.bootstrap({"t": base(spark)}, {"c": "0"})
    plans = []
    write = Store._write
    monkeypatch.setattr(Store, "_write", lambda self, df, *a, **k: (plans.append(plan(df)), write(self, df, *a, **k))[1])
    monkeypatch.setattr(store_module, "fits_one_task", lambda df: False)
    made.apply({"t": batch(spark, [(1, "U", 1, 0, 5, "a"), (2, "D", 2, 0, 6, None)])}, "c", "1", 1)
    for text in plans:
        physical = text.split("== Physical Plan ==")[1]
        above = physical.split("InMemoryTableScan")[0] if "InMemoryTableScan" in physical else physical
        assert "Exchange hashpartitioning(bucket#" not in re.sub(r"Exchange hashpartitioning\(bucket#\d+, \d+\), REPARTITION", "", above)


def test_saved_positions_carry_their_time(store):
    assert isinstance(store.consumers().first().updated_at, datetime)
