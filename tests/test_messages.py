"""Decoding hand-built messages, error cases, and polls cut into segments."""

from datetime import datetime

import pytest

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.spark_queries import COLUMNS, USERS
from tests import wire
from weirflow.functions.positions import format_lsn, format_lsn_text, parse_lsn
from weirflow.model import MESSAGE_SCHEMA, TableSpec
from weirflow.operators.upsert import net_changes, net_rows
from weirflow.sources.messages import (
    decode_messages,
    decoded_changes,
    fill_unsent,
    poll_messages,
    transactions,
)
from weirflow.session import ONE_TASK_CONF, materialize
from weirflow.sources import ranges
from weirflow.sources.ranges import decode_ranges, last_relations
from weirflow.streaming import sync
from weirflow.streaming.store import Store


def rows(df):
    return df.orderBy("batch_id", "msg_no").collect()


def test_insert_update_delete_in_one_transaction(spark):
    decoded = decode_messages(
        wire.landed(
            spark,
            wire.begin(),
            wire.relation(),
            wire.insert("1", "pending"),
            wire.update(("1", "shipped"), old=("1", None)),
            wire.delete("1", None),
            wire.commit(),
        )
    )
    # Time 1,000,000 of the server's clock is one second into the year 2000.
    at = datetime(2000, 1, 1, 0, 0, 1)
    pending, shipped, key = ({"order_id": "1", "status": s} for s in ("pending", "shipped", None))
    expected = [
        (7, 100, at, "shop", "orders", op, new, old, ["order_id"])
        for op, new, old in (("I", pending, None), ("U", shipped, key), ("D", None, key))
    ]
    columns = ["xid", "commit_lsn", "commit_ts", "schema_name", "tbl", "op", "new", "old", "key_columns"]
    assert [tuple(r) for r in decoded.orderBy("msg_no").select(*columns).collect()] == expected


def test_relation_serves_later_transactions_and_can_change(spark):
    wider = (("order_id", 1), ("status", 0), ("channel", 0))
    got = rows(
        decode_messages(
            wire.landed(
                spark,
                wire.begin(), wire.relation(), wire.commit(),
                wire.begin(200, 8), wire.insert("2", "pending"), wire.commit(200),
                wire.begin(300, 9), wire.relation(columns=wider), wire.insert("3", "x", "web"),
                wire.commit(300),
            )
        )
    )
    assert [(r.tbl, r.xid, len(r.new)) for r in got] == [("orders", 8, 2), ("orders", 9, 3)]


def test_unsent_values_are_absent_not_null(spark):
    got = rows(
        decode_messages(
            wire.landed(
                spark, wire.begin(), wire.relation(), wire.update(("1", ...), marker=b"O", old=("1", "é")),
                wire.commit(),
            )
        )
    )
    assert got[0].new == {"order_id": "1"}
    assert got[0].old["status"] == "é"


def test_other_message_kinds_are_skipped(spark):
    df = wire.landed(spark, wire.begin(), b"Yanything", b"O", b"T123", b"Mxyz", wire.commit())
    assert rows(decode_messages(df)) == []


@pytest.mark.parametrize(
    "messages, text",
    [
        ([wire.relation(), wire.insert("1", "x")], "no Begin is open"),
        ([wire.commit()], "no Begin is open"),
        ([wire.begin(), wire.relation(), wire.commit(), wire.insert("1", "x")], "no Begin"),
        ([wire.begin(), wire.relation(), wire.insert("1", "x")], "without commit"),
        ([wire.begin(), wire.insert("1", "x"), wire.commit()], "not announced"),
        ([wire.begin(), wire.relation(), wire.insert("1", "x")[:-1], wire.commit()], "ends inside a value"),
        ([wire.begin(), wire.relation(), wire.insert("1", "xyz")[:-5], wire.commit()], "ends inside a"),
        ([wire.begin(), wire.relation()[:-2], wire.insert("1", "x"), wire.commit()], "ends inside a number"),
        (
            [wire.begin(), wire.relation(), wire.insert("1").replace(b"N", b"X"), wire.commit()],
            "the row after the change is marked",
        ),
        (
            [wire.begin(), wire.relation(), wire.insert("1").replace(b"t", b"b"), wire.commit()],
            "says neither text nor none",
        ),
    ],
)
def test_broken_streams_fail(spark, messages, text):
    with pytest.raises(Exception, match=text):
        decode_messages(wire.landed(spark, *messages)).collect()


def test_relations_do_not_cross_polls(spark):
    first = wire.landed(spark, wire.begin(), wire.relation(), wire.commit())
    second = wire.landed(spark, wire.begin(), wire.insert("1", "x"), wire.commit(), batch=2)
    with pytest.raises(Exception, match="not announced"):
        decode_messages(first.unionByName(second)).collect()


def test_polls_too_big_for_one_task(spark, sf_dir):
    """Cutting every poll into small segments changes nothing."""
    messages = fx.message_table(fx.derive(spark, sf_dir, fx.LOG_SQL))
    columns = ["batch_id", "msg_no", "xid", "commit_lsn", "lsn", "tbl", "op", "new", "old"]

    def as_text(df):
        return sorted(str(tuple(r)) for r in df.select(*columns).collect())

    whole, cut = decode_messages(messages), decode_messages(messages, hot_rows=30)
    assert as_text(whole) == as_text(cut)
    assert {r.lsn == format_lsn_text(r.commit_lsn) for r in whole.collect()} == {True}
    assert transactions(whole).agg({"n_changes": "sum"}).first()[0] == 1000


@pytest.mark.parametrize("cut", [1, 7, 40])
def test_ranges_give_what_windows_give(spark, sf_dir, cut):
    messages = fx.message_table(fx.derive(spark, sf_dir, fx.LOG_SQL))
    columns = ["batch_id", "msg_no", "xid", "commit_lsn", "lsn", "tbl", "op", "new", "old"]

    def as_text(df):
        return sorted(str(tuple(r)) for r in df.select(*columns).collect())

    assert as_text(decode_ranges(messages, ranges=cut, commits=True)) == as_text(decode_messages(messages, commits=True))


def test_ranges_fail_as_windows_do(spark):
    for messages, text in (
        ([wire.begin(), wire.commit(), wire.insert("1", "x"), wire.begin(), wire.commit()], "no Begin"),
        ([wire.begin(), wire.relation(), wire.insert("1", "x")], "without commit"),
        ([wire.begin(), wire.insert("1", "x"), wire.commit()], "not announced"),
    ):
        with pytest.raises(Exception, match=text):
            decode_ranges(wire.landed(spark, *messages), ranges=3).collect()
    assert decode_ranges(wire.landed(spark, wire.begin(), wire.commit()).limit(0)).collect() == []


def test_ranges_are_no_longer_than_they_should_be_and_held_by_no_python(spark, sf_dir, monkeypatch):
    messages = fx.message_table(fx.derive(spark, sf_dir, fx.LOG_SQL)).withColumn("batch_id", F.lit(0).cast("bigint"))
    whole = decode_ranges(messages, ranges=2)
    assert "MapInArrow" not in whole._jdf.queryExecution().toString()
    written = []
    monkeypatch.setattr(ranges, "RANGE_ROWS", 100)
    monkeypatch.setattr(ranges, "materialize", lambda df, name: written.append(materialize(df, name)) or written[-1])
    cut = decode_ranges(messages, ranges=2)
    assert written[0].select("part").distinct().count() > 8
    as_text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert as_text(cut) == as_text(whole) and cut.count() == 1000


def test_polls_above_one_task_are_decoded_by_ranges(spark, sf_dir, monkeypatch):
    messages = fx.message_table(fx.derive(spark, sf_dir, fx.LOG_SQL))
    whole = decode_messages(messages, commits=True)
    assert "part#" not in whole._jdf.queryExecution().toString()
    spark.conf.set(ONE_TASK_CONF, "0")
    try:
        monkeypatch.setattr(ranges, "RANGE_ROWS", 100)
        cut = decode_messages(messages, commits=True)
    finally:
        spark.conf.unset(ONE_TASK_CONF)
    assert "part#" in cut._jdf.queryExecution().toString()
    as_text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert as_text(cut) == as_text(whole)


def test_own_announcements_replace_known_ones(spark):
    first = wire.landed(spark, wire.begin(), wire.relation(), wire.commit())
    wider = (("order_id", 1), ("status", 0), ("channel", 0))
    second = wire.landed(
        spark, wire.begin(), wire.insert("2", "y"), wire.commit(),
        wire.begin(200, 8), wire.relation(columns=wider), wire.insert("3", "x", "web"), wire.commit(200), batch=2,
    )
    for n in (1, 3, 7):
        got = rows(decode_ranges(second, last_relations(first), ranges=n))
        assert [sorted(r.new.values()) for r in got] == [["2", "y"], ["3", "web", "x"]]


def test_relations_of_earlier_polls_are_known(spark):
    first = wire.landed(spark, wire.begin(), wire.relation(), wire.insert("1", "x"), wire.commit())
    second = wire.landed(spark, wire.begin(), wire.insert("2", "y"), wire.commit(), batch=2)
    got = decode_ranges(second, last_relations(first), ranges=2).collect()
    assert [(r.tbl, sorted(r.new.values())) for r in got] == [("orders", ["2", "y"])]


SPEC = TableSpec("t", "id", (("id", "bigint"), ("a", "string"), ("b", "string")))


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_unsent_values_come_from_the_state_before(spark, hot_rows):
    at = "2026-01-01 00:00:0{}".format
    cols = (("id", 1), ("a", 0), ("b", 0), ("updated_at", 0))
    df = wire.landed(
        spark,
        wire.begin(), wire.relation(table="t", columns=cols),
        wire.update(("1", ..., "b1", at(1))),  # a from the stored row
        wire.update(("1", "a2", ..., at(2))),  # b from the change before
        wire.delete("1", None, None, None),
        wire.insert("1", None, "b3", at(3)),
        wire.update(("1", ..., ..., at(4))),  # a stays NULL as inserted
        wire.update(("2", ..., "z", at(5))),  # nothing known anywhere
        wire.commit(),
    )
    stored = spark.createDataFrame([(1, "a0", "b0")], "id bigint, a string, b string")
    changes = decoded_changes(decode_messages(df), SPEC)
    filled = fill_unsent(changes, "id", ["a", "b"], stored, hot_rows)
    got = [(r.id, r.op, r.a, r.b) for r in filled.orderBy("pos_hi", "pos_lo").collect()]
    assert got == [
        (1, "U", "a0", "b1"),
        (1, "U", "a2", "b1"),
        (1, "D", None, None),
        (1, "U", None, "b3"),
        (1, "U", None, "b3"),
        (2, "U", None, "z"),
    ]


def test_polling_above_a_commit_position(spark):
    df = wire.landed(
        spark,
        wire.begin(100, 1), wire.relation(), wire.insert("1", "a"), wire.commit(100),
        wire.begin(200, 2), wire.insert("2", "b"), wire.commit(200),
        wire.begin(300, 3), wire.commit(300),
    )
    spec = TableSpec("orders", "order_id", (("order_id", "bigint"), ("status", "string")))
    changes, position = poll_messages(df, [spec], "0/64")
    assert [(r.order_id, r.status) for r in changes["orders"].collect()] == [(2, "b")]
    assert position.first().position == "0/12C"
    nothing, same = poll_messages(df.limit(0), [spec], "0/64")
    assert nothing["orders"].count() == 0 and same.first().position == "0/64"


def test_messages_stream_into_the_store(spark, sf_dir, folder):
    """Landed messages, decoded and applied per micro-batch, restored values included."""
    log, home = fx.derive(spark, sf_dir, fx.LOG_SQL), folder()
    messages = fx.message_table(log)
    store = Store(spark, f"{home}/store", [USERS])
    for low, high in ((0, 4), (4, 99)):
        part = messages.filter(f"batch_id >= {low} and batch_id < {high}")
        part.write.mode("append").parquet(f"{home}/landed")

        def changes(batch):
            typed = poll_messages(batch, [USERS], store.position("wire"))[0]["users"]
            return {"users": fill_unsent(typed, "pk", ["amount_cents"], store.table("users"))}

        sync.catch_up(
            sync.start_sync(
                sync.landed_log(spark, f"{home}/landed", MESSAGE_SCHEMA),
                store,
                "wire",
                changes,
                format_lsn(F.max(parse_lsn("lsn"))),
                f"{home}/checkpoint",
            )
        )
    columns = ["pk", "status", "amount_cents", "updated_at"]
    decoded = decoded_changes(decode_messages(messages), USERS)
    expected = net_rows(
        net_changes(fill_unsent(decoded, "pk", ["amount_cents"]), ["pk"], COLUMNS),
        ["pk"], columns[1:],
    )
    got = store.table("users").select(*columns)
    assert got.count() == expected.count()
    assert got.exceptAll(expected).count() == 0
    assert store.position("wire") == log.select(format_lsn(F.max("commit_lsn"))).first()[0]
