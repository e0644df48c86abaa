"""Hand-made cases: several moves in one batch, replays and older versions, positions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.sequential import fold_periods
from weirflow.functions.documents import (
    clock_text,
    document_fields,
    from_iso_text,
    iso_text,
    row_document,
    row_fingerprint,
)
from weirflow.functions.positions import (
    format_lsn,
    format_lsn_text,
    lsn_distance,
    parse_lsn,
    parse_lsn_text,
    server_micros_to_timestamp,
)
from weirflow.model import NULLABLE, ORDERS, PAYMENTS
from weirflow.operators.changes import canonical_op, changes_between, known_tables
from weirflow.operators.compare import diff_tables, rows_wrong
from weirflow.operators.history import status_periods
from weirflow.operators.quality import (
    duplicate_keys,
    duplicate_open_periods,
    null_counts,
    require_fields,
)


# An order that moves three times and is deleted within one batch.
MOVES = [("U", "pending"), ("U", "shipped"), ("U", "delivered"), ("D", None)]


def test_moves_and_a_delete_in_one_batch_equal_a_fold(spark):
    events = [(10**9, op, datetime(2026, 1, 1, hour), status) for hour, (op, status) in enumerate(MOVES, 1)]
    rows = [(pk, op, place, 0, ts, status) for place, (pk, op, ts, status) in enumerate(events)]
    schema = "order_id bigint, op string, pos_hi bigint, pos_lo bigint, ts timestamp, status string"
    got = status_periods(spark.createDataFrame(rows, schema), ["order_id"]).drop("seeded")
    assert sorted((tuple(r) for r in got.collect()), key=str) == fold_periods(events)
    ends = got.filter("status = 'delivered'").select(clock_text("valid_from", "+00:00"), clock_text("valid_to", "+00:00"))
    assert tuple(ends.first()) == ("03:00:00", "04:00:00")


# Positions as text and number.
LSNS = {"0/0": 0, "0/14AA488": 21669000, "1/FF": 4294967551, "16/B374D848": 97500059720}


@pytest.mark.parametrize("text", LSNS)
def test_log_positions(spark, text):
    row = spark.range(1).select(
        parse_lsn(F.lit(text)).alias("n"),
        format_lsn(F.lit(LSNS[text])).alias("t"),
        lsn_distance(F.lit(text), F.lit("0/0")).alias("d"),
    ).first()
    assert (row.n, row.t, row.d) == (LSNS[text], text, LSNS[text])
    assert parse_lsn_text(text) == LSNS[text]
    assert format_lsn_text(LSNS[text]) == text


def test_position_outside_the_signed_range_is_null(spark):
    assert spark.range(1).select(parse_lsn(F.lit("FFFFFFFF/FFFFFFFF"))).first()[0] is None


def test_server_epoch(spark):
    stamp = spark.range(1).select(
        iso_text(server_micros_to_timestamp(F.lit(1_000_000))).alias("t")
    ).first().t
    assert stamp == "2000-01-01T00:00:01.000000"


def test_documents_keep_null_and_absent_apart(spark):
    df = spark.createDataFrame([(1, None, "x")], "a bigint, b string, c string")
    assert df.select(row_document(["a", "b", "c"])).first()[0] == '{"a":1,"b":null,"c":"x"}'
    text = '{"order_id":5,"status":"pending","updated_at":"2026-01-01T00:00:00+00:00","other":1}'
    row = spark.range(1).select(document_fields(F.lit(text), ORDERS).alias("r")).first().r
    assert (row.order_id, row.status, row.channel) == (5, "pending", None)
    assert row.updated_at == datetime(2026, 1, 1)


def test_fingerprint_separates_shifted_nulls_and_microseconds(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert df.select(row_fingerprint(["x", "y"])).distinct().count() == 2
    times = spark.createDataFrame(
        [(datetime(2026, 1, 1, 0, 0, 0, 1),), (datetime(2026, 1, 1, 0, 0, 0, 2),)], "t timestamp"
    )
    assert times.select(row_fingerprint(["t"])).distinct().count() == 2


def test_iso_text_round_trip(spark):
    t = datetime(2026, 5, 6, 7, 8, 9, 123456)
    df = spark.createDataFrame([(t,)], "t timestamp")
    assert df.select(from_iso_text(iso_text("t"))).first()[0] == t


def test_operation_names(spark):
    df = spark.createDataFrame([("I",), ("UPDATE",), ("D",), ("DELETE",)], "op string")
    assert [r[0] for r in df.select(canonical_op("op")).collect()] == ["U", "U", "D", "D"]


def test_undeclared_table_fails(spark):
    df = spark.createDataFrame([("other",)], "tbl string")
    with pytest.raises(Exception, match="undeclared table: other"):
        known_tables(df, ["orders"]).collect()


def test_changes_between_versions_rebuild_the_newer_one(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "k int, x string, y int")
    after = spark.createDataFrame([(1, "a", 5), (2, "b", 1), (4, "d", None)], "k int, x string, y int")
    got = {r.k: (r.op, r.x, r.y) for r in changes_between(before, after, "k", ["x", "y"]).collect()}
    assert got == {1: ("U", "a", 5), 3: ("D", None, None), 4: ("I", "d", None)}


def test_diff_counts(spark):
    src = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, x string")
    copy = spark.createDataFrame([(2, "b"), (3, "c"), (9, "z")], "k int, x string")
    report = diff_tables({"t": (src, copy, "k", ["x"]), "u": (src, src, "k", ["x"])})
    assert {tuple(r) for r in report.collect()} == {("t", 3, 1, 1, 1), ("u", 3, 0, 0, 0)}
    assert rows_wrong(report).first()[0] == 3


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (2, None)], "k int, valid_to int")
    assert [tuple(r) for r in duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert duplicate_open_periods(df, ["k"]).count() == 0
    assert {r.column_name: r.null_rows for r in null_counts(df, ["k", "valid_to"]).collect()} == {
        "k": 0, "valid_to": 2,
    }
    with pytest.raises(ValueError, match="commit_order needs commit_lsn"):
        require_fields(df, "commit_order")


def test_declared_tables():
    assert ORDERS.all_names[-1] == PAYMENTS.all_names[-1] == "updated_at"
    assert ORDERS.tracked == "status" and PAYMENTS.tracked is None
    for spec in (ORDERS, PAYMENTS):
        assert set(NULLABLE[spec.name]) < set(spec.column_names)
