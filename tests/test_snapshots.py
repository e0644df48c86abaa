"""Replays that begin with a copy, against polls into a store that was bootstrapped with it; comparison by parts."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.spark_queries import COLUMNS, IMAGE, SNAPSHOT_POLL, SPECS, _snapshot, _source_at, _two_tables
from weirflow.operators import compare as cmp
from weirflow.plans import replay
from weirflow.sources.capture import METHODS, visible
from weirflow.streaming.store import Store
from weirflow.streaming.sync import sync_once


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    initial, before, later = _snapshot(spark, sf_dir)
    return initial, before, later, replay.starts_after(initial, before)


@pytest.fixture(scope="module")
def scores(made):
    initial, _, later, starts = made
    found = replay.score_tables(later, COLUMNS, initial=initial, starts=starts)
    return {(r.method, r.tbl): r for r in found.collect()}


def test_ghosts_of_both_tables_are_the_keys_deleted_after_the_start(made, scores):
    initial, _, later, _ = made
    last = later.groupBy("tbl", "pk").agg(F.max_by("op", F.struct("commit_lsn", "seq")).alias("op")).filter("op = 'D'")
    gone = last.join(initial, ["tbl", "pk"], "left_semi").groupBy("tbl").count().collect()
    assert len(gone) == 2 and all(r["count"] > 0 for r in gone)
    for r in gone:
        assert scores["high_watermark", r.tbl].ghost >= r["count"]
        assert scores["queue", r.tbl].rows_wrong == scores["commit_order", r.tbl].rows_wrong == 0
        assert scores["queue", r.tbl].periods == scores["commit_order", r.tbl].periods


@pytest.mark.parametrize("method", replay.METHOD_NAMES)
def test_polls_from_the_copy_on_equal_the_set_query(spark, sf_dir, folder, made, scores, method):
    initial, before, later, _ = made
    log = _two_tables(fx.derive(spark, sf_dir, fx.LOG_SQL))
    tables = {n: initial.filter(F.col("tbl") == n).drop("tbl") for n in SPECS}
    capture, store = METHODS[method](), Store(spark, folder(), list(SPECS.values()))
    start = {
        "high_watermark": lambda: capture.start(_source_at(log, SNAPSHOT_POLL)),
        "sequence": lambda: str(before.agg(F.max("seq")).first()[0]),
        "queue": lambda: "0",
        "commit_order": lambda: capture.poll(_source_at(log, SNAPSHOT_POLL), "0/0").position_text(),
    }[method]()
    store.bootstrap(tables, {method: start}, {method: before.select("seq")} if method == "queue" else None)
    for (poll,) in later.select("poll_no").distinct().orderBy("poll_no").collect():
        sync_once(store, capture, _source_at(log, poll))
    for name in SPECS:
        want = replay.latest_images(visible(log, 1 << 40), replay.KEYS, IMAGE).filter(F.col("tbl") == name)
        compared = cmp.compare_rows(want.drop("tbl"), store.table(name), ["pk"], ["pk", *IMAGE])
        counts = cmp.diff_counts(compared).first().asDict()
        r = scores[method, name].asDict()
        assert counts == {k: r[k] for k in counts}
        assert store.history(name).count() == r["periods"]


def test_a_copy_without_a_log_is_right(spark, made):
    initial, _, later, _ = made
    found = replay.score_tables(later.limit(0), COLUMNS, initial=initial).collect()
    sizes = {r.tbl: r["count"] for r in initial.groupBy("tbl").count().collect()}
    assert {(r.tbl, r.source_rows, r.rows_wrong, r.periods) for r in found} == {(t, n, 0, n) for t, n in sizes.items()}


def test_equal_tables_are_not_shuffled_by_row(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    same = cmp.diff_by_parts(orders, orders.repartition(3), ["o_orderkey"], ["o_orderstatus"]).first()
    assert tuple(same) == (orders.count(), 0, 0, 0)
    changed = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") != 1, F.col("o_orderstatus")))
    parts = cmp.differing_parts(orders, changed, ["o_orderkey"], ["o_orderstatus"], 64)
    assert parts.filter("not same").count() == 1
    assert tuple(cmp.diff_by_parts(orders, changed, ["o_orderkey"], ["o_orderstatus"]).first()) == (orders.count(), 0, 1, 0)
    nothing = orders.limit(0)
    assert tuple(cmp.diff_by_parts(nothing, nothing, ["o_orderkey"], ["o_orderstatus"]).first()) == (0, 0, 0, 0)
    assert tuple(cmp.diff_by_parts(nothing, orders, ["o_orderkey"], ["o_orderstatus"]).first()) == (0, 0, 0, orders.count())
