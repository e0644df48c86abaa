"""Set rules against a sequential fold: random logs, hot keys, partition counts, stored state."""

import random

import pytest
from pyspark.sql import functions as F

from tests.sequential import fold_periods, fold_rows
from weirflow.operators.history import status_periods
from weirflow.operators.ordered import SEG, OrderedGroups, cut_hot_groups, running_max_before
from weirflow.operators.upsert import (
    apply_changes,
    fold_nets,
    merge_net,
    net_changes,
    net_rows,
)

SCHEMA = "pk bigint, op string, pos_hi bigint, pos_lo bigint, updated_at bigint, status string"


def random_log(seed, n=400, keys=12, hot_share=0.4):
    """Key 0 holds a large share; positions have gaps and many ties in their high part."""
    rng = random.Random(seed)
    rows, high = [], 0
    for i in range(n):
        high += rng.choice([0, 0, 0, 1, 50])
        pk = 0 if rng.random() < hot_share else rng.randrange(keys)
        op = "D" if rng.random() < 0.15 else "U"
        rows.append((pk, op, high, i, rng.randrange(60), None if op == "D" else rng.choice("abc")))
    return rows


def as_events(rows):
    return [(pk, op, ts, status) for pk, op, _, _, ts, status in rows]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("hot_rows", [None, 5, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_upserts_and_deletes(spark, seed, hot_rows):
    log = random_log(seed)
    stored = {k: (30, "old") for k in range(0, 20, 2)}
    base = spark.createDataFrame(
        [(k, v, s) for k, (v, s) in stored.items()], "pk bigint, updated_at bigint, status string"
    )
    shuffled = random.Random(seed).sample(log, len(log))
    changes = spark.createDataFrame(shuffled, SCHEMA)
    result = apply_changes(base, changes, ["pk"], ["status"], hot_rows=hot_rows)
    expected = fold_rows(as_events(log), stored)
    assert {r.pk: (r.updated_at, r.status) for r in result.collect()} == expected
    net = net_changes(changes, ["pk"], ["status"], hot_rows=hot_rows)
    small = merge_net(base, net, ["pk"], ["status"], small_net=True)
    assert {r.pk: (r.updated_at, r.status) for r in small.collect()} == expected


@pytest.mark.parametrize("hot_rows", [None, 5, 40])
@pytest.mark.parametrize("seed", [4, 5])
def test_periods(spark, seed, hot_rows):
    log = random_log(seed)
    changes = spark.createDataFrame(random.Random(seed).sample(log, len(log)), SCHEMA)
    got = status_periods(changes, ["pk"], ts="updated_at", hot_rows=hot_rows)
    assert rows_of(got, "pk", "status", "valid_from", "valid_to") == fold_periods(as_events(log))


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_periods_continue_stored_ones(spark, hot_rows):
    log = random_log(9)
    opened = {k: ("b", -5) for k in range(0, 30, 3)}
    before = spark.createDataFrame(
        [(k, s, t) for k, (s, t) in opened.items()], "pk bigint, status string, valid_from bigint"
    )
    changes = spark.createDataFrame(log, SCHEMA)
    got = status_periods(
        changes, ["pk"], ts="updated_at", open_periods=before, hot_rows=hot_rows
    )
    assert rows_of(got, "pk", "status", "valid_from", "valid_to") == fold_periods(
        as_events(log), opened
    )
    assert got.filter("seeded").count() == len(opened)


@pytest.mark.parametrize("seed", [7, 8])
def test_nets_fold_like_their_changes(spark, seed):
    log = random_log(seed)
    changes = spark.createDataFrame(log, SCHEMA).withColumn(
        "batch_no", F.floor(F.col("pos_lo") / 37)
    )
    nets = net_changes(changes, ["batch_no", "pk"], ["status"])
    folded = net_rows(fold_nets(nets, ["pk"], ["status"]), ["pk"], ["updated_at", "status"])
    assert {r.pk: (r.updated_at, r.status) for r in folded.collect()} == fold_rows(as_events(log))


def test_partition_count_does_not_matter(spark):
    log = random_log(11)
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, hot_rows in (("1", None), ("7", None), ("7", 11), ("3", 60)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            changes = spark.createDataFrame(log, SCHEMA).repartition(int(partitions))
            got = status_periods(changes, ["pk"], ts="updated_at", hot_rows=hot_rows)
            seen.add(str(rows_of(got, "pk", "status", "valid_from", "valid_to")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_segments_are_ordered_and_small(spark):
    """A third of the rows on one key, half of those on one high position."""
    rows = [(0, 7 if i < 1500 else i, i) for i in range(3000)] + [(k, k, k) for k in range(6000)]
    df = spark.createDataFrame(rows, "pk bigint, pos_hi bigint, pos_lo bigint")
    cut = cut_hot_groups(df, ["pk"], ["pos_hi", "pos_lo"], 200)
    sizes = {(r.pk, tuple(r[SEG])): r["count"] for r in cut.groupBy("pk", SEG).count().collect()}
    assert all(seg == () for pk, seg in sizes if pk != 0)
    assert max(n for (pk, _), n in sizes.items() if pk == 0) <= 200
    hot = sorted(cut.filter("pk = 0").collect(), key=lambda r: (r.pos_hi, r.pos_lo))
    assert [r[SEG] for r in hot] == sorted(r[SEG] for r in hot)
    assert len(hot) == 3001


def test_looking_across_segments(spark):
    rows = [(0, i, 0, i if i % 97 == 0 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "pk bigint, pos_hi bigint, pos_lo bigint, v bigint")
    groups = OrderedGroups(df, ["pk"], ["pos_hi", "pos_lo"], hot_rows=50)
    assert groups.split
    out = groups.with_next(groups.with_previous(groups.frame, F.col("v"), "p"), F.col("v"), "n")
    for r in groups.close(out).collect():
        before = (r.pos_hi - 1) // 97 * 97 if r.pos_hi > 0 else None
        after = r.pos_hi // 97 * 97 + 97
        assert (r.p, r.n) == (before, after if after < 1000 else None)


@pytest.mark.parametrize("block", [3, 4096])
def test_running_maximum_before(spark, block, monkeypatch):
    monkeypatch.setattr("weirflow.operators.ordered.fits_one_task", lambda df: False)
    values = [5, 1, 9, 2, 9, 30, 4, 8]
    df = spark.createDataFrame([(i * 2, v) for i, v in enumerate(values)], "at bigint, v bigint")
    got = {r.at: r.prev_v for r in running_max_before(df, "at", ["v"], block).collect()}
    assert got == {i * 2: max(values[:i], default=None) for i in range(len(values))}
