"""Runs of taken numbers against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from weirflow.sources import runs


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "seq long")


def plain(values):
    out = []
    for v in sorted(set(values)):
        if out and out[-1][1] == v - 1:
            out[-1] = (out[-1][0], v)
        else:
            out.append((v, v))
    return out


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_runs_of_several_polls(spark, monkeypatch, block):
    monkeypatch.setattr(runs, "BLOCK", block)
    r, taken, seen = random.Random(block), None, []
    for _ in range(3):
        some = [r.randrange(-5, 60) for _ in range(20)]  # repeated numbers too
        seen += some
        taken = runs.joined_runs(numbers(spark, some), taken)
        assert sorted(tuple(x) for x in taken.collect()) == plain(seen)
        log = numbers(spark, range(-10, 80)).withColumn("x", F.lit("a"))
        fresh = runs.outside_runs(log, taken)
        assert fresh.columns == ["seq", "x"]
        assert sorted(x["seq"] for x in fresh.collect()) == sorted(set(range(-10, 80)) - set(seen))


def test_nothing_taken_and_nothing_new(spark):
    empty = numbers(spark, [])
    assert runs.joined_runs(empty).collect() == []
    log = numbers(spark, [1, 2, 3])
    assert runs.outside_runs(log, None) is log
    assert runs.outside_runs(log, runs.joined_runs(empty)).count() == 3
    whole = runs.joined_runs(log)
    assert runs.outside_runs(log, whole).count() == 0
    assert [tuple(x) for x in runs.joined_runs(empty, whole).collect()] == [(1, 3)]


def test_the_range_below_the_lowest_gap_is_not_read(spark, folder):
    path = folder()
    numbers(spark, range(1000)).write.parquet(path)
    log = spark.read.parquet(path)
    taken = runs.joined_runs(numbers(spark, [n for n in range(900) if n != 880]))
    plan = runs.outside_runs(log, taken)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(seq,880)" in plan
    assert sorted(x["seq"] for x in runs.outside_runs(log, taken).collect()) == [880, *range(900, 1000)]
