"""Exact ranks by narrowing, against sorting; the running lag and the stateful history are in the queries."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from weirflow.operators.ranks import values_at_ranks
from weirflow.plans.audit import poll_statistics


def ranks():
    last = F.col("n") - 1
    return {"first": F.lit(0), "p95": F.floor(last * 0.95), "last": last}


@pytest.mark.parametrize("cells", [2, 3, 1024])
@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_ranks_equal_sorting(spark, cells, kind):
    r = random.Random(cells)
    groups = {
        "same": [7] * 40, "few": [1, 2], "one": [-5], "wide": [r.choice([-1, 1]) * r.randrange(1 << 50) for _ in range(60)],
        "ties": [r.randrange(4) for _ in range(100)], "outlier": [*range(50), 1 << 60],
    }
    rows = [(g, float(v) if kind == "double" else v) for g, vs in groups.items() for v in [*vs, None] if kind == "bigint" or v is not None]
    df = spark.createDataFrame(rows, f"g string, v {kind}")
    got = {x["g"]: x for x in values_at_ranks(df, "v", ranks(), ["g"], cells).collect()}
    for g, vs in groups.items():
        want = sorted(vs)
        assert (got[g]["n"], got[g]["first"], got[g]["last"]) == (len(want), want[0], want[-1])
        assert got[g]["p95"] == want[math.floor(0.95 * (len(want) - 1))]


def test_no_window_without_keys_and_no_rows(spark):
    df = spark.createDataFrame([(n, n % 7) for n in range(30)], "poll_no bigint, n_changes bigint")
    row = poll_statistics(df).first()
    values = sorted(n % 7 for n in range(30))
    assert tuple(row) == (30, statistics.median(values), values[27], sum(values))
    assert poll_statistics(df.limit(0)).collect() == []
    assert "Window" not in poll_statistics(df)._jdf.queryExecution().toString()
