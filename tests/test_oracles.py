"""Every registered query against its SQL counterpart on the small tables."""

import pytest

import __spark_entry__ as contract
from checks.compare import SPLIT, mismatch
from checks.duckdb_sql import ORACLES
from checks.spark_queries import QUERIES


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    assert mismatch(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


def test_entry_runs(spark):
    assert contract.entry(spark).columns == ["pk", "status", "valid_from", "valid_to"]


# Queries with another way for key groups too big for one task.
SPLITTING = [
    "apply_batch",
    "capture_miss_audit",
    "messages_to_replica",
    "replay_four_policies",
    "replay_from_snapshot",
    "scd2_history_busy_keys",
    "truth_after_snapshot",
    "truth_counts",
]


@pytest.mark.parametrize("name", SPLITTING)
def test_query_matches_sql_when_every_group_is_split(spark, duck, sf_dir, name):
    try:
        for key, value in SPLIT.items():
            spark.conf.set(key, value)
        assert mismatch(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None
    finally:
        for key in SPLIT:
            spark.conf.unset(key)
