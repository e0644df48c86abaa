"""Queries that SQL can express, against that SQL."""

import pytest

from checks.compare import mismatch
from weirflow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    assert mismatch(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None
