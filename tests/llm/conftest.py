import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def rows(spark):
    """Makes a table from rows and a schema, over two partitions."""
    return lambda data, schema: spark.createDataFrame(data, schema).repartition(2)
