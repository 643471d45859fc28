from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame from a schema and rows, over several partitions."""

    def make(schema: str, rows: list[tuple], parts: int = 3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
