from __future__ import annotations

import pytest

from skeinflow.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables (rows and a DDL schema) as a data directory and gives its path."""

    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def values(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
