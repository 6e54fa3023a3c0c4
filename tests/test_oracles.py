"""Every query with SQL gives the rows of its SQL."""

from __future__ import annotations

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from verify import rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
CORE = sorted(n for m in entry._MODULES if not m.__name__.startswith("skeinflow.llm") for n in m.SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rel = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(got.columns) == sorted(cols)
    assert rows_of(got.columns, got.collect()) == rows_of(cols, rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_core_imports_without_llm():
    """Nothing outside the subpackage names it, but the entry that adds it if it is there."""
    root = os.path.dirname(importlib.util.find_spec("skeinflow").origin)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "skeinflow.llm" not in open(os.path.join(folder, f)).read(), f
