"""Every query that has SQL, against DuckDB over the smallest tables; the others run and keep a stable schema."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, same

NAMES = sorted(n for n, f in entry.queries().items() if "tidemill.llm" not in f.__module__)


@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, con, name):
    frame = entry.queries()[name](spark, tables)
    if name in entry.oracle_sql():
        same(con, frame, entry.oracle_sql()[name])
    else:
        assert frame.columns and frame.count() >= 0


def test_entry(spark, tables):
    assert entry.entry(spark).count() > 0


def test_oracle_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
