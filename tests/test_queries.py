"""Every named query beside its SQL twin on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import check

SF_DIR = Path("/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_DIR)


@pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    ok, note = check.compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_DIR)
    if name not in ORACLE:
        assert ok, note
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
