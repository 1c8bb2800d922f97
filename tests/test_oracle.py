"""Every registered query against DuckDB on the given tables."""

import compare
import pytest

import __spark_entry__ as entry
import workload

QUERIES, ORACLE = workload.all_queries(), workload.all_oracles()


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    if name not in ORACLE:
        assert QUERIES[name](spark, sf).count() >= 0
        return
    rows, diff = compare.check(spark, con, name, QUERIES[name], ORACLE[name], sf)
    assert not diff
    # the smallest tables hold no repeated form
    assert rows > 0 or name == "unique_violations"


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
