"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

from collections import Counter

import pytest

import __spark_entry__ as E
from tools.check_oracle import duck, duck_rows, spark_rows, type_diffs

SF = "/root/testdata/sf0.001"
QUERIES = E.core_queries()
SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    sc, sr, st = spark_rows(QUERIES[name](spark, SF))
    dc, dr, dt = duck_rows(con, SQL[name])
    assert sc == dc
    assert type_diffs(st, dt) == {}
    assert Counter(sr) == Counter(dr)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["date", "barcode", "description", "returned_date", "d2s"]
    assert df.count() > 0
