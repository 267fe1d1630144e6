"""Every fixture view gives the same rows in Spark and in DuckDB (the views are portable SQL)."""

from collections import Counter

import pytest

from opsmetrics.sources.fixtures import VIEWS, Inputs, with_query
from tools.check_oracle import duck, duck_rows, spark_rows, type_diffs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_view_same_in_both_engines(spark, con, name):
    sc, sr, st = spark_rows(Inputs(spark, SF)[name])
    dc, dr, dt = duck_rows(con, with_query([name], [], f"select * from {name}"))
    assert sc == dc
    assert type_diffs(st, dt) == {}
    assert Counter(sr) == Counter(dr)
