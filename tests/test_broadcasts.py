"""Joins of the item queries aren't broadcast by the size of compressed files."""

import datetime as dt
import os

import pytest

import __spark_entry__ as E
from opsmetrics.operators import windows
from opsmetrics.plans import catalog_replacements, replacements
from opsmetrics.session import tune

DAY = dt.datetime(1998, 3, 4)
TABLES = {
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
             [(k, f"red ring {k}", "b", f"type {k}", 7, 1.5) for k in range(4)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
               [(k, k % 2, "F", 5.0, DAY, "1-URGENT") for k in range(4)]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                 "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
                 [(k, k, 0, 1, 3.0, 5.0, 0.05, 0.01, "R" if k % 2 else "N", "F", DAY) for k in range(4)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(k, f"c{k}", 1, 1.0, "BUILDING") for k in range(2)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(0, "s", 1, 1.0)]),
    "documents": ("doc_id long, text string, lang string", [(k, "The seam has a tear.", "en") for k in range(4)]),
}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture()
def taken_for_12_mb(spark, root):
    """The products' files count as 12 MB, the others' in proportion: under 32 MB each."""
    at = f"{root}/part.parquet"
    held = sum(os.path.getsize(f"{at}/{f}") for f in os.listdir(at) if f.startswith("part-"))
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(12e6 / held))
    yield
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    tune(spark)


def _unstored(df, name):
    return df


@pytest.mark.parametrize("query", ["job_parent_items", "job_parent_items_hot_keys", "job_first_child", "job_first_child_hot_keys",
                                   "job_latest_survey", "job_match", "job_classify_text"])
def test_joins_wait_for_measured_sizes(spark, root, taken_for_12_mb, monkeypatch, query):
    """Each of these plans had the products broadcast for the lines and for the barcodes, whatever their rows take."""
    for module in (windows, replacements, catalog_replacements):
        monkeypatch.setattr(module, "staged", _unstored, raising=False)      # so the plan of the result holds all joins
    plan = E.queries()[query](spark, root)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") > 3 and "BroadcastExchange" not in plan


def test_the_items_of_the_whole_job_are_not_broadcast(spark, root, taken_for_12_mb, monkeypatch):
    class Seen(Exception):
        pass

    def seen(df, name):
        raise Seen(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(replacements, "staged", seen)
    with pytest.raises(Seen) as plan:
        E.queries()["pipe_replacements"](spark, root)
    assert "FileScan parquet" in str(plan.value) and "BroadcastExchange" not in str(plan.value)


def test_small_files_are_still_broadcast(spark, root, monkeypatch):
    monkeypatch.setattr(windows, "staged", _unstored)
    assert "BroadcastExchange" in E.queries()["job_parent_items"](spark, root)._jdf.queryExecution().executedPlan().toString()
    tune(spark)
