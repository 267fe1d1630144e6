"""Checkpoint folder and table reads."""


def test_checkpoint_dir_is_set_once(spark):
    from opsmetrics.session import checkpoint_dir
    first = checkpoint_dir(spark)
    assert first and checkpoint_dir(spark) == first


def test_table_read_is_a_plain_scan(spark):
    from opsmetrics.sources.tables import read_table
    df = read_table(spark, "/root/testdata/sf0.1", "lineitem")
    plan = df.where("l_quantity > 10").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in plan and "Exchange" not in plan
