"""Split windows (bucketed / range-partitioned) against plain windows on skewed random data."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsmetrics.operators.windows import (hot_keys, range_bucket, range_neighbours, range_row_number,
                                          split_neighbours, split_row_number)


def _data(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])          # one key holds most rows
        val = rng.choice(["x", "y", None, "z"])
        rows.append((key, i * 3 + rng.randrange(3), val))
    return spark.createDataFrame(rows, "k string, seq long, v string")


def _plain(df):
    w = Window.partitionBy("k").orderBy(F.col("seq").asc_nulls_last())
    return df.select("k", "seq", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
                     F.row_number().over(w).alias("rn"))


def _rows(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_split_neighbours_and_numbers_match_plain(spark):
    for seed in (1, 2):
        df = _data(spark, seed)
        ref = _plain(df)
        for width in (1, 7, 1000):
            b = df.withColumn("_b", F.floor(F.col("seq") / width))
            got = split_neighbours(b, ["k"], "_b", ["seq"], "v", "p", "n")
            got = split_row_number(got, ["k"], "_b", ["seq"], "rn", "total")
            assert _rows(got, ["k", "seq", "p", "n", "rn"]) == _rows(ref, ["k", "seq", "p", "n", "rn"])


def test_range_buckets_match_plain(spark):
    df = _data(spark, 3)
    ref = _plain(df)
    b = range_bucket(df, ["k"], ["seq"], partitions=16)
    assert b.select("_rb").distinct().count() > 3          # the hot key spans several ranges
    got = split_row_number(split_neighbours(b, ["k"], "_rb", ["seq"], "v", "p", "n"), ["k"], "_rb", ["seq"],
                           "rn", "total")
    assert _rows(got, ["k", "seq", "p", "n", "rn"]) == _rows(ref, ["k", "seq", "p", "n", "rn"])


def test_range_windows_match_plain_at_any_partition_count(spark):
    df = _data(spark, 4)
    ref = _plain(df)
    for n in (1, 4, 16):
        got = range_row_number(df, ["k"], ["seq"], "rn", partitions=n)
        assert dict(got.dtypes)["rn"] == "bigint"
        assert _rows(got, ["k", "seq", "rn"]) == _rows(ref, ["k", "seq", "rn"])
        near = range_neighbours(df, ["k"], ["seq"], "v", "p", "n", partitions=n)
        assert _rows(near, ["k", "seq", "p", "n"]) == _rows(ref, ["k", "seq", "p", "n"])


def test_hot_key_is_spread_over_ranges(spark):
    df = spark.range(2000).selectExpr("'hot' as k", "id as seq")
    sizes = [r["count"] for r in range_bucket(df, ["k"], ["seq"], partitions=16).groupBy("_rb").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 400


def test_null_order_values_are_kept(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), (None, 3, "z"), (None, None, "w")], "k string, seq long, v string")
    got = range_row_number(df, ["k"], ["seq"], "rn", partitions=8)
    assert _rows(got, ["v", "rn"]) == [("w", 2), ("x", 1), ("y", 2), ("z", 1)]


def test_global_row_number_matches_plain_window(spark):
    from opsmetrics.operators.windows import global_row_number
    rng = random.Random(9)
    df = spark.createDataFrame([(i, rng.randrange(20), rng.choice(["a", "b", None])) for i in range(500)],
                               "id long, score long, tag string")
    w = Window.orderBy(F.col("score").desc_nulls_first(), F.col("tag").asc_nulls_last(), F.col("id").asc_nulls_last())
    ref = df.withColumn("rn", F.row_number().over(w))
    for parts in (1, 5, 16):
        got = global_row_number(df, [("score", "desc")], "rn", tiebreak=["tag", "id"], partitions=parts)
        assert _rows(got, ["id", "rn"]) == _rows(ref, ["id", "rn"])


def test_top_n_members(spark):
    from opsmetrics.operators.windows import top_n_members
    df = spark.createDataFrame([(i, i % 7) for i in range(50)], "id long, v long")
    got = top_n_members(df, ["id"], [("v", "desc")], 4, "_top", tiebreak=["id"])
    assert sorted(r.id for r in got.where("_top").collect()) == [6, 13, 20, 27]


def test_split_windows_descending_and_text_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(40), rng.choice(["x", "y", "zz", None]), i)
            for i in range(300)]
    df = spark.createDataFrame(rows, "k string, score long, tag string, id long")
    order = [("score", "desc"), "tag", "id"]
    w = Window.partitionBy("k").orderBy(F.col("score").desc_nulls_first(), F.col("tag").asc_nulls_last(),
                                        F.col("id").asc_nulls_last())
    ref = df.select("k", "id", F.lag("tag").over(w).alias("p"), F.lead("tag").over(w).alias("n"),
                    F.row_number().over(w).alias("rn"))
    b = range_bucket(df, ["k"], order, partitions=12)
    got = split_row_number(split_neighbours(b, ["k"], "_rb", order, "tag", "p", "n"), ["k"], "_rb", order, "rn",
                           "total")
    assert _rows(got, ["k", "id", "p", "n", "rn"]) == _rows(ref, ["k", "id", "p", "n", "rn"])
    hot = range_row_number(df, ["k"], order, "rn", partitions=9)
    assert _rows(hot, ["k", "id", "rn"]) == _rows(ref, ["k", "id", "rn"])


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_keys_that_fit_a_range_take_one_exchange(spark):
    """Rows used to be exchanged by ranges, by (key, range), and again for the join with the offsets."""
    df = spark.range(4000).selectExpr("id % 1000 as k", "id as seq", "repeat('x', 20) as wide")
    assert _exchanges(range_row_number(df, ["k"], ["seq"], "rn", partitions=8)) == 1
    assert _exchanges(range_neighbours(df, ["k"], ["seq"], "wide", "p", "n", partitions=8)) == 1


def test_only_hot_keys_are_cut_into_ranges(spark):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 'hot' else 'k' || id end as k", "id as seq")
    hot = hot_keys(df, ["k"], 8)
    assert {r[0] for r in hot.collect()} == {None, "hot"}
    assert hot_keys(df.where("k like 'k%'"), ["k"], 8) is None
    w = Window.partitionBy("k").orderBy("seq")
    ref = df.select("k", "seq", F.row_number().over(w).alias("rn"), F.lag("seq").over(w).alias("p"), F.lead("seq").over(w).alias("n"))
    got = range_row_number(df, ["k"], ["seq"], "rn", partitions=8)
    assert _rows(got, ["k", "seq", "rn"]) == _rows(ref, ["k", "seq", "rn"])
    near = range_neighbours(df, ["k"], ["seq"], "seq", "p", "n", partitions=8)
    assert _rows(near, ["k", "seq", "p", "n"]) == _rows(ref, ["k", "seq", "p", "n"])


def test_latest_row_holds_each_column_once(spark):
    from opsmetrics.operators.aggregates import latest_row
    df = spark.createDataFrame([("a", 1, None, "x", {"m": 1}), ("a", 1, 2, "y", {"m": 2}), ("a", 3, 2, "z", {"m": 3}), (None, None, None, None, None)],
                               "k string, d int, e int, v string, m map<string, int>")
    plain = latest_row(df.drop("m"), ["k"], [("d", "desc"), "e"])
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and plan.count("AS v#") <= 1
    assert sorted(map(tuple, plain.collect()), key=str) == [("a", 3, 2, "z"), (None, None, None, None)]
    assert [tuple(r) for r in latest_row(df, ["k"], ["d", "e"], ["m", "v", "d"]).where("k = 'a'").collect()] == [("a", {"m": 2}, "y", 1)]
