
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
Q = E.core_queries()


def test_dwell_rows_and_days(spark):
    out = Q["pipe_dwell_time"](spark, SF)
    scans = Q["job_annotate"](spark, SF)
    assert out.count() <= scans.count()
    # a day count exists exactly when a start time exists, and is never negative
    bad = out.where(F.col("returned_date").isNull() != F.col("d2s").isNull()).count()
    assert bad == 0
    assert out.where(F.col("d2s") < 0).count() == 0


def test_top_n_shares_are_fractions(spark):
    top = Q["job_topn_share"](spark, SF)
    assert top.where((F.col("portion_of_vol") < 0) | (F.col("portion_of_vol") > 1)).count() == 0
    per_entity = top.groupBy("clinic_name", "super_clinic_id").agg(F.max("med_rank").alias("n"))
    assert per_entity.where(F.col("n") > 5).count() == 0


def test_left_joins_keep_rows_for_unique_keys(spark):
    parents = Q["job_parent_items"](spark, SF)
    matched = Q["job_match"](spark, SF)
    # one output row per item key, and every item key of the parents is kept
    assert matched.count() == matched.select("uid").distinct().count()
    assert matched.select("uid").distinct().count() == parents.select("uid").distinct().count()
    full = Q["pipe_replacements"](spark, SF)
    assert full.count() == matched.count()


def test_chain_paths_never_exceed_hops(spark):
    edges = Q["job_edge_union"](spark, SF)
    paths = Q["job_chain_paths"](spark, SF)
    assert paths.count() >= edges.count()            # one walk at least per start edge
    assert paths.where(F.col("first_id") > F.col("last_id")).count() == 0
