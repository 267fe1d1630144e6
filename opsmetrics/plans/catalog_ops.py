"""One query per relational operator / function of the inventory, on the base tables.

Each query exercises the library helper that the jobs use for that operator, over whole
tables (no sampling or id subsets). NULLs, which the test tables do not contain, are made
with ``nullif`` so the NULL rules are exercised too.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsmetrics.functions.semantics import (asc, concat_text, date_window, day_diff, desc, iff, ilike_any,
                                            month_start, parse_int, ratio)
from opsmetrics.operators import chain as C
from opsmetrics.operators.aggregates import (bitmap_counts, count_distinct_if, distinct_bitmaps, distinct_counts_by_flags,
                                             join_on_keys, latest_row, listagg, listagg_by_counts, merge_bitmaps, ordered_pairs,
                                             pivot_sum, sum_if)
from opsmetrics.operators.joins import join_counts, left_join_spread, reduced_join, spread_nulls, with_multiplicity
from opsmetrics.operators.windows import (global_row_number, qualify, range_neighbours, range_row_number, rank_window, top_n_global,
                                          top_n_members, top_n_per_key, with_partition_total, with_rank)
from opsmetrics.sources.fixtures import Inputs
from opsmetrics.sources.tables import Tables

AS_OF = "2001-06-01"
LINE_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _t(spark, root):
    return Tables(spark, root)


def _name_totals(spark, root):
    """Per part name: distinct orders and decimal revenue (a small per-product aggregate)."""
    t = _t(spark, root)
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_name").agg(
        F.count_distinct("l_orderkey").alias("n_orders"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("revenue"))


Q = {}


def q(fn):
    Q[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ scans, projections, filters
@q
def scan_table(spark, root):
    return _t(spark, root).orders


@q
def project_alias(spark, root):
    return _t(spark, root).lineitem.select(F.col("l_orderkey").alias("delivery_id"),
                                           F.col("l_partkey").alias("product_key"),
                                           F.col("l_shipdate").alias("delivered_at"))


@q
def project_star(spark, root):
    t = _t(spark, root)
    o, c = t.orders.alias("o"), t.customer.alias("c")
    return o.join(c, F.col("c.c_custkey") == F.col("o.o_custkey"), "left").select("o.*", "c.c_name")


@q
def project_const(spark, root):
    return _t(spark, root).nation.select("n_nationkey", "n_name", F.lit("member").alias("role"))


@q
def alias_reuse(spark, root):
    li = _t(spark, root).lineitem
    g = distinct_counts_by_flags(li, ["l_returnflag"], "l_orderkey", flags={"disc_fills": F.col("l_discount") > 0.05},
                                 total="fills")
    return g.withColumn("disc_rate", ratio("disc_fills", "fills", 4))


@q
def alias_in_window(spark, root):
    t = _t(spark, root)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy("c_nationkey", "c_mktsegment").agg(F.count_distinct("o_orderkey").alias("fills"))
    return with_rank(g, "ranking", ["c_nationkey"], [("fills", "desc")], tiebreak=["c_mktsegment"])


@q
def alias_partition(spark, root):
    p = _t(spark, root).part.select("p_partkey", F.lower("p_type").alias("cat"), "p_retailprice")
    r = range_row_number(p, ["cat"], [("p_retailprice", "desc"), "p_partkey"], "rk")
    return r.select("p_partkey", "cat", F.col("rk").cast("int").alias("rk"))


@q
def window_alias_expr(spark, root):
    li = _t(spark, root).lineitem.withColumn("qty", F.col("l_quantity").cast("bigint"))
    li = with_partition_total(li, "qty", ["l_orderkey"], "total_qty")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "qty", "total_qty",
                     ratio("qty", "total_qty", 2).alias("share"))


@q
def alias_where(spark, root):
    c = _t(spark, root).customer.withColumn("ta", F.col("c_mktsegment"))
    return c.where(~F.col("ta").isin("HOUSEHOLD")).select("c_custkey", "ta")


@q
def filter_compare(spark, root):
    li = _t(spark, root).lineitem
    return li.where((F.col("l_quantity") >= 10) & (F.col("l_quantity") < 40) & (F.col("l_discount") <= 0.05)
                    & (F.col("l_shipdate") > F.lit("1998-01-01").cast("timestamp_ntz"))
                    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@q
def filter_not_equal(spark, root):
    o = _t(spark, root).orders
    return o.where(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")) != "1-URGENT").select("o_orderkey", "o_orderpriority")


def _flag(c):
    return F.when(F.col("c_acctbal") > 5000, True).when(F.col("c_acctbal") > 0, False)


@q
def filter_bool_null(spark, root):
    c = _t(spark, root).customer.withColumn("flag", _flag(None))
    return c.where(~F.col("flag")).select("c_custkey", "flag")


@q
def filter_null(spark, root):
    c = _t(spark, root).customer.withColumn("seg", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return c.select("c_custkey", F.col("seg").isNull().alias("seg_missing"), F.col("seg").isNotNull().alias("seg_present"))


@q
def filter_in(spark, root):
    li = _t(spark, root).lineitem
    return li.where(F.col("l_returnflag").isin("A", "N") & F.col("l_linenumber").isin(1, 3)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@q
def filter_not_in(spark, root):
    c = _t(spark, root).customer.withColumn("seg", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return c.where(~F.col("seg").isin("HOUSEHOLD", "MACHINERY")).select("c_custkey", "seg")


@q
def filter_ilike(spark, root):
    p = _t(spark, root).part
    return p.where(F.col("p_name").ilike("%RING%") & ~F.col("p_type").ilike("%promo%")).select("p_partkey", "p_name", "p_type")


@q
def filter_ilike_any(spark, root):
    p = _t(spark, root).part
    return p.where(~ilike_any("p_name", ["%ANVIL%", "%gear%"])).select("p_partkey", "p_name")


@q
def filter_like(spark, root):
    p = _t(spark, root).part
    return p.where(F.col("p_name").like("%ring") | F.col("p_type").like("SMALL")).select("p_partkey", "p_name", "p_type")


@q
def filter_3vl(spark, root):
    c = _t(spark, root).customer
    nk = F.nullif(F.col("c_nationkey"), F.lit(0))
    return c.where(~(nk.isin(1, 2, 3) & F.col("c_mktsegment").like("BUILDING"))).select("c_custkey", "c_nationkey",
                                                                                         "c_mktsegment")


@q
def filter_date_window(spark, root):
    li = _t(spark, root).lineitem
    return li.where(date_window("l_shipdate", "1998-07-01", "1998-12-31")).select("l_orderkey", "l_linenumber",
                                                                                  "l_partkey", "l_shipdate")


@q
def filter_ts_bound(spark, root):
    li = _t(spark, root).lineitem
    return li.where((F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp_ntz"))
                    & (F.col("l_shipdate") <= F.lit("1998-12-31").cast("timestamp_ntz"))).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@q
def filter_month(spark, root):
    o = _t(spark, root).orders
    return o.where((month_start("o_orderdate") == F.lit("1999-01-01").cast("date"))
                   | (F.year("o_orderdate") > 2000)).select("o_orderkey", "o_orderdate")


@q
def filter_arith(spark, root):
    li = _t(spark, root).lineitem
    return li.where((F.col("l_quantity") - F.col("l_linenumber") * 5 - 10) > 0).select("l_orderkey", "l_linenumber",
                                                                                       "l_partkey", "l_quantity")


# ------------------------------------------------------------------ joins
@q
def join_left_dim(spark, root):
    t = _t(spark, root)
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", "p_name")


@q
def join_left_multi(spark, root):
    t = _t(spark, root)
    j = t.lineitem.join(t.orders, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_custkey") == F.col("l_suppkey")),
                        "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderstatus")


@q
def join_inner(spark, root):
    t = _t(spark, root)
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "inner").select("o_orderkey", "c_name")


@q
def join_null_reject(spark, root):
    t = _t(spark, root)
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.where(F.col("c_mktsegment") == "BUILDING").select("o_orderkey", "c_name")


@q
def join_on_right_pred(spark, root):
    t = _t(spark, root)
    c = t.customer.where(F.col("c_mktsegment") == "BUILDING")
    return t.orders.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_name")


@q
def join_on_left_pred(spark, root):
    t = _t(spark, root)
    j = t.orders.join(t.customer, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "F"), "left")
    return j.select("o_orderkey", "o_orderstatus", "c_name")


def _edges(spark, root):
    t = Inputs(spark, root)
    return C.edge_union(t["scan_live"], t["scan_archive"], "swap")


@q
def join_residual_self(spark, root):
    e = _edges(spark, root)
    s, s1 = e.alias("s"), e.alias("s1")
    j = s.join(s1, (F.col("s1.barcode") == F.col("s.hu_id_2")) & (F.col("s1.barcode") != F.col("s.barcode")), "left")
    return j.select(F.col("s.tran_log_id").alias("id0"), F.col("s1.tran_log_id").alias("id1"))


@q
def join_chain_walk(spark, root):
    return C.walk_paths(_edges(spark, root), 6)


@q
def join_computed_key(spark, root):
    t = _t(spark, root)
    key = F.coalesce(F.substring("c_name", 10, 9).try_cast("bigint"), F.col("c_custkey"))
    return t.customer.join(t.orders, key == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@q
def join_cast_key(spark, root):
    t = _t(spark, root)
    c = t.customer.select(F.col("c_custkey").cast("string").alias("ckey"), "c_name")
    return t.orders.join(c, F.col("o_custkey").cast("string") == F.col("ckey"), "left").select("o_orderkey", "c_name")


@q
def join_preagg(spark, root):
    t = _t(spark, root)
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return t.customer.join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "n_orders")


@q
def join_fanout_distinct(spark, root):
    """Rows and distinct segments per region through two fan-outs, each side reduced before it is joined."""
    t = _t(spark, root)
    customers = with_multiplicity(t.customer.select("c_nationkey", "c_mktsegment"))
    nations = with_multiplicity(t.nation.select("n_nationkey", "n_regionkey"))
    below = with_multiplicity(reduced_join(nations, customers, [("n_nationkey", "c_nationkey")])
                              .select("n_regionkey", "c_mktsegment", "_m"))
    j = reduced_join(with_multiplicity(t.region.select("r_regionkey", "r_name")), below, [("r_regionkey", "n_regionkey")])
    return j.groupBy("r_name").agg(F.count_distinct("c_mktsegment").alias("segments"), F.sum("_m").alias("rows"))


@q
def join_eager_counts(spark, root):
    """Lines, distinct customers and distinct parts per priority: ``join_counts`` over orders and their lines."""
    t = _t(spark, root)
    return join_counts(t.orders, t.lineitem, [("o_orderkey", "l_orderkey")], ["o_orderpriority"], ["o_custkey", "l_suppkey"], rows="lines")


@q
def join_null_key_spread(spark, root):
    """Customers without a usable nation key keep their rows; they are spread instead of meeting in one task."""
    t = _t(spark, root)
    c = t.customer.select("c_custkey", F.when(F.col("c_nationkey") >= 8, F.col("c_nationkey")).alias("nk"))
    j = left_join_spread(spread_nulls(c, ["nk"]), t.nation.select("n_nationkey", "n_name"), [("nk", "n_nationkey")])
    return j.select("c_custkey", "nk", "n_name")


@q
def join_range_where(spark, root):
    t = _t(spark, root)
    first = t.orders.groupBy(F.col("o_custkey").alias("f_custkey")).agg(F.min("o_orderdate").alias("first_order"))
    j = t.orders.join(first, F.col("f_custkey") == F.col("o_custkey"), "left")
    return j.where(F.col("first_order").cast("date") < month_start("o_orderdate")).select("o_orderkey")


@q
def join_null_key(spark, root):
    t = _t(spark, root)
    c = t.customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(0)).alias("nk"))
    return c.join(t.nation, F.col("nk") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


# ------------------------------------------------------------------ aggregation
@q
def agg_group(spark, root):
    li = _t(spark, root).lineitem
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))


@q
def agg_group_expr(spark, root):
    p = _t(spark, root).part
    return p.groupBy(F.lower("p_type").alias("kind"), (F.col("p_size") > 25).alias("big")).agg(F.count("*").alias("n"))


@q
def agg_dedup(spark, root):
    return _t(spark, root).lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@q
def agg_sum(spark, root):
    li = _t(spark, root).lineitem
    return li.groupBy("l_returnflag").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("revenue"))


@q
def agg_avg(spark, root):
    li = _t(spark, root).lineitem
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg(F.col("l_extendedprice").cast("decimal(18,2)")), 3).cast("decimal(38,3)").alias("avg_price"))


@q
def agg_max(spark, root):
    c = _t(spark, root).customer
    label = F.when(F.col("c_acctbal") > 9000, "gold").when(F.col("c_acctbal") > 5000, "bronze")
    return c.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("max_bal"),
                                        F.max(F.col("c_acctbal") > 9900).alias("any_rich"),
                                        F.max(label).alias("best_label"))


@q
def agg_count_distinct(spark, root):
    """Two distinct counts of different columns: two single-distinct aggregates, re-joined."""
    o = _t(spark, root).orders
    a = o.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))
    b = o.groupBy("o_orderstatus").agg(F.count_distinct("o_orderpriority").alias("priorities"))
    return join_on_keys(a, b, ["o_orderstatus"])


@q
def agg_cond_distinct(spark, root):
    o = _t(spark, root).orders
    return o.groupBy("o_orderstatus").agg(
        count_distinct_if(F.col("o_orderpriority") == "1-URGENT", "o_custkey").alias("urgent_customers"))


@q
def agg_cond_sum(spark, root):
    li = _t(spark, root).lineitem
    return li.groupBy("l_linestatus").agg(
        sum_if(F.col("l_returnflag") == "R", F.col("l_quantity").cast("bigint"), F.lit(0).cast("bigint"))
        .alias("returned_qty"))


@q
def agg_ratio(spark, root):
    t = _t(spark, root)
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    g = distinct_counts_by_flags(j, ["n_regionkey"], "c_custkey", flags={"neg": F.col("c_acctbal") < 0},
                                 total="total")
    return g.withColumn("neg_share", ratio("neg", "total", 4))


@q
def agg_rollup_two_step(spark, root):
    t = _t(spark, root)
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    g = j.groupBy("c_nationkey", "o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))
    return g.groupBy("c_nationkey").agg(F.sum("customers").alias("customer_sum"))


@q
def agg_rollup_bitmap(spark, root):
    """Both totals of a nation from one row per (nation, priority, bucket): the sum of its distinct counts, in which a customer
    counts once per priority, and the distinct customers, from the bitmaps rolled up."""
    t = _t(spark, root)
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("c_nationkey", "o_orderpriority", "o_custkey")
    fine = distinct_bitmaps(j, ["c_nationkey", "o_orderpriority"], "o_custkey")
    sums = (bitmap_counts(fine, ["c_nationkey", "o_orderpriority"], "n").groupBy("c_nationkey")
            .agg(F.sum("n").alias("customer_sum")))
    exact = bitmap_counts(merge_bitmaps(fine, ["c_nationkey"]), ["c_nationkey"], "customers")
    return join_on_keys(sums, exact, ["c_nationkey"])


@q
def agg_having(spark, root):
    c = _t(spark, root).customer
    g = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return g.where((F.col("n") > 12) & ~F.col("c_mktsegment").isin("HOUSEHOLD"))


@q
def agg_listagg_ordered(spark, root):
    c = _t(spark, root).customer
    return c.groupBy("c_nationkey").agg(listagg("c_mktsegment", ", ", distinct=True).alias("segments"))


@q
def agg_listagg_distinct(spark, root):
    n = _t(spark, root).nation
    return n.groupBy("n_regionkey").agg(listagg("n_name", "", distinct=True).alias("names"))


@q
def agg_listagg(spark, root):
    return listagg_by_counts(_t(spark, root).lineitem, ["l_orderkey"], "l_returnflag", ",", "flags")


@q
def agg_array(spark, root):
    li = _t(spark, root).lineitem
    ranked = with_rank(li, "rk", ["l_orderkey"], [("l_quantity", "desc")], tiebreak=LINE_TIE[1:])
    top = ranked.where(F.col("rk") <= 3)
    g = top.groupBy("l_orderkey").agg(ordered_pairs("rk", "l_partkey", "l_quantity").alias("pairs"))
    out = [F.col("l_orderkey")]
    for i in range(3):
        out += [F.get("pairs", i)["l_partkey"].alias(f"part_{i + 1}"), F.get("pairs", i)["l_quantity"].alias(f"qty_{i + 1}")]
    return g.select(*out)


def _status_month(spark, root):
    o = _t(spark, root).orders.where(date_window("o_orderdate", "1998-11-01", "1999-01-31"))
    return o.groupBy("o_orderstatus", F.month("o_orderdate").alias("m")).agg(F.count_distinct("o_custkey").alias("n"))


@q
def agg_pivot(spark, root):
    return pivot_sum(_status_month(spark, root), ["o_orderstatus"], "m", [11, 12, 1], "n", ["nov", "dec", "jan"])


@q
def agg_pivot_sum(spark, root):
    p = agg_pivot(spark, root)
    return p.groupBy("o_orderstatus").agg(*[F.sum(c).alias(f"{c}_total") for c in ("nov", "dec", "jan")])


# ------------------------------------------------------------------ windows
@q
def win_row_number(spark, root):
    o = _t(spark, root).orders.select("o_orderkey", "o_custkey", "o_orderdate")
    r = range_row_number(o, ["o_custkey"], [("o_orderdate", "desc"), "o_orderkey"], "rn")
    return r.select("o_orderkey", "o_custkey", F.col("rn").cast("int").alias("rn"))


@q
def win_global_rank(spark, root):
    g = _name_totals(spark, root)
    return global_row_number(g, [("revenue", "desc")], "rk", tiebreak=["p_name"])


@q
def win_concat_key(spark, root):
    li = _t(spark, root).lineitem
    r = with_rank(li, "rn", ["l_orderkey", "l_returnflag"], ["l_linenumber"], tiebreak=LINE_TIE[2:])
    return r.select(concat_text("l_orderkey", "l_returnflag").alias("uid"), "l_linenumber", "l_partkey", "rn")


@q
def win_case_bucket(spark, root):
    """Rank buckets: the best 10 are High, then the worst 10 are Low, the rest Mid."""
    g = _name_totals(spark, root)
    g = top_n_members(g, ["p_name"], [("revenue", "desc")], 10, "_best", tiebreak=["p_name"])
    g = top_n_members(g, ["p_name"], ["revenue"], 10, "_worst", tiebreak=["p_name"])
    return g.select("p_name", F.when(F.col("_best"), "High").when(F.col("_worst"), "Low").otherwise("Mid")
                    .alias("bucket"))


def _events(spark, root):
    return _t(spark, root).events


@q
def win_lag_lead_default(spark, root):
    e = _events(spark, root).select("user_id", "event_id", F.struct("event_type").alias("e"))
    e = range_neighbours(e, ["user_id"], ["event_id"], "e", "p", "n")
    # the default stands for a missing row, not for a NULL value
    return e.select("event_id", F.when(F.col("p").isNull(), "0").otherwise(F.col("p.event_type")).alias("prev_type"),
                    F.when(F.col("n").isNull(), "0").otherwise(F.col("n.event_type")).alias("next_type"))


@q
def win_lag_lead(spark, root):
    e = _events(spark, root).select("user_id", "event_id", F.struct("value", "ts").alias("e"))
    e = range_neighbours(e, ["user_id"], ["event_id"], "e", "p", "n")
    return e.select("event_id", F.col("p.value").alias("prev_value"), F.col("n.ts").alias("next_ts"))


@q
def win_case_lag(spark, root):
    e = _events(spark, root).select("user_id", "event_id", "event_type", "ts")
    e = range_neighbours(e, ["user_id"], ["ts", "event_id"], "ts", "p")
    return e.select("event_id", F.when(F.col("event_type").isin("click", "purchase"), F.col("p")).alias("started_at"))


@q
def win_share(spark, root):
    return window_alias_expr(spark, root).select("l_orderkey", "l_linenumber", "l_partkey", "share")


@q
def win_over_agg(spark, root):
    li = _t(spark, root).lineitem
    g = li.groupBy("l_suppkey", "l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"))
    return with_rank(g, "rk", ["l_suppkey"], [("orders", "desc")], tiebreak=["l_returnflag"])


@q
def qualify_first(spark, root):
    o = _t(spark, root).orders
    return latest_row(o, ["o_custkey"], [("o_orderdate", "desc"), "o_orderkey"], ["o_orderkey", "o_orderdate"])


@q
def qualify_topn(spark, root):
    o = _t(spark, root).orders
    return top_n_per_key(o, ["o_custkey"], [("o_totalprice", "desc")], 3, tiebreak=["o_orderkey"]).select(
        "o_custkey", "o_orderkey", "rank")


@q
def qualify_kth(spark, root):
    o = _t(spark, root).orders
    return qualify(o, ["o_custkey"], [("o_orderdate", "desc")], 3, tiebreak=["o_orderkey"]).select(
        "o_custkey", "o_orderkey")


@q
def qualify_or(spark, root):
    """Keep the best 5, the worst 5, and the 5 lowest of category 'low' (an OR of three ranks)."""
    g = _name_totals(spark, root).withColumn("cat", iff(F.col("n_orders") > 700, F.lit("low"), F.lit("other")))
    g = top_n_members(g, ["p_name"], [("revenue", "desc")], 5, "_best", tiebreak=["p_name"])
    g = top_n_members(g, ["p_name"], ["revenue"], 5, "_worst", tiebreak=["p_name"])
    low = g.where(F.col("cat") == "low").select("p_name", "revenue")
    low_top = top_n_members(low, ["p_name"], ["revenue"], 5, "_low", tiebreak=["p_name"]).where("_low")
    g = g.join(low_top.select(F.col("p_name").alias("_l_name"), "_low"), F.col("p_name") == F.col("_l_name"), "left")
    return g.where(F.col("_best") | F.col("_worst") | F.coalesce(F.col("_low"), F.lit(False))).select("p_name", "cat")


@q
def qualify_after_lead(spark, root):
    o = _t(spark, root).orders.select("o_custkey", "o_orderkey", "o_orderdate")
    o = range_neighbours(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "_previous", "next_order")
    return latest_row(o, ["o_custkey"], ["o_orderkey"], ["o_orderkey", "next_order"])


# ------------------------------------------------------------------ sort, limit, set operations
@q
def sort_final(spark, root):
    o = _t(spark, root).orders
    g = o.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))
    return g.orderBy(desc("total"), asc("o_custkey"))


@q
def topk_global(spark, root):
    li = _t(spark, root).lineitem
    return top_n_global(li, [("l_extendedprice", "desc")], 20, tiebreak=LINE_TIE).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@q
def union_all(spark, root):
    t = Inputs(spark, root)
    cols = ["hu_id", "hu_id_2", "end_tran_date", "tran_log_id"]
    return (t["scan_live"].where(F.col("tran_type") == "swap").select(*cols)
            .unionByName(t["scan_archive"].where(F.col("tran_type") == "swap").select(*cols)))


# ------------------------------------------------------------------ scalar functions
@q
def fn_lower(spark, root):
    return _t(spark, root).customer.select("c_custkey", F.lower("c_name").alias("name"))


@q
def fn_trim(spark, root):
    c = _t(spark, root).customer
    return c.select("c_custkey", F.trim(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))).alias("seg"))


@q
def fn_right(spark, root):
    li = _t(spark, root).lineitem
    last = F.right(F.col("l_linenumber").cast("string"), F.lit(1))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", last.alias("last_digit"),
                     last.isin("1", "3", "5", "7", "9").alias("odd"))


@q
def fn_concat(spark, root):
    c = _t(spark, root).customer
    return c.select("c_custkey", concat_text("c_nationkey", F.lit("-"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
                    .alias("label"))


@q
def fn_coalesce(spark, root):
    li = _t(spark, root).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     F.coalesce(F.nullif(F.col("l_tax"), F.lit(0.0)), F.col("l_discount"), F.lit(0.0)).alias("rate"))


@q
def fn_iff(spark, root):
    li = _t(spark, root).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     iff(F.nullif(F.col("l_returnflag"), F.lit("A")) == "R", F.lit("returned"), F.lit("other")).alias("kind"))


@q
def fn_case(spark, root):
    o = _t(spark, root).orders
    k = (F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_totalprice") > 100000, "medium")
         .when(F.col("o_orderstatus") == "P", "pending"))
    return o.select("o_orderkey", k.alias("size_class"))


@q
def fn_case_nested(spark, root):
    o = _t(spark, root).orders
    inner = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise(
        F.col("o_orderpriority"))
    return o.select("o_orderkey", iff(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), inner,
                                      F.col("o_orderpriority")).alias("label"))


@q
def fn_least_greatest(spark, root):
    """First and last of seven ids that may be missing: sentinels stand for these, and NULLs would be passed over."""
    li = _t(spark, root).lineitem
    found = [F.when(F.col("l_linenumber") > k, F.col("l_orderkey") + k * (F.col("l_partkey") - F.col("l_suppkey"))) for k in range(7)]
    low = F.least(*[F.coalesce(c, F.lit(99999999)) for c in found])
    high = F.greatest(*[F.coalesce(c, F.lit(0)) for c in found])
    bare = [F.col("l_partkey"), F.nullif(F.col("l_suppkey"), F.lit(0)), F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))]
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.least(*bare).alias("lo"), F.greatest(*bare).alias("hi"),
                     low.alias("first_id"), high.alias("last_id"))


@q
def fn_arith(spark, root):
    li = _t(spark, root).lineitem
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    net = price * (1 - F.col("l_discount").cast("decimal(4,2)")) * (1 + F.col("l_tax").cast("decimal(4,2)"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", net.cast("decimal(38,6)").alias("net"),
                     ((F.col("l_quantity").cast("bigint") - F.col("l_linenumber")) * -1).alias("neg_gap"))


@q
def fn_round(spark, root):
    li = _t(spark, root).lineitem
    v = F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     *[F.round(v, d).cast(f"decimal(38,{d})").alias(f"r{d}") for d in (1, 2, 3)])


@q
def fn_cast(spark, root):
    li = _t(spark, root).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("ship_day"),
                     F.col("l_quantity").cast("int").alias("qty"), F.col("l_orderkey").cast("string").alias("okey"))


@q
def fn_try_cast(spark, root):
    c = _t(spark, root).customer
    return c.select("c_custkey", parse_int(F.substring("c_name", 10, 9)).alias("from_name"),
                    parse_int(F.concat(F.col("c_nationkey").cast("string"), F.lit("R"))).alias("bad"),
                    parse_int(F.lit("")).alias("empty"))


@q
def fn_text_num(spark, root):
    """Text compared with a number: the missing neighbour's label '0'."""
    return win_lag_lead_default(spark, root).select("event_id", (F.col("prev_type") == "0").alias("first_of_user"))


@q
def fn_text_date(spark, root):
    o = _t(spark, root).orders
    return o.where(F.col("o_orderdate") >= F.lit("2000-06-15").cast("timestamp_ntz")).select("o_orderkey")


@q
def fn_sentinel_date(spark, root):
    o = _t(spark, root).orders
    d = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", F.coalesce(d, F.to_date(F.lit("01/01/2999"), "MM/dd/yyyy")).alias("closed_on"))


@q
def fn_date_trunc(spark, root):
    o = _t(spark, root).orders
    return o.select("o_orderkey", month_start("o_orderdate").alias("month"),
                    (month_start("o_orderdate") == month_start(F.lit("1999-01-15"))).alias("is_jan99"))


@q
def fn_month_year(spark, root):
    o = _t(spark, root).orders
    return o.select("o_orderkey", F.month("o_orderdate").alias("m"), F.year("o_orderdate").alias("y"))


@q
def fn_datediff(spark, root):
    t = _t(spark, root)
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", day_diff("o_orderdate", "l_shipdate").alias("days"))


@q
def fn_as_of(spark, root):
    o = _t(spark, root).orders
    return o.select("o_orderkey", day_diff("o_orderdate", F.lit(AS_OF).cast("date")).alias("age"))


@q
def fn_array_get(spark, root):
    """``get(array, i)`` (0-based, NULL past the end) on the whole array of an order's lines."""
    li = _t(spark, root).lineitem
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber"))).alias("lines"))
    return g.select("l_orderkey", F.get("lines", 0)["l_linenumber"].alias("first_line"),
                    F.get("lines", 9)["l_linenumber"].alias("tenth_line"))


@q
def fn_json_get(spark, root):
    e = _events(spark, root)
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"),
                    F.get_json_object("props", "$.seat").alias("seat"))


QUERIES = dict(Q)
