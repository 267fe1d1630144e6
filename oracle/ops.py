"""Oracle SQL for the per-operator queries (``opsmetrics.plans.catalog_ops``)."""

from __future__ import annotations

from oracle.replacements import CTES as R_CTES
from oracle.sqlfn import avg_round, ratio
from opsmetrics.sources.fixtures import with_query


#: Tie order of order lines: every column.
LINE_TIE = """l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag
    l_linestatus l_shipdate""".split()


def _asc(cols):
    return ", ".join(f"{c} asc nulls last" for c in cols)


_CHAIN = [c for c in R_CTES if c[0] in ("r_clean", "r_paths")]
_SCANS = ["scan_live", "scan_archive"]

NAME_TOTALS = """
    select p_name, count(distinct l_orderkey) as n_orders,
           cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(38,2)) as revenue
    from lineitem join part on l_partkey = p_partkey group by p_name"""

STATUS_MONTH = """
    select o_orderstatus, cast(month(o_orderdate) as integer) as m, count(distinct o_custkey) as n
    from orders where cast(o_orderdate as date) between date '1998-11-01' and date '1999-01-31'
    group by o_orderstatus, month(o_orderdate)"""

PIVOT = f"""
    select o_orderstatus, cast(sum(case when m = 11 then n end) as bigint) as nov,
           cast(sum(case when m = 12 then n end) as bigint) as dec,
           cast(sum(case when m = 1 then n end) as bigint) as jan
    from ({STATUS_MONTH}) s group by o_orderstatus"""

FLAG = "case when c_acctbal > 5000 then true when c_acctbal > 0 then false end"

SQL = {
    "scan_table": "select * from orders",
    "project_alias": "select l_orderkey as delivery_id, l_partkey as product_key, l_shipdate as delivered_at from lineitem",
    "project_star": "select o.*, c.c_name from orders o left join customer c on c.c_custkey = o.o_custkey",
    "project_const": "select n_nationkey, n_name, 'member' as role from nation",
    "alias_reuse": f"""
        select *, {ratio('disc_fills', 'fills', 4)} as disc_rate from (
            select l_returnflag, count(distinct l_orderkey) as fills,
                   count(distinct case when l_discount > 0.05 then l_orderkey end) as disc_fills
            from lineitem group by l_returnflag) t""",
    "alias_in_window": """
        select c_nationkey, c_mktsegment, count(distinct o_orderkey) as fills,
               cast(row_number() over (partition by c_nationkey order by count(distinct o_orderkey) desc nulls first,
                                       c_mktsegment asc nulls last) as integer) as ranking
        from orders join customer on o_custkey = c_custkey group by c_nationkey, c_mktsegment""",
    "alias_partition": """
        select p_partkey, lower(p_type) as cat,
               cast(row_number() over (partition by lower(p_type) order by p_retailprice desc nulls first,
                                       p_partkey asc nulls last) as integer) as rk
        from part""",
    "window_alias_expr": f"""
        select l_orderkey, l_linenumber, l_partkey, qty, total_qty, {ratio('qty', 'total_qty', 2)} as share from (
            select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as bigint) as qty,
                   cast(sum(cast(l_quantity as bigint)) over (partition by l_orderkey) as bigint) as total_qty
            from lineitem) t""",
    "alias_where": "select c_custkey, c_mktsegment as ta from customer where c_mktsegment not in ('HOUSEHOLD')",
    "filter_compare": """
        select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
        where l_quantity >= 10 and l_quantity < 40 and l_discount <= 0.05 and l_shipdate > timestamp '1998-01-01'""",
    "filter_not_equal": """
        select o_orderkey, o_orderpriority from orders where nullif(o_orderpriority, '5-LOW') <> '1-URGENT'""",
    "filter_bool_null": f"select c_custkey, {FLAG} as flag from customer where not ({FLAG})",
    "filter_null": """
        select c_custkey, nullif(c_mktsegment, 'BUILDING') is null as seg_missing,
               nullif(c_mktsegment, 'BUILDING') is not null as seg_present
        from customer""",
    "filter_in": """
        select l_orderkey, l_linenumber, l_partkey, l_returnflag from lineitem
        where l_returnflag in ('A', 'N') and l_linenumber in (1, 3)""",
    "filter_not_in": """
        select c_custkey, nullif(c_mktsegment, 'BUILDING') as seg from customer
        where nullif(c_mktsegment, 'BUILDING') not in ('HOUSEHOLD', 'MACHINERY')""",
    "filter_ilike": "select p_partkey, p_name, p_type from part where p_name ilike '%RING%' and p_type not ilike '%promo%'",
    "filter_ilike_any": "select p_partkey, p_name from part where not (p_name ilike '%ANVIL%' or p_name ilike '%gear%')",
    "filter_like": "select p_partkey, p_name, p_type from part where p_name like '%ring' or p_type like 'SMALL'",
    "filter_3vl": """
        select c_custkey, c_nationkey, c_mktsegment from customer
        where not (nullif(c_nationkey, 0) in (1, 2, 3) and c_mktsegment like 'BUILDING')""",
    "filter_date_window": """
        select l_orderkey, l_linenumber, l_partkey, l_shipdate from lineitem
        where cast(l_shipdate as date) >= date '1998-07-01' and cast(l_shipdate as date) <= date '1998-12-31'""",
    "filter_ts_bound": """
        select l_orderkey, l_linenumber, l_partkey, l_shipdate from lineitem
        where l_shipdate >= timestamp '1998-07-01' and l_shipdate <= timestamp '1998-12-31'""",
    "filter_month": """
        select o_orderkey, o_orderdate from orders
        where cast(date_trunc('month', o_orderdate) as date) = date '1999-01-01' or year(o_orderdate) > 2000""",
    "filter_arith": """
        select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
        where (l_quantity - l_linenumber * 5 - 10) > 0""",
    "join_left_dim": "select l_orderkey, l_linenumber, l_partkey, p_name from lineitem left join part on l_partkey = p_partkey",
    "join_left_multi": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus from lineitem
        left join orders on o_orderkey = l_orderkey and o_custkey = l_suppkey""",
    "join_inner": "select o_orderkey, c_name from orders inner join customer on c_custkey = o_custkey",
    "join_null_reject": """
        select o_orderkey, c_name from orders left join customer on c_custkey = o_custkey
        where c_mktsegment = 'BUILDING'""",
    "join_on_right_pred": """
        select o_orderkey, c_name from orders left join customer on c_custkey = o_custkey and c_mktsegment = 'BUILDING'""",
    "join_on_left_pred": """
        select o_orderkey, o_orderstatus, c_name from orders
        left join customer on c_custkey = o_custkey and o_orderstatus = 'F'""",
    "join_residual_self": with_query(_SCANS, _CHAIN[:1], """
        select s.tran_log_id as id0, s1.tran_log_id as id1 from r_clean s
        left join r_clean s1 on s1.barcode = s.hu_id_2 and s1.barcode != s.barcode"""),
    "join_chain_walk": with_query(_SCANS, _CHAIN, "select * from r_paths"),
    "join_computed_key": """
        select c_custkey, o_orderkey from customer
        left join orders on coalesce(try_cast(substr(c_name, 10, 9) as bigint), c_custkey) = o_custkey""",
    "join_cast_key": """
        select o_orderkey, c.c_name from orders
        left join (select cast(c_custkey as varchar) as ckey, c_name from customer) c
               on cast(o_custkey as varchar) = c.ckey""",
    "join_preagg": """
        select c_custkey, n.n_orders from customer
        left join (select o_custkey, count(*) as n_orders from orders group by o_custkey) n on n.o_custkey = c_custkey""",
    "join_fanout_distinct": """
        select r_name, count(distinct c_mktsegment) as segments, count(*) as rows from region
        left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey
        group by r_name""",
    "join_eager_counts": """
        select o_orderpriority, count(distinct o_custkey) as o_custkey, count(distinct l_suppkey) as l_suppkey,
               count(*) as lines
        from orders left join lineitem on l_orderkey = o_orderkey group by o_orderpriority""",
    "join_null_key_spread": """
        select c_custkey, case when c_nationkey >= 8 then c_nationkey end as nk, n_name
        from customer left join nation on n_nationkey = c_nationkey and c_nationkey >= 8""",
    "join_range_where": """
        select o.o_orderkey from orders o
        left join (select o_custkey, min(o_orderdate) as first_order from orders group by o_custkey) f
               on f.o_custkey = o.o_custkey
        where cast(f.first_order as date) < cast(date_trunc('month', o.o_orderdate) as date)""",
    "join_null_key": """
        select c.c_custkey, n.n_name from (select c_custkey, nullif(c_nationkey, 0) as nk from customer) c
        left join nation n on c.nk = n.n_nationkey""",
    "agg_group": """
        select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as qty
        from lineitem group by l_returnflag, l_linestatus""",
    "agg_group_expr": "select lower(p_type) as kind, p_size > 25 as big, count(*) as n from part group by 1, 2",
    "agg_dedup": "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem",
    "agg_sum": """
        select l_returnflag, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(38,2)) as revenue
        from lineitem group by l_returnflag""",
    "agg_avg": f"""
        select l_returnflag, l_linestatus, {avg_round('cast(l_extendedprice as decimal(18,2))', 2, 3)} as avg_price
        from lineitem group by l_returnflag, l_linestatus""",
    "agg_max": """
        select c_nationkey, max(c_acctbal) as max_bal, max(c_acctbal > 9900) as any_rich,
               max(case when c_acctbal > 9000 then 'gold' when c_acctbal > 5000 then 'bronze' end) as best_label
        from customer group by c_nationkey""",
    "agg_count_distinct": """
        select o_orderstatus, count(distinct o_custkey) as customers, count(distinct o_orderpriority) as priorities
        from orders group by o_orderstatus""",
    "agg_cond_distinct": """
        select o_orderstatus, count(distinct case when o_orderpriority = '1-URGENT' then o_custkey end) as urgent_customers
        from orders group by o_orderstatus""",
    "agg_cond_sum": """
        select l_linestatus, cast(sum(case when l_returnflag = 'R' then cast(l_quantity as bigint) else 0 end) as bigint)
               as returned_qty
        from lineitem group by l_linestatus""",
    "agg_ratio": f"""
        select *, {ratio('neg', 'total', 4)} as neg_share from (
            select n_regionkey, count(distinct case when c_acctbal < 0 then c_custkey end) as neg,
                   count(distinct c_custkey) as total
            from customer join nation on n_nationkey = c_nationkey group by n_regionkey) t""",
    "agg_rollup_two_step": """
        select c_nationkey, cast(sum(customers) as bigint) as customer_sum from (
            select c_nationkey, o_orderpriority, count(distinct o_custkey) as customers
            from orders join customer on c_custkey = o_custkey group by c_nationkey, o_orderpriority) t
        group by c_nationkey""",
    "agg_rollup_bitmap": """
        select c_nationkey, cast(sum(n) as bigint) as customer_sum, any_value(customers) as customers
        from (select c_nationkey, o_orderpriority, count(distinct o_custkey) as n
              from orders join customer on c_custkey = o_custkey group by all) f
        join (select c_nationkey, count(distinct o_custkey) as customers
              from orders join customer on c_custkey = o_custkey group by all) t using (c_nationkey)
        group by c_nationkey""",
    "agg_having": """
        select c_nationkey, c_mktsegment, count(*) as n from customer group by c_nationkey, c_mktsegment
        having count(*) > 12 and c_mktsegment not in ('HOUSEHOLD')""",
    "agg_listagg_ordered": """
        select c_nationkey, string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) as segments
        from customer group by c_nationkey""",
    "agg_listagg_distinct": """
        select n_regionkey, string_agg(distinct n_name, '' order by n_name) as names from nation group by n_regionkey""",
    "agg_listagg": """
        select l_orderkey, string_agg(l_returnflag, ',' order by l_returnflag) as flags from lineitem group by l_orderkey""",
    "agg_array": f"""
        select l_orderkey,
               max(case when rk = 1 then l_partkey end) as part_1, max(case when rk = 1 then l_quantity end) as qty_1,
               max(case when rk = 2 then l_partkey end) as part_2, max(case when rk = 2 then l_quantity end) as qty_2,
               max(case when rk = 3 then l_partkey end) as part_3, max(case when rk = 3 then l_quantity end) as qty_3
        from (select *, row_number() over (partition by l_orderkey order by l_quantity desc nulls first,
                                           {_asc(LINE_TIE[1:])}) as rk from lineitem) t
        where rk <= 3 group by l_orderkey""",
    "agg_pivot": PIVOT,
    "agg_pivot_sum": f"""
        select o_orderstatus, cast(sum(nov) as bigint) as nov_total, cast(sum(dec) as bigint) as dec_total,
               cast(sum(jan) as bigint) as jan_total
        from ({PIVOT}) p group by o_orderstatus""",
    "win_row_number": """
        select o_orderkey, o_custkey, cast(row_number() over (partition by o_custkey order by o_orderdate desc nulls first,
                                                              o_orderkey asc nulls last) as integer) as rn
        from orders""",
    "win_global_rank": f"""
        select *, cast(row_number() over (order by revenue desc nulls first, p_name asc nulls last) as bigint) as rk
        from ({NAME_TOTALS}) g""",
    "win_concat_key": f"""
        select cast(l_orderkey as varchar) || l_returnflag as uid, l_linenumber, l_partkey,
               cast(row_number() over (partition by l_orderkey, l_returnflag
                                       order by l_linenumber asc nulls last, {_asc(LINE_TIE[2:])}) as integer) as rn
        from lineitem""",
    "win_case_bucket": f"""
        select p_name, case when row_number() over (order by revenue desc nulls first, p_name asc nulls last) <= 10
                            then 'High'
                            when row_number() over (order by revenue asc nulls last, p_name asc nulls last) <= 10
                            then 'Low' else 'Mid' end as bucket
        from ({NAME_TOTALS}) g""",
    "win_lag_lead_default": """
        select event_id, lag(event_type, 1, '0') over (partition by user_id order by event_id) as prev_type,
               lead(event_type, 1, '0') over (partition by user_id order by event_id) as next_type
        from events""",
    "win_lag_lead": """
        select event_id, lag(value) over (partition by user_id order by event_id) as prev_value,
               lead(ts) over (partition by user_id order by event_id) as next_ts
        from events""",
    "win_case_lag": """
        select event_id, case when event_type in ('click', 'purchase')
                              then lag(ts, 1) over (partition by user_id order by ts, event_id) end as started_at
        from events""",
    "win_share": f"""
        select l_orderkey, l_linenumber, l_partkey, {ratio('qty', 'total_qty', 2)} as share from (
            select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as bigint) as qty,
                   sum(cast(l_quantity as bigint)) over (partition by l_orderkey) as total_qty
            from lineitem) t""",
    "win_over_agg": """
        select l_suppkey, l_returnflag, count(distinct l_orderkey) as orders,
               cast(row_number() over (partition by l_suppkey order by count(distinct l_orderkey) desc nulls first,
                                       l_returnflag asc nulls last) as integer) as rk
        from lineitem group by l_suppkey, l_returnflag""",
    "qualify_first": """
        select o_custkey, o_orderkey, o_orderdate from orders
        qualify row_number() over (partition by o_custkey order by o_orderdate desc nulls first,
                                   o_orderkey asc nulls last) = 1""",
    "qualify_topn": """
        select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey
               order by o_totalprice desc nulls first, o_orderkey asc nulls last) as integer) as rank
        from orders qualify rank <= 3""",
    "qualify_kth": """
        select o_custkey, o_orderkey from orders
        qualify row_number() over (partition by o_custkey order by o_orderdate desc nulls first,
                                   o_orderkey asc nulls last) = 3""",
    "qualify_or": f"""
        select p_name, cat from (
            select *, case when n_orders > 700 then 'low' else 'other' end as cat from ({NAME_TOTALS}) g) t
        qualify row_number() over (order by revenue desc nulls first, p_name asc nulls last) <= 5
             or row_number() over (order by revenue asc nulls last, p_name asc nulls last) <= 5
             or (row_number() over (partition by cat order by revenue asc nulls last, p_name asc nulls last) <= 5
                 and cat = 'low')""",
    "qualify_after_lead": """
        select o_custkey, o_orderkey,
               lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as next_order
        from orders
        qualify row_number() over (partition by o_custkey order by o_orderkey) = 1""",
    "sort_final": """
        select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as total
        from orders group by o_custkey order by total desc nulls first, o_custkey""",
    "topk_global": f"""
        select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
        order by l_extendedprice desc nulls first, {_asc(LINE_TIE)} limit 20""",
    "union_all": with_query(_SCANS, [], """
        select hu_id, hu_id_2, end_tran_date, tran_log_id from scan_live where tran_type = 'swap'
        union all
        select hu_id, hu_id_2, end_tran_date, tran_log_id from scan_archive where tran_type = 'swap'"""),
    "fn_lower": "select c_custkey, lower(c_name) as name from customer",
    "fn_trim": "select c_custkey, trim('  ' || c_mktsegment || ' ') as seg from customer",
    "fn_right": """
        select l_orderkey, l_linenumber, l_partkey, right(cast(l_linenumber as varchar), 1) as last_digit,
               right(cast(l_linenumber as varchar), 1) in ('1', '3', '5', '7', '9') as odd
        from lineitem""",
    "fn_concat": """
        select c_custkey, cast(c_nationkey as varchar) || '-' || nullif(c_mktsegment, 'BUILDING') as label
        from customer""",
    "fn_coalesce": """
        select l_orderkey, l_linenumber, l_partkey, coalesce(nullif(l_tax, 0.0), l_discount, 0.0) as rate from lineitem""",
    "fn_iff": """
        select l_orderkey, l_linenumber, l_partkey,
               case when nullif(l_returnflag, 'A') = 'R' then 'returned' else 'other' end as kind
        from lineitem""",
    "fn_case": """
        select o_orderkey, case when o_totalprice > 300000 then 'large' when o_totalprice > 100000 then 'medium'
                                when o_orderstatus = 'P' then 'pending' end as size_class
        from orders""",
    "fn_case_nested": """
        select o_orderkey,
               case when o_orderpriority in ('1-URGENT', '2-HIGH')
                    then case when o_orderstatus = 'F' then 'done' when o_orderstatus = 'O' then 'open'
                              else o_orderpriority end
                    else o_orderpriority end as label
        from orders""",
    "fn_least_greatest": """
        select l_orderkey, l_linenumber, l_partkey,
               least(l_partkey, nullif(l_suppkey, 0), case when l_returnflag = 'R' then l_orderkey end) as lo,
               greatest(l_partkey, nullif(l_suppkey, 0), case when l_returnflag = 'R' then l_orderkey end) as hi,
               list_min([if(l_linenumber > k, l_orderkey + k * (l_partkey - l_suppkey), 99999999) for k in range(7)]) as first_id,
               list_max([if(l_linenumber > k, l_orderkey + k * (l_partkey - l_suppkey), 0) for k in range(7)]) as last_id
        from lineitem""",
    "fn_arith": """
        select l_orderkey, l_linenumber, l_partkey,
               cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))
                    * (1 + cast(l_tax as decimal(4,2))) as decimal(38,6)) as net,
               (cast(l_quantity as bigint) - l_linenumber) * -1 as neg_gap
        from lineitem""",
    "fn_round": """
        select l_orderkey, l_linenumber, l_partkey,
               cast(round(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)), 1) as decimal(38,1)) as r1,
               cast(round(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)), 2) as decimal(38,2)) as r2,
               cast(round(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)), 3) as decimal(38,3)) as r3
        from lineitem""",
    "fn_cast": """
        select l_orderkey, l_linenumber, l_partkey, cast(l_shipdate as date) as ship_day,
               cast(l_quantity as integer) as qty, cast(l_orderkey as varchar) as okey
        from lineitem""",
    "fn_try_cast": """
        select c_custkey, try_cast(substr(c_name, 10, 9) as integer) as from_name,
               try_cast(cast(c_nationkey as varchar) || 'R' as integer) as bad, try_cast('' as integer) as empty
        from customer""",
    "fn_text_num": """
        select event_id, lag(event_type, 1, '0') over (partition by user_id order by event_id) = '0' as first_of_user
        from events""",
    "fn_text_date": "select o_orderkey from orders where o_orderdate >= timestamp '2000-06-15'",
    "fn_sentinel_date": """
        select o_orderkey, coalesce(case when o_orderstatus <> 'O' then cast(o_orderdate as date) end,
                                    cast(strptime('01/01/2999', '%m/%d/%Y') as date)) as closed_on
        from orders""",
    "fn_date_trunc": """
        select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month,
               cast(date_trunc('month', o_orderdate) as date) = date '1999-01-01' as is_jan99
        from orders""",
    "fn_month_year": """
        select o_orderkey, cast(month(o_orderdate) as integer) as m, cast(year(o_orderdate) as integer) as y from orders""",
    "fn_datediff": """
        select l_orderkey, l_linenumber, l_partkey,
               cast(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as integer) as days
        from lineitem join orders on o_orderkey = l_orderkey""",
    "fn_as_of": """
        select o_orderkey, cast(date_diff('day', cast(o_orderdate as date), date '2001-06-01') as integer) as age
        from orders""",
    "fn_array_get": """
        select l_orderkey, list_sort(list(l_linenumber))[1] as first_line, list_sort(list(l_linenumber))[10] as tenth_line
        from lineitem group by l_orderkey""",
    "fn_json_get": """
        select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.seat') as seat
        from events""",
}


def queries() -> dict[str, str]:
    return dict(SQL)
