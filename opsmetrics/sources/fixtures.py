"""Map the driver's tables onto the inputs each job expects.

The jobs are written against the column names of their business inputs (scan log,
delivery fact, clinic dimension, shipment items ...). The test data is a TPC-H-like star
schema plus an event stream, so each input is *derived* from those tables by one SQL
view below. The views use only SQL that Spark and DuckDB read the same way (CASE, CAST,
joins, GROUP BY, ``lead``), so the DuckDB oracle derives exactly the same inputs from the
same Parquet files and only the jobs themselves are compared.

``derive(spark, root, name)`` returns the Spark DataFrame of a view (dependencies are
resolved recursively and passed to ``spark.sql`` as DataFrame parameters);
``with_clause(names)`` returns the DuckDB ``WITH`` text for the oracle.
Every view reads whole tables: no sampling, id subsets or row caps.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from opsmetrics.sources.tables import TABLE_NAMES, read_table

# name -> SQL over base tables / other views, referenced as {name}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


# --------------------------------------------------------------------------- dwell (D)
# Scan log from the event stream: item = user, sequence = event id (event ids follow
# time), scan type = event type, description = event type.
view("scan_log", """
select e.event_id as tran_log_id, e.user_id as hu_id, e.event_type as tran_type,
       e.event_type as description, e.ts as end_tran_date
from {events} e
""")


# --------------------------------------------------------------------------- scorecard (C)
# Delivery fact = order lines. delivery id = order key (several lines per delivery),
# patient = customer, clinic = the customer's nation, product = part. Money is exact
# decimal built from decimal inputs. Nullable adjustment terms come from data values.
view("fills", """
select l.l_orderkey as delivery_id,
       o.o_custkey as patient_key,
       c.c_nationkey as clinic_key,
       l.l_partkey as product_key,
       l.l_shipdate as delivered_at,
       case when l.l_linestatus = 'O' then l.l_shipdate end as canceled_at,
       cast(cast(l.l_extendedprice as decimal(18,2)) * (1 - cast(l.l_discount as decimal(4,2))) as decimal(18,4))
           as base_revenue,
       cast(cast(l.l_extendedprice as decimal(18,2)) * cast(nullif(l.l_tax, 0) as decimal(4,2)) as decimal(18,4))
           as revenue_adjustment_a,
       cast(case when l.l_returnflag = 'A' then 25 end as decimal(18,4)) as revenue_adjustment_b,
       cast(case when l.l_discount >= 0.09 then cast(l.l_quantity as decimal(18,2)) * 10 end as decimal(18,4))
           as revenue_deduction,
       cast(cast(l.l_quantity as decimal(18,2)) * cast(p.p_retailprice as decimal(18,2)) * 1.5 as decimal(18,4))
           as cost_of_goods,
       cast(case when l.l_linenumber = 1 then 100 end as decimal(18,4)) as cost_rebate,
       o.o_orderpriority as attribution_area
from {lineitem} l
join {orders} o on o.o_orderkey = l.l_orderkey
left join {customer} c on c.c_custkey = o.o_custkey
left join {part} p on p.p_partkey = l.l_partkey
""")

# first order date per customer (the "created" date of a patient)
view("first_orders", """
select o_custkey, min(o_orderdate) as first_order from {orders} group by o_custkey
""")

view("patients", """
select c.c_custkey as key, c.c_mktsegment as patient_category, c.c_custkey as patient_user_id,
       f.first_order as created_at, c.c_acctbal < 0 as first_rx_excluded
from {customer} c left join {first_orders} f on f.o_custkey = c.c_custkey
""")

# clinic = nation; super clinic = region, so one super clinic has several clinic names
view("clinics", """
select n.n_nationkey as key, n.n_regionkey as super_clinic_id, n.n_name as clinic_name,
       cast(n.n_nationkey as string) as crm_key, r.r_name as state,
       'pm ' || r.r_name as account_manager, f.first_rx as first_prescription_created_at
from {nation} n
left join {region} r on r.r_regionkey = n.n_regionkey
left join (select c.c_nationkey, min(o.o_orderdate) as first_rx
           from {orders} o join {customer} c on c.c_custkey = o.o_custkey
           group by c.c_nationkey) f on f.c_nationkey = n.n_nationkey
""")

# product attributes are functions of the part name, so a product name is one group
view("products", """
select p_partkey as key, p_name as product_name,
       case when split_part(p_name, ' ', 2) in ('bolt', 'rod', 'ring', 'plate') then 'generic' else 'brand' end
           as brand_vs_generic,
       case when p_size <= 10 then 'GLP-' || p_brand end as target_class,
       p_type as fallback_class,
       split_part(p_name, ' ', 1) as etc_level_1,
       split_part(p_name, ' ', 2) as etc_level_2,
       'general' as etc_level_3,
       case when split_part(p_name, ' ', 1) in ('hot', 'cold') then 'temperature' end as etc_level_4,
       p_size > 48 as is_excluded_product
from {part}
""")

# user funnel: one row per order; intake = customer
view("funnels", """
select o_custkey as user_id, o_custkey as first_intake_key, o_custkey as patient_key_d1, o_orderdate as created_at
from {orders}
""")

view("intakes", """
select c_custkey as key, c_nationkey as clinic_key, c_custkey as user_id, c_custkey as patient_key
from {customer}
""")

# new-patient basket: one row per order, item counts by product group
view("rx_groups", """
select o.o_custkey as user_id,
       count(*) as num_rx_14d,
       count(case when p.p_size > 48 then 1 end) as num_excluded_rx_14d,
       count(case when p.p_name like '%gear%' then 1 end) as num_group_a_rx_14d,
       count(case when p.p_name like '%bolt%' then 1 end) as num_group_b_rx_14d,
       o.o_orderdate as first_prescription_created_at
from {orders} o
join {lineitem} l on l.l_orderkey = o.o_orderkey
join {part} p on p.p_partkey = l.l_partkey
group by o.o_orderkey, o.o_custkey, o.o_orderdate
""")

# CRM accounts: ids as text, some missing, some not numeric
view("accounts", """
select case when c_mktsegment = 'BUILDING' then cast(c_nationkey as string) end as crm_id_a,
       case when c_mktsegment = 'MACHINERY' then cast(c_nationkey as string) end as crm_id_b,
       case when c_acctbal < 0 then 'n/a-' || cast(c_nationkey as string) else cast(c_nationkey as string) end
           as crm_id_c,
       case when c_acctbal > 5000 then 'owned' end as ownership_type_a,
       lower(c_mktsegment) as ownership_type_b
from {customer}
""")

# monthly status per (clinic, month): stage from the month's order count
view("clinic_status", """
select n.n_regionkey as super_clinic_id, n.n_name as clinic_name,
       'owner ' || cast(n.n_regionkey as string) as owner_name, r.r_name as market,
       m.fiscal_month,
       case m.cnt % 4 when 1 then 'Emerging' when 2 then 'Established' when 3 then 'Partnership' end
           as funnel_stage,
       case m.cnt % 4 when 1 then 4 when 2 then 5 when 3 then 6 end as funnel_stage_index,
       m.cnt % 2 = 0 as has_tia, m.cnt % 3 = 0 as has_ehr_access, m.cnt % 5 = 0 as has_connect
from (select c.c_nationkey, cast(date_trunc('month', o.o_orderdate) as date) as fiscal_month, count(*) as cnt
      from {orders} o join {customer} c on c.c_custkey = o.o_custkey
      group by c.c_nationkey, cast(date_trunc('month', o.o_orderdate) as date)) m
join {nation} n on n.n_nationkey = m.c_nationkey
join {region} r on r.r_regionkey = n.n_regionkey
""")


# --------------------------------------------------------------------------- replacements (R)
# Shipment items = order lines. Lines flagged 'R' are replacements: their parent order is
# the line's order, their own order id is derived from it. The barcode of an item is the
# key of its order; SKU = part noun, style = part type. Event = the order date.
view("shipment_items", """
select o.o_custkey as user_id,
       cast(year(o.o_orderdate) * 10000 + month(o.o_orderdate) * 100 + day(o.o_orderdate) as bigint) as event_id,
       case when l.l_returnflag = 'R' then l.l_orderkey * 100 + l.l_linenumber else l.l_orderkey end as order_id,
       case when l.l_returnflag = 'R' then l.l_orderkey end as parent_order_id,
       l.l_orderkey as size_check_id,
       cast(l.l_shipdate as date) as shipment_date,
       cast(l.l_orderkey as string) as shipping_reference_code,
       split_part(p.p_name, ' ', 2) as sku_code,
       cast(p.p_size as string) as sku_size,
       case when l.l_quantity > 45 then 'XL' else cast(cast(l.l_quantity as bigint) as string) end as sku_length,
       p.p_brand as sku_fit,
       case when l.l_tax >= 0.07 then 'hem ' || cast(l.l_linenumber as string) end as tailor_comments,
       'v-' || p.p_brand as version_name,
       'cg-' || p.p_type as compatibility_group_name,
       split_part(p.p_name, ' ', 2) as product_category_name,
       p.p_type || ' ' || split_part(p.p_name, ' ', 2)
           || case split_part(p.p_name, ' ', 2) when 'ring' then ' Jacket' when 'bolt' then ' shirt' when 'rod' then ' Pant' else '' end
           as product_style_name,
       p.p_type as product_style_code,
       o.o_orderpriority as shipment_type_name,
       split_part(p.p_name, ' ', 1) as sku_category_name,
       l.l_returnflag = 'R' as is_replacement,
       o.o_orderstatus = 'P' and l.l_linenumber = 7 as is_shipment_voided,
       l.l_discount = 0 as is_home_try_on,
       l.l_linestatus = 'O' and l.l_returnflag = 'N' as is_delivery_canceled
from {lineitem} l
join {orders} o on o.o_orderkey = l.l_orderkey
join {part} p on p.p_partkey = l.l_partkey
""")

view("order_dim", """
select o_orderkey as order_id, o_totalprice > 300000 as order_had_sku_sellout from {orders}
""")

view("host_detail", """
select distinct cast(l.l_orderkey as string) as order_number, split_part(p.p_name, ' ', 2) as item_number,
       cast(l.l_orderkey as string) as hu_id
from {lineitem} l join {part} p on p.p_partkey = l.l_partkey
""")

view("stored_items", """
select cast(o_orderkey as string) as hu_id, cast(o_orderdate as date) as fifo_date,
       o_orderstatus = 'P' as is_deleted
from {orders}
""")

view("event_dim", """
select distinct cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as bigint) as event_id,
       cast(o_orderdate as date) as event_date
from {orders}
""")

view("receipts", """
select o_orderkey as hu_id,
       case when o_orderpriority = '1-URGENT' then 'lot-' || o_orderstatus end as vendor_lot_num,
       case when o_totalprice > 200000 then 'L-' || o_orderpriority end as lot_number
from {orders}
""")

view("appointments_report", """
select o.o_custkey as user_id,
       cast(year(o.o_orderdate) * 10000 + month(o.o_orderdate) * 100 + day(o.o_orderdate) as bigint) as event_id,
       o.o_orderpriority as showroom_group_name,
       cast(l.l_shipdate as date) as showroom_appointment_date,
       case when l.l_returnflag = 'A' and l.l_linestatus = 'F' then 1 else 0 end as cancelled_cnt,
       case when l.l_discount = 0.1 then 1 else 0 end as no_show_cnt
from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey
""")

# associates and care staff are suppliers
view("appointments", """
select case when l_returnflag = 'N' then l_suppkey else -1001 end as associate_user_id from {lineitem}
""")

view("staff_users", """
select s_suppkey as user_id, case when s_acctbal < 0 then '(Missing)' else s_name end as user_full_name,
       lower(s_name) || '@example.com' as user_email
from {supplier}
""")

view("care_staff", """
select s_suppkey as user_id, s_name as employee_full_name,
       ' site' || cast(s_nationkey as string) || ' ' as employee_site,
       case when s_nationkey < 8 then 'CX' when s_nationkey < 16 then 'Ops' end as employee_group
from {supplier}
""")

view("size_checks", """
select o.o_custkey as user_id, l.l_orderkey * 100 + l.l_linenumber as size_survey_id, l.l_orderkey as size_check_id,
       case when l.l_linestatus = 'O' then null else l.l_suppkey end as admin_user_id,
       case l.l_linenumber % 4 when 0 then 'Customer Request' when 1 then 'Fit Specialist/Admin'
            when 2 then 'replacement check' else 'Auto Size' end as size_check_reason_desc,
       case when p.p_size < 5 then null else split_part(p.p_name, ' ', 2) end as product_category_name,
       cast(p.p_size as string) as predicted_size,
       cast(l.l_linenumber as string) as survey_size,
       cast(p.p_size as string) as checked_size,
       l.l_discount > 0.05 as is_auto_size_checked,
       l.l_tax > 0.04 as passed_auto_size_checked,
       l.l_shipdate as size_check_ts
from {lineitem} l
join {orders} o on o.o_orderkey = l.l_orderkey
join {part} p on p.p_partkey = l.l_partkey
""")

# replacement forms = events (order reference = event id, product set = user id,
# fit description = the JSON props)
view("replacement_forms", """
select user_id as order_id, cast(floor(value) as bigint) as product_set_id, event_id as ticket_id,
       cast(ts as date) as ticket_created_date,
       cast(cast(floor(value) as bigint) as string) as requested_length,
       props as fit_description,
       event_type = 'click' as is_fit_replacement,
       event_type = 'error' as is_item_missing_replacement,
       event_type = 'signup' as is_damaged_replacement,
       event_type = 'purchase' as is_wrong_item_replacement
from {events}
""")

view("product_sets", """
select p_partkey as product_set_id, split_part(p_name, ' ', 2) as product_category_name from {part}
""")

view("asn_detail", """
select cast(l_orderkey as string) as hu_id, cast(l_partkey as string) as item_number,
       'ASN-' || cast(l_suppkey as string) as asn_number, l_returnflag || l_linestatus as lot_number,
       'PO-' || cast(l_orderkey as string) as po_number,
       cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as serial_number,
       cast(l_shipdate as date) as create_date
from {lineitem}
""")

view("asn_master", """
select 'ASN-' || cast(s_suppkey as string) as asn_number, 'V' || cast(s_suppkey as string) as vendor_code,
       case when s_acctbal < 0 then null else cast('1998-01-01' as date) + cast(s_suppkey as int) end as delivery_date
from {supplier}
""")

view("purchase_orders", """
select distinct 'PO-' || cast(l.l_orderkey as string) as purchase_id, 'V' || cast(l.l_suppkey as string) as vendor_id,
       cast(l.l_partkey as string) as sku_code, s.s_name as vendor_name
from {lineitem} l join {supplier} s on s.s_suppkey = l.l_suppkey
""")

# scan log with barcode swaps: an order's barcode is swapped to the customer's next order
# (by date, then key); a customer's last order is a plain receipt scan. Some pending orders are also
# swapped back (a cycle), to the order after the next (a fork), to themselves (a self-loop), or to the
# consolidation barcode of the customer's nation (a hub), which goes on to the nation's first and last order.
# Split into a live and an archive table by date.
view("order_steps", """
select o_orderkey, cast(o_orderkey as string) as hu_id, o_orderdate, o_orderpriority, o_orderstatus, o_custkey,
       cast(lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as string) as next_id,
       lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as next_date,
       cast(lead(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey) as string) as second_id
from {orders}
""")

view("nation_ends", """
select c.c_nationkey, min(o.o_orderkey) as first_key, max(o.o_orderkey) as last_key
from {orders} o join {customer} c on c.c_custkey = o.o_custkey
group by c.c_nationkey
""")

view("swap_log", """
select hu_id, next_id as hu_id_2, coalesce(next_date, o_orderdate) as end_tran_date, o_orderkey as tran_log_id,
       case when next_id is null then 'receive' else 'swap' end as tran_type
from {order_steps}
union all
select next_id, hu_id, next_date, 10000000 + o_orderkey, 'swap'
from {order_steps} where next_id is not null and o_orderstatus = 'P' and o_orderpriority = '1-URGENT'
union all
select hu_id, second_id, next_date, 20000000 + o_orderkey, 'swap'
from {order_steps} where second_id is not null and o_orderstatus = 'P' and o_orderpriority = '2-HIGH'
union all
select hu_id, hu_id, o_orderdate, 30000000 + o_orderkey, 'swap'
from {order_steps} where o_orderstatus = 'P' and o_orderpriority = '3-MEDIUM'
union all
select s.hu_id, 'hub-' || cast(c.c_nationkey as string), s.o_orderdate, 40000000 + s.o_orderkey, 'swap'
from {order_steps} s join {customer} c on c.c_custkey = s.o_custkey
where s.o_orderstatus = 'P' and s.o_orderpriority = '5-LOW'
union all
select 'hub-' || cast(c_nationkey as string), cast(first_key as string), cast('1999-06-01' as timestamp), 50000000 + c_nationkey, 'swap'
from {nation_ends}
union all
select 'hub-' || cast(c_nationkey as string), cast(last_key as string), cast('2000-06-01' as timestamp), 60000000 + c_nationkey, 'swap'
from {nation_ends}
""")

view("scan_live", """
select * from {swap_log} where end_tran_date >= cast('2000-01-01' as timestamp)
""")

view("scan_archive", """
select * from {swap_log} where end_tran_date < cast('2000-01-01' as timestamp)
""")

view("version_prefs", """
select o.o_custkey as user_id, split_part(p.p_name, ' ', 2) as product_category_name,
       l.l_linestatus as showroom_preferred_version_name
from {lineitem} l
join {orders} o on o.o_orderkey = l.l_orderkey
join {part} p on p.p_partkey = l.l_partkey
""")

# support tickets = documents about an order (order key = document id): the whole text and a remark that
# follows from the order and the customer
view("tickets", """
select d.doc_id as order_id, o.o_custkey as user_id,
       d.text || case when o.o_orderpriority = '1-URGENT' and c.c_mktsegment = 'BUILDING' then ' The seam has a TEAR.'
                      when o.o_orderpriority = '1-URGENT' and c.c_mktsegment = 'MACHINERY' then ' Was stolen from the porch.'
                      when o.o_orderpriority = '1-URGENT' then ' It came wrinkled.'
                      when o.o_orderpriority = '2-HIGH' and o.o_orderstatus = 'F' then ' Jacket Sleeve Tailoring asked for.'
                      when o.o_orderpriority = '2-HIGH' then ' Please extend it.'
                      when o.o_orderpriority = '3-MEDIUM' and o.o_orderstatus = 'F' then ' Not received, lost.'
                      when o.o_orderpriority = '3-MEDIUM' then ' This is the WRONG colour.'
                      when o.o_orderpriority = '4-NOT SPECIFIED' and o.o_orderstatus = 'F' then ' Returned to sender.'
                      when o.o_orderpriority = '4-NOT SPECIFIED' then ' The jacket only.'
                      when o.o_orderpriority = '5-LOW' and o.o_orderstatus = 'F' then ' The pants only.'
                      else '' end as ticket_comments,
       case d.lang when 'en' then 'replacement' when 'fr' then 'Replace item' else 'refund' end as request_type
from {documents} d join {orders} o on o.o_orderkey = d.doc_id join {customer} c on c.c_custkey = o.o_custkey
""")


_REF = re.compile(r"\{([a-z_0-9]+)\}")


def deps(name: str) -> list[str]:
    return _REF.findall(VIEWS[name])


def _view_name(root: str, name: str) -> str:
    return f"om_{zlib.crc32(root.encode()):08x}_{name}"


def derive(spark: SparkSession, root: str, name: str, _memo: dict | None = None) -> DataFrame:
    """Spark DataFrame of a base table or a derived view.

    Dependencies are registered as temp views and the view text is run with ``spark.sql``.
    """
    memo = {} if _memo is None else _memo
    if name in memo:
        return memo[name]
    if name in TABLE_NAMES:
        df = read_table(spark, root, name)
    else:
        text = VIEWS[name]
        for d in dict.fromkeys(deps(name)):
            derive(spark, root, d, memo)
            text = text.replace("{" + d + "}", _view_name(root, d))
        df = spark.sql(text)
    df.createOrReplaceTempView(_view_name(root, name))
    memo[name] = df
    return df


class Inputs:
    """``Inputs(spark, root)["scan_log"]``: derived views, each built once per instance."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._memo = spark, root, {}

    def __getitem__(self, name: str) -> DataFrame:
        return derive(self.spark, self.root, name, self._memo)


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n):
        if n in TABLE_NAMES or n in order:
            return
        for d in deps(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def cte_list(*names: str) -> list[str]:
    """DuckDB ``name AS (...)`` items for the named views and everything they need."""
    return [f"{n} AS (\n{_REF.sub(lambda m: m.group(1), VIEWS[n])}\n)" for n in _closure(names)]


def with_query(views, ctes: list[tuple[str, str]], select: str) -> str:
    """Oracle text: ``WITH <views>, <ctes> <select>``."""
    items = cte_list(*views) + [f"{n} AS (\n{q.strip()}\n)" for n, q in ctes]
    return ("WITH " + ",\n".join(items) + "\n" if items else "") + select.strip()
