"""Entity KPI scorecard: one row per (entity, entity name) from a delivery star schema.

Inputs (DataFrames, column names as in ``sources.fixtures``): delivery fact ``fills``,
dimensions ``products`` / ``clinics`` / ``patients``, ``funnels`` + ``intakes`` (new users
per month), ``rx_groups`` (new-user baskets), ``accounts`` (CRM ids as text) and
``clinic_status`` (one row per entity and month).

Plan shape
----------
* The fact is scanned once. It is joined to its dimensions and reduced to a lattice of partial aggregates, one
  mergeable row per (entity, category, product, patient, delivery, windows) with sums, counts and any-flags
  (``fact_lattice``), which is written once. All branches fold from these rows, each by dropping the keys that it
  doesn't need, and so does the dominant category, which no window or cancellation filters: rows outside all
  windows keep entity, category and delivery only.
* Dimension joins are plain equi-joins. Spark broadcasts a side only when its measured
  size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and sort-merge joins
  otherwise, so no side is broadcast on trust.
* Branch results are per entity or per (entity, product): small frames whose final left
  joins are cheap whatever strategy Spark picks.
* Margin bands are three distributed top-n lists over the per-product aggregate; no
  step ranks all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.functions import margin as M
from opsmetrics.functions.semantics import (MONEY_SUM, asc, date_window, desc, ilike_any, iff, mean_from_parts,
                                            month_start, ratio, total_order)
from opsmetrics.operators.aggregates import distinct_counts_by_flags, join_on_keys, latest_row, listagg, pivot_sum, sum_if
from opsmetrics.operators.joins import left_join_spread, spread_nulls
from opsmetrics.operators.windows import qualify
from opsmetrics.sources.staging import staged

# fixed values: band labels and the default stage label of the scorecard
HIGH_BAND, NEGATIVE_BAND, LOW_BAND, OTHER_BAND = "High GP Product", "Negative GP Product", "Low GP Product", "Other"
CHURNED = "Churned"


@dataclass(frozen=True)
class ScorecardParams:
    period: tuple[str, str] = ("1998-07-01", "1998-12-31")      # main window, dates inclusive
    month: str = "1999-01-01"                                     # one-month snapshot
    funnel_period: tuple[str, str] = ("1998-11-01", "1999-01-31")
    funnel_months: tuple[int, ...] = (11, 12, 1)
    funnel_names: tuple[str, ...] = ("nov_np", "dec_np", "jan_np_mtd")
    status_year: int = 1998
    excluded_categories: tuple[str, ...] = ("HOUSEHOLD",)
    kpi_excluded_products: tuple[str, ...] = ("%anvil%", "%GIZMO%")
    money_excluded_product: str = "%anvil%"
    margin_excluded_products: tuple[str, ...] = ("%anvil%", "%GIZMO%", "%ROD%")
    margin_areas: tuple[str, ...] = ("1-URGENT", "2-HIGH", "3-MEDIUM")
    snapshot_pattern: str = "%widget%"
    fee_pattern: str = "GLP%"
    fee: str = "11.99"
    generic_value: str = "generic"
    top_n: int = 5
    top_columns: int = 3
    min_fills: int = 10
    band_n: int = 20
    band_volume: int = 50
    stage_labels: tuple[tuple[int, str], ...] = ((4, "Emerging"), (5, "Established"), (6, "Partnership"))
    kth_stage: int = 3


# ----------------------------------------------------------------------------- dimensions
def _products(products: DataFrame) -> DataFrame:
    return products.select(F.col("key").alias("p_key"), "product_name", "brand_vs_generic",
                           "target_class", "fallback_class", "etc_level_1",
                           "etc_level_2", "etc_level_3", "etc_level_4", "is_excluded_product")


def _clinics(clinics: DataFrame) -> DataFrame:
    return clinics.select(F.col("key").alias("c_key"), "super_clinic_id",
                          F.col("clinic_name").alias("c_clinic_name"), "crm_key", "state",
                          F.col("account_manager").alias("pm"), "first_prescription_created_at")


def _patients(patients: DataFrame) -> DataFrame:
    return patients.select(F.col("key").alias("pt_key"), "patient_category", "patient_user_id",
                           F.col("created_at").alias("pt_created_at"), "first_rx_excluded")


# ----------------------------------------------------------------------------- steps
def dominant_category(facts: DataFrame, entity: str = "super_clinic_id", category: str = "patient_category",
                      id: str = "delivery_id", name: str = "fills") -> DataFrame:
    """Per entity, the category with the most distinct ids (ties: the smaller category)."""
    g = facts.groupBy(entity, category).agg(F.count_distinct(id).alias(name))
    return latest_row(g, [entity], [(name, "desc"), category], [category, name])


def _windows(p: ScorecardParams) -> dict[str, Column]:
    """The date windows of the branches on the raw fact. The last compares the timestamp with the bare end date."""
    month_end = F.date_sub(F.add_months(F.lit(p.month).cast("date"), 1), 1)
    at = F.col("delivered_at")
    return {
        "in_period": date_window("delivered_at", *p.period),
        "in_month": ((at >= F.lit(p.month).cast("date").cast("timestamp_ntz"))
                     & (at < F.date_add(month_end, 1).cast("timestamp_ntz"))),
        "in_bound": (at >= F.lit(p.period[0]).cast("timestamp_ntz")) & (at <= F.lit(p.period[1]).cast("timestamp_ntz")),
    }


LATTICE_ENTITY = ["super_clinic_id", "clinic_name", "crm_key", "state", "patient_category", "delivery_id"]
LATTICE_ITEM = ["product_name", "brand_vs_generic", "etc_level_1", "description", "has_fee", "is_excluded_product", "attribution_area",
                "patient_user_id"]


def fact_lattice(fills: DataFrame, products: DataFrame, clinics: DataFrame, patients: DataFrame, p: ScorecardParams,
                 persist: bool = True) -> DataFrame:
    """Partial aggregates of the whole fact from one scan; see the module's docstring.

    Cancelled rows and rows outside all windows have no product, and keys that are NULL for that or any other reason
    are spread over the tasks of the joins.
    """
    live = F.col("canceled_at").isNull()
    windows = {n: live & F.coalesce(c, F.lit(False)) for n, c in _windows(p).items()}
    any_window = windows["in_period"] | windows["in_month"] | windows["in_bound"]
    pr = products.select(
        F.col("key").alias("p_key"), "product_name", "brand_vs_generic", "etc_level_1", "is_excluded_product",
        F.concat(F.col("etc_level_2"), F.lit(" - "), F.coalesce("etc_level_4", "etc_level_3")).alias("description"),
        F.coalesce("target_class", "fallback_class").ilike(p.fee_pattern).alias("has_fee"))
    f = fills.select("delivery_id", "patient_key", "clinic_key", "delivered_at", F.when(any_window, F.col("product_key")).alias("product_key"),
                     F.when(any_window, F.col("attribution_area")).alias("attribution_area"),
                     F.when(any_window, M.revenue()).alias("revenue"), F.when(any_window, M.profit()).alias("profit"),
                     *[c.alias(n) for n, c in windows.items()])
    j = left_join_spread(spread_nulls(f, ["product_key"]), pr, [("product_key", "p_key")]).drop("_spread")
    j = (j.join(_clinics(clinics), F.col("clinic_key") == F.col("c_key"), "left")
         .join(_patients(patients), F.col("patient_key") == F.col("pt_key"), "left"))
    inside = F.col("in_period") | F.col("in_month") | F.col("in_bound")
    rows = j.select(
        "super_clinic_id", F.lower("c_clinic_name").alias("clinic_name"), "crm_key", "state", "patient_category", "delivery_id",
        *LATTICE_ITEM[:-1], F.when(inside, F.col("patient_user_id")).alias("patient_user_id"), *windows,
        (inside & (month_start("delivered_at") == month_start("pt_created_at"))).alias("new_patient"), "revenue", "profit")
    out = rows.groupBy(*LATTICE_ENTITY, *LATTICE_ITEM, *windows).agg(
        F.count(F.lit(1)).alias("n"), F.max("new_patient").alias("new_patient"), F.max(F.col("profit") < 0).alias("negative"),
        F.sum("profit").alias("profit"), F.count("profit").alias("profit_n"),
        F.sum("revenue").alias("revenue"), F.count("revenue").alias("revenue_n"))
    return staged(out, "lattice") if persist else out


def with_category(lattice: DataFrame, clinic_ta: DataFrame) -> DataFrame:
    """The rows of any window with their entity's dominant category."""
    ta = clinic_ta.select(F.col("super_clinic_id").alias("ta_super_clinic_id"), F.col("patient_category").alias("clinic_ta"))
    return (lattice.where(F.col("in_period") | F.col("in_month") | F.col("in_bound"))
            .join(ta, F.col("super_clinic_id") == F.col("ta_super_clinic_id"), "left").drop("ta_super_clinic_id"))


def shared_fact(fills: DataFrame, products: DataFrame, clinics: DataFrame, patients: DataFrame,
                clinic_ta: DataFrame, p: ScorecardParams, persist: bool = True) -> DataFrame:
    """The single fact rows behind the lattice: not cancelled, inside any window, joined to all dimensions."""
    lo = min(p.period[0], p.month)
    month_end = F.date_sub(F.add_months(F.lit(p.month).cast("date"), 1), 1)
    hi_expr = F.greatest(F.lit(p.period[1]).cast("date"), month_end)
    f = fills.where(F.col("canceled_at").isNull()
                    & (F.col("delivered_at") >= F.lit(lo).cast("date").cast("timestamp_ntz"))
                    & (F.col("delivered_at") < F.date_add(hi_expr, 1).cast("timestamp_ntz")))
    ta = clinic_ta.select(F.col("super_clinic_id").alias("ta_super_clinic_id"),
                          F.col("patient_category").alias("clinic_ta"))
    j = (f.join(_products(products), F.col("product_key") == F.col("p_key"), "left")
         .join(_clinics(clinics), F.col("clinic_key") == F.col("c_key"), "left")
         .join(_patients(patients), F.col("patient_key") == F.col("pt_key"), "left")
         .join(ta, F.col("super_clinic_id") == F.col("ta_super_clinic_id"), "left"))
    out = j.select(
        "delivery_id", "delivered_at", "product_name", "brand_vs_generic", "target_class",
        "fallback_class", "etc_level_1", "etc_level_2", "etc_level_3", "etc_level_4",
        "is_excluded_product", "super_clinic_id", F.lower("c_clinic_name").alias("clinic_name"),
        "crm_key", "state", "patient_user_id", "pt_created_at", "clinic_ta",
        "attribution_area",
        M.revenue().alias("revenue"), M.profit().alias("profit"))
    return staged(out, "fact") if persist else out


def _keep_ta(p: ScorecardParams):
    return ~F.col("clinic_ta").isin(list(p.excluded_categories))


def product_entity_kpis(fact: DataFrame, p: ScorecardParams) -> DataFrame:
    """Per (product, entity): distinct patients / deliveries, margin, negative-margin and new-patient shares.

    ``fact``, here and in the other branches, are lattice rows with their category.
    """
    f = fact.where(F.col("in_period") & _keep_ta(p) & ~F.col("is_excluded_product")
                   & ~ilike_any("product_name", p.kpi_excluded_products))
    fee = F.lit(p.fee).cast("decimal(10,2)") * F.col("n").cast("decimal(18,0)")
    keys = ["product_name", "brand_vs_generic", "clinic_name", "super_clinic_id", "crm_key", "state", "clinic_ta"]
    # per (group, delivery) flags and partial sums, then counts and sums per group
    by_delivery = distinct_counts_by_flags(
        f, keys, "delivery_id",
        flags={"np_fills": F.col("new_patient"), "neg_gp_fills": F.col("negative")},
        sums={"product_service_fee": sum_if(F.col("has_fee"), fee, F.lit(0).cast("decimal(28,2)")),
              "_profit_sum": F.sum("profit"), "_profit_n": F.sum("profit_n"),
              "_revenue_sum": F.sum("revenue"), "_revenue_n": F.sum("revenue_n")},
        total="total_med_fills")
    patients = f.groupBy(*keys).agg(F.count_distinct("patient_user_id").alias("total_patients"))
    g = join_on_keys(by_delivery, patients, keys)
    g = g.select(
        *keys, F.col("product_service_fee").cast(MONEY_SUM).alias("product_service_fee"), "total_patients",
        "total_med_fills", "np_fills",
        mean_from_parts("_profit_sum", "_profit_n", 3).alias("avg_profit"),
        F.col("_profit_sum").cast(MONEY_SUM).alias("total_profit"),
        mean_from_parts("_revenue_sum", "_revenue_n", 3).alias("avg_revenue"),
        F.col("_revenue_sum").cast(MONEY_SUM).alias("total_revenue"), "neg_gp_fills")
    return (g.withColumn("negative_gp_rate", ratio("neg_gp_fills", "total_med_fills", 6))
             .withColumn("pct_fills_from_nps", ratio("np_fills", "total_med_fills", 6)))


def entity_totals(fact: DataFrame, p: ScorecardParams) -> DataFrame:
    """Profit and revenue per entity with only one product pattern excluded."""
    f = fact.where(F.col("in_period") & _keep_ta(p) & ~F.col("is_excluded_product")
                   & ~F.col("product_name").ilike(p.money_excluded_product))
    return f.groupBy("clinic_name", "super_clinic_id").agg(
        F.sum("profit").cast(MONEY_SUM).alias("total_profit"),
        F.sum("revenue").cast(MONEY_SUM).alias("total_revenue"))


def month_snapshot(fact: DataFrame, p: ScorecardParams) -> DataFrame:
    """One month: totals plus distinct new patients / deliveries of one product pattern."""
    f = fact.where(F.col("in_month") & _keep_ta(p) & ~F.col("is_excluded_product")
                   & ~F.col("product_name").ilike(p.money_excluded_product))
    hit = F.col("product_name").ilike(p.snapshot_pattern)
    keys = ["clinic_name", "super_clinic_id"]
    deliveries = distinct_counts_by_flags(f, keys, "delivery_id", flags={"snapshot_fills": hit},
                                          sums={"_profit": F.sum("profit"), "_revenue": F.sum("revenue")})
    patients = distinct_counts_by_flags(f, keys, "patient_user_id", flags={"snapshot_nps": F.col("new_patient") & hit})
    g = join_on_keys(deliveries, patients, keys)
    return g.select(*keys, "snapshot_nps", "snapshot_fills", F.col("_profit").cast(MONEY_SUM).alias("total_profit"),
                    F.col("_revenue").cast(MONEY_SUM).alias("total_revenue"))


def top_n_share(kpis: DataFrame, keys: Sequence[str] = ("clinic_name", "super_clinic_id"), measure: str = "total_med_fills",
                n: int = 5, tiebreak: Sequence[str] = ("product_name", "brand_vs_generic"), rank: str = "med_rank",
                total: str = "total_vol", share: str = "portion_of_vol") -> DataFrame:
    """The ``n`` rows of each key with the largest measure; the share is of the key's total *before* the cut."""
    # totals as a grouped sum (combined map-side) joined back, not a partition-wide window
    totals = kpis.groupBy(*keys).agg(F.sum(measure).alias(total))
    top = qualify(kpis, list(keys), [(measure, "desc")], F.col(rank) <= n, tiebreak=list(tiebreak), rank_col=rank, keep_rank=True)
    return join_on_keys(top, totals, list(keys)).withColumn(share, ratio(measure, total, 2))


def topn_to_columns(top: DataFrame, keys: Sequence[str] = ("clinic_name", "super_clinic_id"), n: int = 3,
                    values: dict[str, str] | None = None, rank: str = "med_rank") -> DataFrame:
    """The first ``n`` ranks as columns; ``values``: pattern of the column's name (``no_{}_med``) -> column."""
    values = values or {"no_{}_med": "product_name", "no_{}_med_vol": "portion_of_vol"}
    return top.groupBy(*keys).agg(*[F.max(F.when(F.col(rank) == i, F.col(c))).alias(name.format(i))
                                    for i in range(1, n + 1) for name, c in values.items()])


def monthly_new_users(funnels: DataFrame, intakes: DataFrame, clinics: DataFrame, patients: DataFrame,
                      p: ScorecardParams) -> DataFrame:
    """Distinct new users per entity and calendar month inside the funnel window."""
    f = funnels.where(date_window("created_at", *p.funnel_period))
    i = intakes.select(F.col("key").alias("i_key"), F.col("clinic_key").alias("i_clinic_key"))
    j = (f.join(i, F.col("first_intake_key") == F.col("i_key"), "left")
         .join(_clinics(clinics).select("c_key", "super_clinic_id"), F.col("i_clinic_key") == F.col("c_key"), "left")
         .join(_patients(patients).select("pt_key", "first_rx_excluded"),
               F.col("patient_key_d1") == F.col("pt_key"), "left")
         .where(F.col("first_rx_excluded") != F.lit(True)))
    return j.groupBy("super_clinic_id", F.month("created_at").alias("fiscal_month")).agg(
        F.count_distinct("user_id").alias("nps"))


def monthly_pivot(funnels, intakes, clinics, patients, p: ScorecardParams) -> DataFrame:
    """New users per entity with the funnel months as columns."""
    m = monthly_new_users(funnels, intakes, clinics, patients, p)
    return pivot_sum(m, ["super_clinic_id"], "fiscal_month", p.funnel_months, "nps", p.funnel_names)


def product_margin_table(fact: DataFrame, p: ScorecardParams) -> DataFrame:
    """Per product: distinct deliveries, mean margin and total margin; only products above ``min_fills``.

    The window compares the timestamp with the bare end date (so it stops at midnight of
    the last day), unlike the other branches.
    """
    f = fact.where(F.col("in_bound") & ~ilike_any("product_name", p.margin_excluded_products)
                   & ~F.col("is_excluded_product")
                   & F.col("attribution_area").isin(list(p.margin_areas)))
    g = f.groupBy("product_name", "brand_vs_generic", "etc_level_1", "description").agg(
        F.count_distinct("delivery_id").alias("num_fills"), F.sum("profit").alias("_sum"), F.sum("profit_n").alias("_n"))
    g = g.withColumn("avg_gp", mean_from_parts("_sum", "_n", 8)).drop("_sum", "_n")
    g = g.withColumn("total_gp", F.round(F.col("num_fills") * F.col("avg_gp"), 2).cast("decimal(38,2)"))
    return g.where(F.col("num_fills") > p.min_fills)


_BAND_TIE = ["product_name", "brand_vs_generic", "etc_level_1", "description"]


def margin_bands(products_margin: DataFrame, p: ScorecardParams) -> DataFrame:
    """Best n, worst n, and weakest n of the high-volume non-negative products, labelled.

    The kept products are the union of three top-n lists, each a distributed take-ordered
    (every partition keeps its n best rows, only those are merged), so no step ranks all
    products in one task. The label follows the rule order: best list first, then worst,
    then the weak high-volume list. The lists are joined back as broadcasts of at most n
    rows each.
    """
    d = products_margin.withColumn(
        "cat", iff((F.col("total_gp") >= 0) & (F.col("num_fills") > p.band_volume), F.lit("low"), F.lit("other")))
    n = p.band_n
    best = d.orderBy(*total_order([("total_gp", "desc")], _BAND_TIE)).limit(n)
    worst = d.orderBy(*total_order(["total_gp"], _BAND_TIE)).limit(n)
    weak = d.where(F.col("cat") == "low").orderBy(*total_order(["total_gp"], _BAND_TIE)).limit(n)

    def member(top: DataFrame, flag: str) -> DataFrame:
        return top.select(*[F.col(c).alias(f"{flag}_{c}") for c in _BAND_TIE], F.lit(True).alias(flag))

    out = d
    for top, flag in ((best, "_best"), (worst, "_worst"), (weak, "_weak")):
        cond = None
        for c in _BAND_TIE:
            e = F.col(c).eqNullSafe(F.col(f"{flag}_{c}"))
            cond = e if cond is None else cond & e
        out = out.join(F.broadcast(member(top, flag)), cond, "left").drop(*[f"{flag}_{c}" for c in _BAND_TIE])
    label = (F.when(F.col("_best"), HIGH_BAND).when(F.col("_worst"), NEGATIVE_BAND)
             .when(F.col("_weak"), LOW_BAND).otherwise(OTHER_BAND))
    keep = F.col("_best").isNotNull() | F.col("_worst").isNotNull() | F.col("_weak").isNotNull()
    return out.where(keep).withColumn("med_gp_category", label).drop("_best", "_worst", "_weak")


def band_mix(fact: DataFrame, bands: DataFrame, p: ScorecardParams) -> DataFrame:
    """Distinct deliveries per entity in each band (unmatched products count as Other), with shares."""
    f = fact.where(F.col("in_period") & ~ilike_any("product_name", p.margin_excluded_products)
                   & ~F.col("is_excluded_product"))
    b = bands.select(F.col("product_name").alias("b_product_name"), "med_gp_category")
    j = f.join(b, F.col("product_name") == F.col("b_product_name"), "left")
    cat = F.col("med_gp_category")
    g = distinct_counts_by_flags(
        j, ["super_clinic_id", "clinic_name", "clinic_ta"], "delivery_id",
        flags={"num_high_gp_med_fills": cat == HIGH_BAND, "num_neg_gp_med_fills": cat == NEGATIVE_BAND,
               "num_low_gp_med_fills": cat == LOW_BAND,
               "num_other_fills": F.coalesce(cat, F.lit(OTHER_BAND)) == OTHER_BAND},
        total="total_deliveries")
    for name, num in (("high_gp_med_fill_pct", "num_high_gp_med_fills"), ("low_gp_med_fill_pct", "num_low_gp_med_fills"),
                      ("neg_gp_med_fill_pct", "num_neg_gp_med_fills"), ("other_fill_pct", "num_other_fills")):
        g = g.withColumn(name, ratio(num, "total_deliveries", 6))
    return g.where(_keep_ta(p))


def basket_size(rx_groups: DataFrame, intakes: DataFrame, clinics: DataFrame, p: ScorecardParams) -> DataFrame:
    """Mean net basket (items minus excluded groups) of new users per entity, net > 0 only."""
    net = (F.col("num_rx_14d") - F.col("num_excluded_rx_14d")
           - F.col("num_group_a_rx_14d") - F.col("num_group_b_rx_14d"))
    r = rx_groups.where((net > 0) & date_window("first_prescription_created_at", *p.period)).withColumn("net", net)
    i = intakes.select(F.col("user_id").alias("i_user_id"), F.col("clinic_key").alias("i_clinic_key"),
                       F.col("patient_key").alias("i_patient_key"))
    j = (r.join(i, F.col("user_id") == F.col("i_user_id"), "left")
         .join(_clinics(clinics).select("c_key", "super_clinic_id"), F.col("i_clinic_key") == F.col("c_key"), "left"))
    return j.groupBy("super_clinic_id").agg(
        F.count_distinct("i_patient_key").alias("patient_count"),
        F.round(F.avg(F.col("net").cast("decimal(18,0)")), 1).cast("decimal(38,1)").alias("avg_basket_size"))


def entity_rollup(kpis: DataFrame, p: ScorecardParams) -> DataFrame:
    """Re-aggregate the (product, entity) rows per entity.

    ``total_patient_cnt`` sums per-product distinct counts, so a patient with several
    products is counted once per product (it is not a distinct patient total).
    """
    g = kpis.groupBy("clinic_name", "super_clinic_id", "state").agg(
        F.sum("total_profit").cast(MONEY_SUM).alias("total_gp"),
        F.sum("total_revenue").cast(MONEY_SUM).alias("total_rev"),
        F.sum("total_med_fills").alias("total_fills"),
        F.sum("total_patients").alias("total_patient_cnt"),
        F.sum("neg_gp_fills").alias("negative_gp_fills"),
        F.sum("np_fills").alias("np_fills"),
        sum_if(F.col("brand_vs_generic") == p.generic_value, F.col("total_med_fills"), 0).alias("generic_mix"),
        listagg("clinic_ta", ", ", distinct=True).alias("therapeutic_area"))
    return (g.withColumn("overall_negative_gp_rate", ratio("negative_gp_fills", "total_fills", 4))
             .withColumn("pct_generic", ratio("generic_mix", "total_fills", 4)))


def account_key(accounts: DataFrame):
    """CRM id: first of the two strict integer casts, then a lenient parse of the third id."""
    return F.coalesce(F.col("crm_id_a").cast("int"), F.col("crm_id_b").cast("int"),
                      F.col("crm_id_c").try_cast("int"))


def crm_attribute_match(kpis: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct ownership labels of the CRM accounts whose id matches the entity's id.

    Both sides are reduced to distinct (key, value) pairs first; with a distinct list at
    the end this gives the same result as joining every row, at a fraction of the rows.
    """
    ents = kpis.select("super_clinic_id", F.col("crm_key").cast("int").alias("w_id")).distinct()
    acc = accounts.select(account_key(accounts).alias("a_id"),
                          F.coalesce("ownership_type_a", "ownership_type_b").alias("owner")).distinct()
    j = ents.join(acc, F.col("w_id") == F.col("a_id"), "left")
    return j.groupBy("super_clinic_id").agg(listagg("owner", ", ", distinct=True).alias("ownership_type"))


def stage_history(status: DataFrame, clinics: DataFrame, p: ScorecardParams) -> DataFrame:
    """Per entity and year: month-stage list, highest stage (label), any-true flags.

    Status rows are reduced to one row per (entity, owner, market, month) before they meet
    the clinic rows of the entity, so the join pairs months with names instead of every
    status row with every name. The month-level filter (first prescription on or before
    the month) and the distinct list / max aggregates make this exact.
    """
    stage = F.concat(F.month("fiscal_month").cast("string"), F.lit(" - "),
                     iff(F.col("funnel_stage").isNull(), F.lit(CHURNED), F.col("funnel_stage")))
    months = (status.where(F.year("fiscal_month") == p.status_year)
              .groupBy("super_clinic_id", "owner_name", "market", "fiscal_month")
              .agg(F.collect_set(stage).alias("_stages"),
                   F.max("funnel_stage_index").alias("_idx"),
                   F.max("has_tia").alias("_tia"), F.max("has_ehr_access").alias("_ehr"),
                   F.max("has_connect").alias("_connect")))
    c = _clinics(clinics).select(F.col("super_clinic_id").alias("c_super_clinic_id"), "c_clinic_name", "pm",
                                 "first_prescription_created_at")
    j = (months.join(c, F.col("super_clinic_id") == F.col("c_super_clinic_id"), "left")
         .where(F.col("first_prescription_created_at").cast("date") <= month_start("fiscal_month")))
    g = j.groupBy("super_clinic_id", "owner_name", "pm", "market",
                  F.lower("c_clinic_name").alias("clinic_name")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_stages")))).alias("_all"),
        F.max("_idx").alias("highest_stage_reached_int"),
        F.max("_tia").alias("has_tia"),
        F.max("_ehr").alias("granted_ehr_access"),
        F.max("_connect").alias("connect_enabled"))
    g = g.withColumn("stage_hist", F.when(F.size("_all") > 0, F.array_join("_all", ", "))).drop("_all")
    label = F.lit(CHURNED)
    for idx, name in reversed(p.stage_labels):
        label = F.when(F.col("highest_stage_reached_int") == idx, name).otherwise(label)
    return g.withColumn("highest_stage_reached", label)


def kth_latest_stage(status: DataFrame, p: ScorecardParams) -> DataFrame:
    """Stage label k months back per (entity, name); missing label -> 'none'."""
    s = status.select("super_clinic_id", "fiscal_month", F.col("clinic_name").alias("s_clinic_name"),
                      F.lower("clinic_name").alias("clinic_name"),
                      F.coalesce("funnel_stage", F.lit("none")).alias("stage_label"))
    out = qualify(s, ["super_clinic_id", "s_clinic_name"], [("fiscal_month", "desc")], p.kth_stage,
                  tiebreak=["stage_label"])
    return out.drop("s_clinic_name")


# ----------------------------------------------------------------------------- pipeline
@dataclass
class ScorecardParts:
    clinic_ta: DataFrame
    fact: DataFrame
    kpis: DataFrame
    money: DataFrame
    snapshot: DataFrame
    top: DataFrame
    top_cols: DataFrame
    pivot: DataFrame
    product_margin: DataFrame
    bands: DataFrame
    mix: DataFrame
    basket: DataFrame
    rollup: DataFrame
    crm: DataFrame
    sales: DataFrame
    stages: DataFrame


def build_parts(t, p: ScorecardParams = ScorecardParams(), persist: bool = True) -> ScorecardParts:
    """All intermediate frames; ``t[name]`` gives an input DataFrame."""
    lattice = fact_lattice(t["fills"], t["products"], t["clinics"], t["patients"], p, persist)
    ta = dominant_category(lattice)
    if persist:
        ta = staged(ta, "dominant-category")       # one row an entity, read by every branch
    fact = with_category(lattice, ta)
    kpis = product_entity_kpis(fact, p)
    if persist:
        # one row per (product, entity), read by four branches
        kpis = staged(kpis, "kpis")
    top = top_n_share(kpis, n=p.top_n)
    pm = product_margin_table(fact, p)
    if persist:
        # one row per product, read by the three top-n lists and the labelling join
        pm = staged(pm, "product-margin")
    bands = margin_bands(pm, p)
    return ScorecardParts(
        clinic_ta=ta, fact=fact, kpis=kpis, money=entity_totals(fact, p), snapshot=month_snapshot(fact, p),
        top=top, top_cols=topn_to_columns(top, n=p.top_columns),
        pivot=monthly_pivot(t["funnels"], t["intakes"], t["clinics"], t["patients"], p),
        product_margin=pm, bands=bands, mix=band_mix(fact, bands, p),
        basket=basket_size(t["rx_groups"], t["intakes"], t["clinics"], p),
        rollup=entity_rollup(kpis, p), crm=crm_attribute_match(kpis, t["accounts"]),
        sales=stage_history(t["clinic_status"], t["clinics"], p), stages=kth_latest_stage(t["clinic_status"], p))


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    r = right.select(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns])
    cond = None
    for k in keys:
        e = F.col(k) == F.col(f"{prefix}{k}")
        cond = e if cond is None else cond & e
    return left.join(r, cond, "left")


def entity_scorecard(t, p: ScorecardParams = ScorecardParams(), parts: ScorecardParts | None = None) -> DataFrame:
    """The scorecard: one row per (entity, name) of the rollup, branch columns left-joined.

    The k-th stage is joined on the entity id alone, so an entity with several names gets
    one row per name combination (kept as specified).
    """
    s = parts or build_parts(t, p)
    e2 = ["super_clinic_id", "clinic_name"]
    j = s.rollup
    j = _join(j, s.basket, ["super_clinic_id"], "b_")
    j = _join(j, s.top_cols, e2, "m_")
    j = _join(j, s.mix, e2, "g_")
    j = _join(j, s.sales, e2, "s_")
    j = _join(j, s.stages, ["super_clinic_id"], "st_")
    j = _join(j, s.pivot, ["super_clinic_id"], "n_")
    j = _join(j, s.crm, ["super_clinic_id"], "sf_")
    j = _join(j, s.money, e2, "mw_")
    j = _join(j, s.snapshot, e2, "j_")
    cols = [
        F.col("super_clinic_id"), F.col("clinic_name"), F.col("therapeutic_area"), F.col("state"),
        F.col("total_gp").alias("h2_gp"), F.col("total_rev").alias("h2_rev"),
        F.col("total_patient_cnt").alias("h2_pts_served"), F.col("total_fills").alias("h2_fills"),
        F.col("np_fills"), F.col("negative_gp_fills").alias("h2_neg_gp_fills"),
        F.col("overall_negative_gp_rate").alias("h2_neg_gp_pct_fills"),
        F.col("pct_generic").alias("h2_generic_pct_fills"),
        ratio("np_fills", "total_fills", 6).alias("h2_pct_np_fills"),
        F.col("b_avg_basket_size").alias("avg_basket_size"),
    ]
    for i in range(1, p.top_columns + 1):
        cols += [F.col(f"m_no_{i}_med").alias(f"no_{i}_med"), F.col(f"m_no_{i}_med_vol").alias(f"no_{i}_med_vol")]
    cols += [F.col(f"g_{c}").alias(c) for c in (
        "num_high_gp_med_fills", "num_low_gp_med_fills", "num_neg_gp_med_fills", "num_other_fills",
        "high_gp_med_fill_pct", "low_gp_med_fill_pct", "neg_gp_med_fill_pct", "other_fill_pct")]
    cols += [
        F.col("s_owner_name").alias("owner_name"), F.col("sf_ownership_type").alias("ownership_type"),
        F.col("s_pm").alias("pm"), F.col("s_market").alias("market"), F.col("s_stage_hist").alias("stage_hist"),
        F.col("s_highest_stage_reached").alias("highest_stage_in_year"), F.col("st_stage_label").alias("kth_stage"),
        F.col("s_has_tia").alias("has_tia"), F.col("s_granted_ehr_access").alias("granted_ehr_access"),
        F.col("s_connect_enabled").alias("connect_enabled"),
    ]
    cols += [F.col(f"n_{n}").alias(n) for n in p.funnel_names]
    cols += [
        F.col("mw_total_profit").alias("gp_all_products"), F.col("mw_total_revenue").alias("rev_all_products"),
        F.col("j_total_revenue").alias("month_rev"), F.col("j_total_profit").alias("month_gp"),
        F.col("j_snapshot_fills").alias("month_snapshot_fills"), F.col("j_snapshot_nps").alias("month_snapshot_nps"),
    ]
    return j.select(*cols).orderBy(desc("h2_rev"), asc("super_clinic_id"), asc("clinic_name"))
