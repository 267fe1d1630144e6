"""Item-level replacement table: each shipped item, its first replacement, why, and where it came from.

Inputs (DataFrames, columns as in ``sources.fixtures``): ``shipment_items`` (fact),
``order_dim``, ``host_detail`` (order/item -> barcode), ``stored_items``, ``event_dim``,
``receipts``, ``appointments_report``, ``appointments`` + ``staff_users`` (associates),
``care_staff``, ``size_checks``, ``replacement_forms`` + ``product_sets``, ``asn_detail`` +
``asn_master`` + ``purchase_orders``, ``scan_live`` / ``scan_archive`` (barcode swaps),
``version_prefs`` and ``tickets`` (free text).

Plan shape: every lookup is an equi-join on its natural key; "latest record per key" steps are one
mergeable aggregate (``latest_row``: the smallest order struct takes its columns along, no window); the chain
walk is ``operators.chain``. Both kinds of items are looked up in one frame (``shipped_items``), which the
job writes once. Lookups that only feed a distinct list are reduced to distinct keys before joining.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.functions.rules import REASON_RULES, TextLabeller, TextRule, item_predicates, vendor_label
from opsmetrics.functions.semantics import concat_text, day_diff, iff, parse_int
from opsmetrics.operators.aggregates import latest_row, listagg, listagg_by_counts
from opsmetrics.operators.chain import edge_union, resolve_chain
from opsmetrics.operators.joins import left_join_spread, spread_nulls
from opsmetrics.operators.windows import by_key_or_ranges, qualify, range_row_number, split_neighbours, whole_neighbours
from opsmetrics.sources.staging import staged

@dataclass(frozen=True)
class ReplacementParams:
    as_of: str = "2001-06-01"                     # stands for current_date
    min_event_year: int = 1996
    excluded_shipment_type: str = "%LOW%"
    missing_associate: int = -1001
    missing_name: str = "(Missing)"
    showroom_role: str = "showroom Associate"
    showroom_reason: str = "Showroom Appointment"
    assisted_reasons: tuple[str, ...] = ("Fit Specialist/Admin", "Customer Request")
    excluded_admins: tuple[int, ...] = (1, 2)
    excluded_admin_reason: str = "Fit Specialist/Admin"
    excluded_reason_pattern: str = "%replace%"
    group_pattern: str = "CX"
    # category -> JSON key of the fit description, per field
    body_keys: tuple[tuple[str, str], ...] = (("widget", "k"), ("gear", "seat"), ("bolt", "k"), ("ring", "shirt_body"))
    inseam_keys: tuple[tuple[str, str], ...] = (("widget", "inseam"), ("gear", "k"), ("plate", "k"))
    sizing_keys: tuple[tuple[str, str], ...] = (("widget", "waist"), ("gear", "k"), ("rod", "k"), ("gizmo", "belt"),
                                                ("anvil", "k"), ("ring", "undefined"))
    fine_value: str = "50"
    swap_type: str = "swap"
    max_hops: int = 6
    preferred_version: str = "F"
    request_pattern: str = "%replace%"
    excluded_comment_pattern: str = "%password=%"
    # ranges of the windows per (order, style); the session's shuffle partitions by default
    window_ranges: int | None = None
    reason_rules: tuple[TextRule, ...] = REASON_RULES
    vendor_rules: tuple = field(default=(
        ("V1", ("%gear%",), "Vendor One"),
        ("V2", (), "Vendor Two"),
        ("V3", ("%bolt%", "%ring%"), "Vendor Three"),
        ("V5", (), "Vendor Five"),
    ))


# ----------------------------------------------------------------------------- steps
def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key by ``order``, e.g. ``[("day", "desc"), "name"]``, as one aggregate; see ``latest_row``."""
    return latest_row(rows, keys, order, columns)


def latest_appointments(report: DataFrame) -> DataFrame:
    """Newest kept (not cancelled, not no-show) appointment per (user, event)."""
    kept = report.where((F.col("cancelled_cnt") < 1) & (F.col("no_show_cnt") < 1))
    return latest_per_key(kept, ["user_id", "event_id"], [("showroom_appointment_date", "desc"), "showroom_group_name"],
                          ["showroom_group_name", "showroom_appointment_date"])


def uid(*parts) -> Column:
    """Text key ``a || b || c`` (NULL if any part is NULL)."""
    return concat_text(*parts)


# full tie-break over the parent columns, so "first row" never depends on partitioning
_PARENT_TIE = ["uid", "sku_code", "sku_size", "sku_length", "sku_fit", "tailor_comments", "og_key", "user_id",
               "event_id", "version_name", "compatibility_group_name", "product_category_name",
               "product_style_name", "shipment_type_name", "delivery_unsuccessful", "event_date", "hu_id",
               "fifo_date", "showroom_group_name", "order_had_sku_sellout"]


def kept_events(t, p: ReplacementParams) -> DataFrame:
    """The events in the period: ``e_event_id``, ``event_date``."""
    e = t["event_dim"].select(F.col("event_id").alias("e_event_id"), "event_date")
    return e.where((F.col("event_date") < F.lit(p.as_of).cast("date")) & (F.year("event_date") > p.min_event_year))


def shipped_items(t, p: ReplacementParams, replacements: bool | None = None) -> DataFrame:
    """Shipped items of both kinds (or of one) with barcode, storage and receipt: each looked up once.

    An item that is no replacement is kept only where its event is in the period and its stored row isn't deleted, so
    events come first and deleted stored rows are met by no item (by a replacement they aren't, either). Items without
    a barcode are spread over the tasks of the barcode joins, which share one partitioning.
    """
    i = t["shipment_items"].where((F.col("is_shipment_voided") == F.lit(False)) & (F.col("is_home_try_on") == F.lit(False))
                                  & (F.col("is_replacement") | ~F.col("shipment_type_name").like(p.excluded_shipment_type)))
    e = kept_events(t, p)
    if replacements is None:
        i = (i.join(e, (F.col("e_event_id") == F.col("event_id")) & ~F.col("is_replacement"), "left")
             .where(F.col("is_replacement") | F.col("event_date").isNotNull()))
    elif replacements:
        i = i.where("is_replacement").withColumn("event_date", F.lit(None).cast("date"))
    else:
        i = i.where(F.col("is_replacement") == F.lit(False)).join(e, F.col("e_event_id") == F.col("event_id"), "inner")
    s = t["host_detail"].select(F.col("order_number").alias("s_order"), F.col("item_number").alias("s_item"), F.col("hu_id").alias("code"))
    st = t["stored_items"].where(F.col("is_deleted") == F.lit(False)).select(F.col("hu_id").alias("st_code"), "fifo_date", "is_deleted")
    v = t["receipts"].select(F.col("hu_id").cast("string").alias("v_code"), "vendor_lot_num", "lot_number")
    j = i.join(s, (F.col("s_order") == F.col("shipping_reference_code")) & (F.col("s_item") == F.col("sku_code")),
               "inner" if replacements is False else "left")
    j = spread_nulls(j, ["code"])
    j = left_join_spread(j, st, [("code", "st_code")]).where(F.col("is_replacement") | F.col("is_deleted").isNotNull())
    j = left_join_spread(j, v, [("code", "v_code")])
    return j.select(
        "user_id", "event_id", "event_date", "order_id", "parent_order_id", "shipping_reference_code", "size_check_id", "shipment_date",
        "sku_code", "sku_size", "sku_length", "sku_fit", "tailor_comments", "product_category_name", "product_style_name",
        "product_style_code", "shipment_type_name", "sku_category_name", "is_delivery_canceled", "is_replacement",
        F.col("code").alias("hu_id"), "fifo_date",
        F.coalesce("vendor_lot_num", "version_name").alias("version_name"),
        F.coalesce("lot_number", "compatibility_group_name").alias("compatibility_group_name"))


def parent_items(t, shows: DataFrame, p: ReplacementParams, items: DataFrame | None = None) -> DataFrame:
    """Original (non-replacement) items with barcode, stock age, appointment and lookup attributes.

    What follows from other columns (age, flags, ``uid``) is worked out after the rows are numbered, not stored or exchanged.
    """
    i = (shipped_items(t, p, replacements=False) if items is None else items.where(F.col("is_replacement") == F.lit(False)))
    i = i.alias("i")
    o = t["order_dim"].alias("o")
    sh = shows.alias("sh")
    j = (i.join(o, F.col("o.order_id") == F.col("i.order_id"), "left")
         .join(sh, (F.col("sh.event_id") == F.col("i.event_id")) & (F.col("sh.user_id") == F.col("i.user_id")), "left"))
    rows = j.select(
        *[F.col(f"i.{c}").alias(c) for c in ("user_id", "event_id", "event_date", "order_id", "hu_id", "fifo_date")],
        F.col("sh.showroom_appointment_date").isNotNull().alias("has_showroom_appointment"),
        F.col("sh.showroom_group_name").alias("showroom_group_name"),
        F.col("o.order_had_sku_sellout").alias("order_had_sku_sellout"),
        *[F.col(f"i.{c}").alias(c) for c in ("tailor_comments", "sku_code", "sku_size", "sku_fit", "sku_length")],
        F.col("i.size_check_id").alias("og_key"),
        *[F.col(f"i.{c}").alias(c) for c in ("shipment_date", "version_name", "compatibility_group_name", "product_category_name",
                                             "shipment_type_name", "product_style_name", "product_style_code")],
        F.col("i.is_delivery_canceled").alias("delivery_unsuccessful"))
    # the order||style key is partitioned by its two columns (no text collisions); within a key ``uid`` sorts as its tail
    tail = F.when(F.col("order_id").isNotNull() & F.col("product_style_code").isNotNull(), F.coalesce("hu_id", F.lit("")))
    ranked = range_row_number(rows, ["order_id", "product_style_code"], ["shipment_date", tail.asc_nulls_last(), *_PARENT_TIE[1:]],
                              "cleaner", p.window_ranges)
    return ranked.select(
        "user_id", "event_id", "event_date", "order_id", "hu_id", "fifo_date",
        day_diff(F.col("fifo_date"), F.lit(p.as_of).cast("date")).alias("age"), "has_showroom_appointment",
        "showroom_group_name", "order_had_sku_sellout", "tailor_comments",
        F.col("tailor_comments").isNotNull().alias("has_tailoring"), "sku_code", "sku_size", "sku_fit", "sku_length", "og_key",
        "shipment_date", "version_name", "compatibility_group_name", "product_category_name", "shipment_type_name",
        "product_style_name", "product_style_code", "delivery_unsuccessful",
        uid(F.col("order_id"), F.col("product_style_code"), F.coalesce(F.col("hu_id"), F.lit(""))).alias("uid"), "cleaner")


_CHILD_TIE = ["shipment_date", "sku_code", "sku_size", "sku_length", "sku_fit", "replace_tailoring", "hu_id",
              "version_name", "compatibility_group_name", "user_id", "event_id", "shipping_reference_code",
              "sku_category_name", "product_style_name"]


def first_replacement(t, p: ReplacementParams | None = None, items: DataFrame | None = None) -> DataFrame:
    """First replacement per (parent order, style) with the size/length of the replacement after it.

    ``lead`` sees every replacement row; the first-row filter runs afterwards, on the same exchange. The window of a
    key with many rows runs over ranges of (key, order) with repaired edges, so it is spread.
    """
    p = p or ReplacementParams()
    i = shipped_items(t, p, replacements=True) if items is None else items.where("is_replacement")
    c = i.select(
        "user_id", "event_id", "order_id", "shipment_date", "shipping_reference_code", "parent_order_id", "sku_code", "sku_size",
        "sku_length", "sku_fit", F.col("tailor_comments").alias("replace_tailoring"), "sku_category_name", "product_style_name",
        "product_style_code", "version_name", "compatibility_group_name", "hu_id")
    key = ["parent_order_id", "product_style_code"]
    order = ["shipment_date", "order_id"] + _CHILD_TIE[1:]

    def first(rows: DataFrame) -> DataFrame:
        c = (rows.withColumn("nxt_replace_size", F.col("_next_sl")["sku_size"])
             .withColumn("nxt_replace_length", F.col("_next_sl")["sku_length"]).drop("_prev_sl", "_next_sl"))
        return latest_row(c, key, ["order_id", *_CHILD_TIE])

    def boxed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_sl", F.struct("sku_size", "sku_length"))

    def whole(rows: DataFrame) -> DataFrame:
        return first(whole_neighbours(boxed(rows), key, order, "_sl", "_prev_sl", "_next_sl").drop("_sl"))

    def ranged(rows: DataFrame) -> DataFrame:
        return first(split_neighbours(boxed(rows), key, "_rb", order, "_sl", "_prev_sl", "_next_sl").drop("_sl", "_rb"))
    c = by_key_or_ranges(c, key, order, p.window_ranges, whole, ranged)
    names = [x for x in c.columns if x not in ("hu_id", "nxt_replace_size", "nxt_replace_length")]
    return c.select(*names, uid(F.col("parent_order_id"), F.col("product_style_code"), F.col("hu_id")).alias("uid"),
                    "nxt_replace_size", "nxt_replace_length")


def showroom_associates(appointments: DataFrame, users: DataFrame, p: ReplacementParams | None = None) -> DataFrame:
    """The associates of any appointment, one row for each; reduced to distinct ids before they meet the users."""
    p = p or ReplacementParams()
    ids = appointments.where(F.col("associate_user_id") != p.missing_associate).select("associate_user_id").distinct()
    named = users.where(F.col("user_full_name") != p.missing_name)
    a = ids.join(named, F.col("user_id") == F.col("associate_user_id"), "inner")
    return a.select("associate_user_id", "user_full_name", "user_email", F.lit(p.showroom_role).alias("role")).distinct()


def care_associates(staff: DataFrame, p: ReplacementParams) -> DataFrame:
    site = F.trim("employee_site")
    group = F.coalesce(iff(F.trim("employee_group").like(p.group_pattern),
                           F.concat(F.col("employee_group"), F.lit("-"), site), F.col("employee_group")),
                       F.concat(F.lit(p.group_pattern + "-"), F.col("employee_site")))
    return staff.select("user_id", "employee_full_name", site.alias("site"), group.alias("employee_group"))


def actor_reason(checks: DataFrame, showroom: DataFrame, care: DataFrame, p: ReplacementParams) -> DataFrame:
    """Size checks with a reason label: who performed an assisted check (showroom, care group) or the stated reason."""
    u = checks.alias("u")
    s = showroom.alias("s")
    c = care.alias("c")
    j = (u.join(s, F.col("s.associate_user_id") == F.col("u.admin_user_id"), "left")
         .join(c, F.col("c.user_id") == F.col("u.admin_user_id"), "left"))
    reason = F.col("u.size_check_reason_desc")
    j = j.where(F.col("u.product_category_name").isNotNull()
                & ~(F.col("u.admin_user_id").isin(list(p.excluded_admins)) & reason.like(p.excluded_admin_reason))
                & ~reason.ilike(p.excluded_reason_pattern))
    label = iff(reason.isin(list(p.assisted_reasons)),
                F.when(F.col("s.associate_user_id").isNotNull(), F.lit(p.showroom_reason))
                 .when(F.col("c.user_id").isNotNull(), F.col("c.employee_group"))
                 .otherwise(reason),
                reason)
    return j.select(
        F.col("u.user_id").alias("survey_user"), F.col("u.size_survey_id").alias("size_survey_id"),
        F.col("u.size_check_id").alias("prime_key"), reason.alias("size_check_reason_desc"),
        F.col("u.product_category_name").alias("survey_product_category"),
        F.col("u.is_auto_size_checked").alias("is_auto_size_checked"),
        F.col("u.passed_auto_size_checked").alias("passed_auto_size_checked"),
        F.col("u.predicted_size").alias("predicted_size"), F.col("u.survey_size").alias("survey_size"),
        F.col("u.checked_size").alias("checked_size"), label.alias("survey_reason"),
        F.col("u.size_check_ts").alias("size_check_ts"))


def latest_survey_per_order(surveys: DataFrame, parents: DataFrame) -> DataFrame:
    """Newest size check per (user, category, matched order); checks match orders by size-check key."""
    orders = (parents.select(F.col("og_key").alias("o_og_key"), F.col("order_id").alias("survey_mapped_order"),
                             F.col("event_date").alias("survey_mapped_event_date")).distinct())
    j = (surveys.join(orders, F.col("prime_key") == F.col("o_og_key"), "left")
         .where(F.col("survey_mapped_event_date").isNotNull()).drop("o_og_key"))
    newest = latest_row(j, ["survey_user", "survey_product_category", "survey_mapped_order"],
                        [("size_check_ts", "desc"), "size_survey_id", "size_check_reason_desc", "survey_reason", "predicted_size",
                         "survey_size", "checked_size", "is_auto_size_checked", "passed_auto_size_checked", "prime_key",
                         "survey_mapped_event_date"])
    return newest.select(*j.columns)


FORM_FIELDS = ("item_body", "item_inseams", "item_sizing")


def field_map(spark, p: ReplacementParams = ReplacementParams()) -> DataFrame:
    """``(category, field, path)``: where the form of a category holds each field."""
    maps = zip(FORM_FIELDS, (p.body_keys, p.inseam_keys, p.sizing_keys))
    return spark.createDataFrame([(cat, f, f"$.{key}") for f, keys in maps for cat, key in keys], "category string, field string, path string")


def form_fields(forms: DataFrame, sets: DataFrame, fields: DataFrame, names: Sequence[str] = FORM_FIELDS) -> DataFrame:
    """Replacement forms with the fit-description fields picked by product category.

    ``fields`` is a table (category, field, path), one path per category and field; ``names`` are the fields to return. The
    document is parsed once into a VARIANT, whatever the number of fields and categories; a form's paths come from
    the table, turned to one row a category. Invalid documents and missing paths give NULL.
    """
    s = sets.select(F.col("product_set_id").alias("ps_id"), F.col("product_category_name").alias("f_product_category_name"))
    paths = fields.groupBy("category").agg(*[F.max(F.when(F.col("field") == n, F.col("path"))).alias(f"_p_{n}") for n in names])
    j = (forms.join(s, F.col("product_set_id") == F.col("ps_id"), "left")
         .join(paths, F.col("category") == F.col("f_product_category_name"), "left")
         .withColumn("_doc", F.try_parse_json("fit_description")))
    return j.select(
        F.col("order_id").alias("replacement_form_orders"), "f_product_category_name", "ticket_created_date",
        "ticket_id", "requested_length",
        *[F.try_variant_get("_doc", F.col(f"_p_{n}"), "string").alias(n) for n in names],
        "is_fit_replacement", "is_item_missing_replacement", "is_damaged_replacement", "is_wrong_item_replacement")


def form_summary(fields: DataFrame, p: ReplacementParams) -> DataFrame:
    """Per (order, category): distinct tickets, complaint lists without the 'fine' value, any-flags."""
    def complaint(c):
        return iff(F.col(c).like(p.fine_value), F.lit(""), F.concat(F.lit(","), F.col(c)))
    return fields.groupBy("replacement_form_orders", "f_product_category_name").agg(
        F.count_distinct("ticket_id").alias("forms"),
        listagg(complaint("item_body"), "", distinct=True).alias("filtered_body"),
        listagg(complaint("item_inseams"), "", distinct=True).alias("filtered_inseams"),
        listagg(complaint("item_sizing"), "", distinct=True).alias("filtered_sizing"),
        F.max("is_fit_replacement").alias("fit_issue"),
        F.max("is_item_missing_replacement").alias("item_missing"),
        F.max("is_damaged_replacement").alias("item_damaged"),
        F.max("is_wrong_item_replacement").alias("item_wrong"))


def match_replacements(parents: DataFrame, child: DataFrame) -> DataFrame:
    """Parent items with their first replacement (only the first parent row of an order/style
    can match), change flags and numeric deltas; one row per item key."""
    c = child.select(*[F.col(x).alias(f"c_{x}") for x in child.columns])
    j = parents.join(c, (F.col("c_parent_order_id") == F.col("order_id"))
                     & (F.col("c_product_style_code") == F.col("product_style_code"))
                     & (F.col("cleaner") == 1), "left")
    j = qualify(j, ["uid"], ["shipment_date"], 1, tiebreak=["cleaner"] + _PARENT_TIE[1:], rank_col="oc", keep_rank=True)

    def neq(a, b):
        return iff(F.col(a) != F.col(b), F.lit(True), F.lit(False))
    return j.select(
        *parents.columns, "oc",
        F.col("c_order_id").alias("replacement"), F.col("c_shipment_date").alias("replacement_shipment_date"),
        F.col("c_sku_code").alias("replacement_sku_code"), F.col("c_sku_size").alias("replacement_sku_size"),
        F.col("c_sku_length").alias("replacement_sku_length"), F.col("c_sku_fit").alias("replacement_sku_fit"),
        F.col("c_nxt_replace_length").alias("nxt_replace_length"), F.col("c_nxt_replace_size").alias("nxt_replace_size"),
        F.col("c_replace_tailoring").alias("replace_tailoring"), F.col("c_version_name").alias("replacement_version"),
        F.col("c_compatibility_group_name").alias("replacement_cg"),
        ((parse_int("sku_size") - parse_int("c_sku_size")) * -1).alias("size_num_change"),
        ((parse_int("sku_length") - parse_int("c_sku_length")) * -1).alias("length_num_change"),
        F.col("fifo_date").alias("item_fifo_date"), F.col("age").alias("item_age"),
        iff(F.col("c_order_id").isNotNull(), F.lit(True), F.lit(False)).alias("has_replacement"),
        neq("c_sku_size", "sku_size").alias("size_change"),
        neq("c_sku_length", "sku_length").alias("length_change"),
        neq("c_sku_fit", "sku_fit").alias("fit_change"),
        iff((F.col("c_sku_code") == F.col("sku_code")) & F.col("c_sku_code").isNotNull(), F.lit(True), F.lit(False))
        .alias("no_change_replacement"))


_POS_TIE = ["item_number", "asn_number", "lot_number", "po_number", "vendor_code", "rfid"]


def latest_purchase(detail: DataFrame, master: DataFrame, purchases: DataFrame | None = None) -> DataFrame:
    """Newest delivery (NULL date counts as newest) per barcode with PO and vendor.

    Without ``purchases`` there is no ``vendor_name``. The name follows from the row's order, vendor and item, so only the
    newest rows are looked up; of several names the smallest is taken.
    """
    m = master.select(F.col("asn_number").alias("m_asn"), "vendor_code", "delivery_date")
    r = (detail.join(m, F.col("m_asn") == F.col("asn_number"), "left")
         .select("hu_id", "item_number", "asn_number", "lot_number", "po_number", "vendor_code", "delivery_date",
                 F.col("serial_number").alias("rfid")))
    newest = latest_row(r, ["hu_id"], [("delivery_date", "desc"), *_POS_TIE]).select(*r.columns)
    if purchases is None:
        return newest
    v = (purchases.groupBy(F.col("purchase_id").alias("v_po"), F.col("vendor_id").alias("v_vendor"), F.col("sku_code").alias("v_sku"))
         .agg(F.min("vendor_name").alias("vendor_name")))
    return newest.join(v, (F.col("v_po") == F.col("po_number")) & (F.col("vendor_code") == F.col("v_vendor"))
                       & (F.col("item_number") == F.col("v_sku")), "left").drop("v_po", "v_vendor", "v_sku")


def swap_origins(live: DataFrame, archive: DataFrame, p: ReplacementParams) -> DataFrame:
    """``most_recent_change -> original`` from the swap scans of the live and archive logs."""
    return resolve_chain(edge_union(live, archive, p.swap_type), p.max_hops)


def preference_list(prefs: DataFrame, p: ReplacementParams) -> DataFrame:
    kept = prefs.where(F.col("showroom_preferred_version_name") == p.preferred_version)
    return listagg_by_counts(kept, ["user_id", "product_category_name"], "showroom_preferred_version_name", ",",
                             "showroom_version")


def classify_text(agg: DataFrame, tickets: DataFrame, p: ReplacementParams = ReplacementParams(),
                  rules: Sequence[TextRule] | None = None, conditions: dict[str, Column] | None = None) -> DataFrame:
    """Label each no-change replacement from its order's tickets; the largest label wins.

    ``rules`` (by default those of ``p``) are tried in order; ``conditions`` are the item conditions that they name. Each
    ticket's text is scanned once for the patterns of all rules, before any join, so texts aren't shuffled. The
    label depends on the item only through its conditions, so tickets meet an order's distinct combinations of
    these, not every item.
    """
    labeller = TextLabeller(p.reason_rules if rules is None else rules)
    preds = item_predicates(requested=None) if conditions is None else conditions
    names = sorted({n for r in labeller.rules for n in r.item})
    a = agg.where(F.col("no_change_replacement") == F.lit(True)).select(
        "uid", "sku_code", "product_style_name", "order_id", "user_id",
        *[F.coalesce(preds[n], F.lit(False)).alias(f"_f_{n}") for n in names])
    flags = [f"_f_{n}" for n in names]
    sigs = a.select("order_id", "user_id", *flags).distinct()
    z = (tickets.where(F.col("request_type").ilike(p.request_pattern)
                       & ~F.col("ticket_comments").ilike(p.excluded_comment_pattern))
         .select(F.col("order_id").alias("z_order_id"), F.col("user_id").alias("z_user_id"),
                 F.array_sort(labeller.hits(F.col("ticket_comments"))).alias("_hits")).distinct())
    label = labeller.label(F.col("_hits"), {n: F.col(f"_f_{n}") for n in names})
    labelled = (sigs.join(z, (F.col("z_order_id") == F.col("order_id")) & (F.col("z_user_id") == F.col("user_id")))
                .groupBy("order_id", "user_id", *flags).agg(F.max(label).alias("reason")))
    out = a.join(labelled, ["order_id", "user_id", *flags], "inner")
    return out.groupBy("uid", "sku_code", "product_style_name").agg(F.max("reason").alias("reason"))


def replacement_items(t, p: ReplacementParams = ReplacementParams()) -> DataFrame:
    """Full table: ``match_replacements`` rows plus origin barcode, forms, survey, reason, PO and vendor."""
    items = staged(shipped_items(t, p), "items")                  # read by both kinds
    parents = staged(parent_items(t, latest_appointments(t["appointments_report"]), p, items), "parents")   # read by two branches
    agg = staged(match_replacements(parents, first_replacement(t, p, items)), "matches")
    fields = form_fields(t["replacement_forms"], t["product_sets"], field_map(items.sparkSession, p))
    forms = form_summary(fields, p)
    surveys = actor_reason(t["size_checks"], showroom_associates(t["appointments"], t["staff_users"], p),
                           care_associates(t["care_staff"], p), p)
    joins = latest_survey_per_order(surveys, parents)
    swaps = swap_origins(t["scan_live"], t["scan_archive"], p)
    reasons = classify_text(agg, t["tickets"], p)
    a = (agg.join(swaps, F.col("most_recent_change") == F.col("hu_id"), "left")
         .join(reasons.select(F.col("uid").alias("r_uid"), F.col("reason").alias("no_change_reason")),
               F.col("r_uid") == F.col("uid"), "left")
         .join(forms.alias("f"), (F.col("f.replacement_form_orders") == F.col("order_id"))
               & (F.col("f.f_product_category_name") == F.col("product_category_name")), "left")
         .join(joins.alias("j"), (F.col("j.survey_mapped_order") == F.col("order_id"))
               & (F.col("j.survey_product_category") == F.col("product_category_name")), "left"))
    bar = a.select(
        *[F.col(c) for c in agg.columns],
        F.coalesce(F.col("original"), F.col("hu_id")).alias("barcode_finder"),
        F.col("f.replacement_form_orders").alias("replacement_form_orders"),
        *[F.col(f"f.{c}").alias(c) for c in ("filtered_body", "filtered_inseams", "filtered_sizing", "fit_issue",
                                              "item_missing", "item_damaged", "item_wrong")],
        *[F.col(f"j.{c}").alias(c) for c in ("size_check_reason_desc", "is_auto_size_checked",
                                              "passed_auto_size_checked", "predicted_size", "survey_size",
                                              "checked_size", "survey_reason", "size_check_ts")],
        F.col("no_change_reason"))
    pos = latest_purchase(t["asn_detail"], t["asn_master"]).select(
        F.col("hu_id").alias("b_hu_id"), "po_number", "vendor_code")
    vp = preference_list(t["version_prefs"], p).select(
        F.col("user_id").alias("v_user_id"), F.col("product_category_name").alias("v_category"), "showroom_version")
    out = (bar.join(pos, F.col("b_hu_id") == F.col("barcode_finder"), "left")
           .join(vp, (F.col("v_category") == F.col("product_category_name")) & (F.col("user_id") == F.col("v_user_id")),
                 "left"))
    return out.select(*bar.columns, "showroom_version", "po_number",
                      vendor_label(F.col("vendor_code"), F.col("product_category_name"), p.vendor_rules)
                      .alias("vendor_names"))
