"""Replacement-table queries bound to the test tables (see ``sources.fixtures``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsmetrics.functions.rules import vendor_label
from opsmetrics.operators import chain as C
from opsmetrics.plans import replacements as R
from opsmetrics.session import bound_broadcasts
from opsmetrics.sources.fixtures import Inputs
from opsmetrics.sources.staging import staged

P = R.ReplacementParams()


def _item_inputs(spark, root):
    """Inputs of the queries over shipped items: their views join the products with all lines, several times a query."""
    return Inputs(bound_broadcasts(spark), root)


def pipe_replacements(spark, root):
    return R.replacement_items(_item_inputs(spark, root), P)


def job_latest_per_key(spark, root):
    return R.latest_appointments(Inputs(spark, root)["appointments_report"])


def _parents(t):
    return R.parent_items(t, R.latest_appointments(t["appointments_report"]), P)


def job_parent_items(spark, root):
    return _parents(_item_inputs(spark, root))


def job_first_child(spark, root):
    return R.first_replacement(_item_inputs(spark, root), P)


HOT = R.ReplacementParams(window_ranges=64)


def job_parent_items_hot_keys(spark, root):
    """Parent items ranked over 64 ranges; same result as ``job_parent_items``."""
    t = _item_inputs(spark, root)
    return R.parent_items(t, R.latest_appointments(t["appointments_report"]), HOT)


def job_first_child_hot_keys(spark, root):
    """First replacement with windows over 64 ranges; same result as ``job_first_child``."""
    return R.first_replacement(_item_inputs(spark, root), HOT)


def job_actor_reason(spark, root):
    t = Inputs(spark, root)
    return R.actor_reason(t["size_checks"], R.showroom_associates(t["appointments"], t["staff_users"]),
                          R.care_associates(t["care_staff"], P), P)


def job_latest_survey(spark, root):
    t = _item_inputs(spark, root)
    return R.latest_survey_per_order(job_actor_reason(spark, root), _parents(t))


def job_form_fields(spark, root):
    t = Inputs(spark, root)
    return R.form_fields(t["replacement_forms"], t["product_sets"], R.field_map(spark, P))


def job_form_summary(spark, root):
    return R.form_summary(job_form_fields(spark, root), P)


def _matches(t):
    items = staged(R.shipped_items(t, P), "items")            # read by both kinds
    parents = R.parent_items(t, R.latest_appointments(t["appointments_report"]), P, items)
    return R.match_replacements(parents, R.first_replacement(t, P, items))


def job_match(spark, root):
    return _matches(_item_inputs(spark, root))


def job_latest_purchase(spark, root):
    t = Inputs(spark, root)
    return R.latest_purchase(t["asn_detail"], t["asn_master"], t["purchase_orders"])


def job_edge_union(spark, root):
    t = Inputs(spark, root)
    return C.edge_union(t["scan_live"], t["scan_archive"], P.swap_type)


def pipe_resolve_chain(spark, root):
    t = Inputs(spark, root)
    return R.swap_origins(t["scan_live"], t["scan_archive"], P)


def job_chain_paths(spark, root):
    return C.walk_paths(job_edge_union(spark, root), P.max_hops)


def job_preferences(spark, root):
    return R.preference_list(Inputs(spark, root)["version_prefs"], P)


def job_classify_text(spark, root):
    t = _item_inputs(spark, root)
    return R.classify_text(_matches(t), t["tickets"], P)


def job_vendor_label(spark, root):
    """Vendor label of each barcode's latest purchase, by vendor code and the item's category."""
    pos = job_latest_purchase(spark, root)
    cats = Inputs(spark, root)["product_sets"].select(
        F.col("product_set_id").cast("string").alias("ps_id"), "product_category_name")
    j = pos.join(cats, F.col("item_number") == F.col("ps_id"), "left")
    return j.select("hu_id", "vendor_code", "product_category_name",
                    vendor_label(F.col("vendor_code"), F.col("product_category_name"), P.vendor_rules)
                    .alias("vendor_names"))


QUERIES = {k: v for k, v in globals().items() if k.startswith(("pipe_", "job_")) and callable(v)}
