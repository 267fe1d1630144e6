"""Replacement-table steps on hand-made rows."""

import datetime as dt

from opsmetrics.plans.replacements import match_replacements

PARENT_COLS = ("user_id long, event_id long, event_date date, order_id long, hu_id string, fifo_date date, "
               "age int, has_showroom_appointment boolean, showroom_group_name string, "
               "order_had_sku_sellout boolean, tailor_comments string, has_tailoring boolean, sku_code string, "
               "sku_size string, sku_fit string, sku_length string, og_key long, shipment_date date, "
               "version_name string, compatibility_group_name string, product_category_name string, "
               "shipment_type_name string, product_style_name string, product_style_code string, "
               "delivery_unsuccessful boolean, uid string, cleaner int")
CHILD_COLS = ("user_id long, event_id long, order_id long, shipment_date date, shipping_reference_code string, "
              "parent_order_id long, sku_code string, sku_size string, sku_length string, sku_fit string, "
              "replace_tailoring string, sku_category_name string, product_style_name string, "
              "product_style_code string, version_name string, compatibility_group_name string, uid string, "
              "nxt_replace_size string, nxt_replace_length string")


def _parent(uid, hu, cleaner, day, size="40"):
    d = dt.date(2001, 1, day)
    return (1, 2, d, 10, hu, d, 5, False, None, False, None, False, "rod", size, "slim", "32", 10, d,
            "v", "cg", "rod", "ship", "STD rod", "STD", False, uid, cleaner)


def test_left_side_condition_in_on_keeps_rows_and_suppresses_match(spark):
    parents = spark.createDataFrame([_parent("10STDa", "a", 1, 1), _parent("10STDb", "b", 2, 2, size="38R")],
                                    PARENT_COLS)
    child = spark.createDataFrame([(1, 2, 1001, dt.date(2001, 2, 1), "10", 10, "rod", "42", "32", "slim", None,
                                    "x", "STD rod", "STD", "v", "cg", "10STDc", None, None)], CHILD_COLS)
    got = {r.uid: (r.replacement, r.has_replacement, r.size_num_change, r.no_change_replacement, r.oc)
           for r in match_replacements(parents, child).collect()}
    # only the first parent row of the (order, style) pair can match; the other row stays, unmatched
    assert got == {"10STDa": (1001, True, 2, True, 1), "10STDb": (None, False, None, False, 1)}


def test_vendor_names_are_looked_up_for_the_newest_rows_only(spark):
    """All delivery rows used to be joined with the purchases."""
    from opsmetrics.plans.replacements import latest_purchase
    day = dt.date(2001, 1, 1)
    detail = spark.createDataFrame([("h1", "i1", "a1", "l", "p1", "s1"), ("h1", "i2", "a2", "l", "p1", "s2"), ("h2", "i1", "a1", "l", None, "s3"),
                                    ("h3", "i3", "a1", "l", "p3", "s4")],
                                   "hu_id string, item_number string, asn_number string, lot_number string, po_number string, serial_number string")
    master = spark.createDataFrame([("a1", "v1", day), ("a2", "v2", None)], "asn_number string, vendor_code string, delivery_date date")
    purchases = spark.createDataFrame([("p1", "v2", "i2", "B"), ("p1", "v2", "i2", "A"), ("p1", "v2", "i2", None), ("p1", "v1", "i1", "C"),
                                       ("p3", "v1", "i3", None)], "purchase_id string, vendor_id string, sku_code string, vendor_name string")
    got = latest_purchase(detail, master, purchases)
    assert {r.hu_id: (r.rfid, r.vendor_code, r.vendor_name) for r in got.collect()} == {
        "h1": ("s2", "v2", "A"), "h2": ("s3", "v1", None), "h3": ("s4", "v1", None)}
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("v_po") < text.index("min(struct")        # the join is above the aggregate of the deliveries
