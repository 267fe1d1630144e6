"""Dwell-time rules on hand-made scan logs (one barcode per rule)."""

import datetime as dt

from opsmetrics.plans.dwell import dwell_time, single_pass

START, END = ["view"], ["click", "purchase"]


def _log(spark, rows):
    return spark.createDataFrame(
        [(i, b, t, t, ts) for i, (b, t, ts) in enumerate(rows)],
        "tran_log_id long, hu_id string, tran_type string, description string, end_tran_date timestamp_ntz")


def _run(spark, rows):
    out = dwell_time(_log(spark, rows), START, END, END, START, partitions=3).collect()
    ref = single_pass(_log(spark, rows), START, END, END, START).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, ref), key=str)
    return sorted((r.barcode, r.description, r.date, r.returned_date, r.d2s) for r in out)


def d(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_simple_pair(spark):
    assert _run(spark, [("A", "view", d(1)), ("A", "click", d(3))]) == [("A", "click", d(3), d(1), 2)]


def test_put_away_without_return_is_dropped(spark):
    rows = [("B", "click", d(1)), ("B", "view", d(2)), ("B", "purchase", d(5))]
    assert _run(spark, rows) == [("B", "purchase", d(5), d(2), 3)]


def test_lone_scan_gives_nothing(spark):
    assert _run(spark, [("C", "view", d(1))]) == []


def test_repeated_scan_removed(spark):
    rows = [("D", "view", d(1)), ("D", "view", d(2)), ("D", "click", d(4))]
    assert _run(spark, rows) == [("D", "click", d(4), d(1), 3)]


def test_return_without_put_away_dropped(spark):
    rows = [("E", "view", d(1)), ("E", "click", d(2)), ("E", "view", d(6))]
    assert _run(spark, rows) == [("E", "click", d(2), d(1), 1)]


def test_two_put_away_types_in_a_row(spark):
    # the third scan is odd-numbered and last, so it is dropped
    rows = [("F", "view", d(1)), ("F", "click", d(2)), ("F", "purchase", d(3))]
    assert _run(spark, rows) == [("F", "click", d(2), d(1), 1)]


def test_even_set_keeps_second_put_away(spark):
    rows = [("G", "view", d(1)), ("G", "click", d(2)), ("G", "purchase", d(3)), ("G", "view", d(4))]
    assert _run(spark, rows) == [("G", "click", d(2), d(1), 1), ("G", "purchase", d(3), d(2), 1)]


def test_calendar_days_across_midnight(spark):
    rows = [("H", "view", d(1, 23)), ("H", "click", d(2, 1))]
    assert _run(spark, rows) == [("H", "click", d(2, 1), d(1, 23), 1)]


def test_plan_shapes(spark):
    from opsmetrics.plans import dwell as D
    from opsmetrics.plans.catalog_dwell import END, SINCE, START, _log as scan_log
    log = scan_log(spark, "/root/testdata/sf0.001")
    single = D.single_pass(log, START, END, END, START, since=SINCE)
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(hu_id") == 1
    assert "PushedFilters" in plan and "event_type" in plan
    ranged = D.dwell_time(log, START, END, END, START, since=SINCE)
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    # windows over whole rows are keyed by (item, range); item-only windows see summaries
    assert "hashpartitioning(hu_id" in plan and "_rb#" in plan


def _same(spark, log, **options):
    single = single_pass(log, START, END, END, START)
    for n in (1, 4, 16):
        got = dwell_time(log, START, END, END, START, partitions=n)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, single.collect()), key=str)


def test_ranges_match_single_pass(spark):
    import random
    rng = random.Random(3)
    rows = []
    for i in range(400):
        b = rng.choice("PQRS")
        rows.append((b, rng.choice(["view", "view", "click", "purchase", "other"]),
                     dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 7 + rng.randrange(5))))
    _same(spark, _log(spark, rows))


def test_hot_item_within_one_hour_matches_single_pass(spark):
    import random
    rng = random.Random(11)
    rows = []
    for i in range(600):
        b = "HOT" if i % 3 else rng.choice(["c1", "c2", "c3", "c4"])    # one item holds two thirds
        rows.append((b, rng.choice(["view", "click", "purchase", "view"]),
                     dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 5)))
    _same(spark, _log(spark, rows))


def test_null_item_sequence_and_time_match_single_pass(spark):
    rows = [(0, "A", "view", d(1)), (1, "A", "click", None), (2, "A", "view", d(2)), (None, "A", "click", d(4)),
            (4, None, "view", d(1)), (5, None, "purchase", d(3)), (6, "B", "view", None), (7, "B", "click", d(2))]
    log = spark.createDataFrame([(s, b, t, t, ts) for s, b, t, ts in rows],
                                "tran_log_id long, hu_id string, tran_type string, description string, end_tran_date timestamp_ntz")
    _same(spark, log)
