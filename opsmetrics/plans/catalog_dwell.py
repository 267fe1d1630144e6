"""Dwell-time queries bound to the test tables (see ``sources.fixtures``)."""

from __future__ import annotations

from opsmetrics.plans import dwell as D
from opsmetrics.sources.fixtures import Inputs

# fixed values of the fixture mapping: received = 'view', put-away = 'click' / 'purchase'
SINCE = "2024-01-01"
START = ["view"]
END = ["click", "purchase"]


def _log(spark, root):
    return Inputs(spark, root)["scan_log"]


def pipe_dwell_time(spark, root):
    return D.dwell_time(_log(spark, root), START, END, END, START, since=SINCE)


def job_dwell_split_buckets(spark, root):
    """The full job over 64 ranges, so that many items' windows cross range edges; same result
    as ``pipe_dwell_time``."""
    return D.dwell_time(_log(spark, root), START, END, END, START, since=SINCE, partitions=64)


def job_dwell_hot_items(spark, root):
    """The full job over 200 ranges: more ranges than items, so the busiest items fill several;
    same result as ``pipe_dwell_time``."""
    return D.dwell_time(_log(spark, root), START, END, END, START, since=SINCE, partitions=200)


def _sets(spark, root):
    return D.event_sets(_log(spark, root), START, END, since=SINCE)


def job_annotate(spark, root):
    return D.annotated(_sets(spark, root))


def job_prune_events(spark, root):
    return D.pruned(_sets(spark, root))


def job_drop_unclosed(spark, root):
    return D.closed(_sets(spark, root))


def job_pair_events(spark, root):
    return D.paired(_sets(spark, root), END, START)


QUERIES = {
    "pipe_dwell_time": pipe_dwell_time,
    "job_dwell_split_buckets": job_dwell_split_buckets,
    "job_dwell_hot_items": job_dwell_hot_items,
    "job_annotate": job_annotate,
    "job_prune_events": job_prune_events,
    "job_drop_unclosed": job_drop_unclosed,
    "job_pair_events": job_pair_events,
}
