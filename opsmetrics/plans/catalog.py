"""All registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations


def all_queries():
    from opsmetrics.plans import catalog_dwell, catalog_ops, catalog_replacements, catalog_scorecard
    out = {}
    for mod in (catalog_ops, catalog_dwell, catalog_scorecard, catalog_replacements):
        out.update(mod.QUERIES)
    return out
