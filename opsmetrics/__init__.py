"""opsmetrics: parameterised Spark DataFrame jobs for operational analytics.

Three job families, each a plain function ``DataFrame(s) -> DataFrame``:

* ``plans.dwell``        - days between paired scan events of one item (dwell time)
* ``plans.scorecard``    - one KPI row per entity from a star schema
* ``plans.replacements`` - item-level replacement table, barcode chain resolution,
                           rule-based text labels, latest-record lookups

Helpers live in ``functions`` (Column expressions), ``operators`` (DataFrame
building blocks: windows, aggregates, joins, chain walk) and ``sources``
(table loading and the mapping of the driver's tables onto each job's inputs).
"""

from opsmetrics.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
