"""All oracle SQL by query name."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracle import dwell, ops, replacements, scorecard
    out = {}
    for mod in (ops, dwell, scorecard, replacements):
        out.update(mod.queries())
    return out
