"""Margin expression shared by the scorecard steps.

    revenue = base + sum(coalesce(plus_i, 0)) - sum(coalesce(minus_i, 0))
    profit  = revenue - (cost - coalesce(rebate, 0))

A NULL ``base`` or ``cost`` keeps the result NULL (only the adjustment terms default to 0).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsmetrics.functions.semantics import MONEY, col


@dataclass(frozen=True)
class MarginTerms:
    base: str = "base_revenue"
    plus: Sequence[str] = field(default=("revenue_adjustment_a", "revenue_adjustment_b"))
    minus: Sequence[str] = field(default=("revenue_deduction",))
    cost: str = "cost_of_goods"
    rebate: str = "cost_rebate"


def _z(c: str) -> Column:
    return F.coalesce(col(c), F.lit(0).cast(MONEY))


def revenue(t: MarginTerms = MarginTerms()) -> Column:
    out = col(t.base)
    for p in t.plus:
        out = out + _z(p)
    for m in t.minus:
        out = out - _z(m)
    return out


def profit(t: MarginTerms = MarginTerms()) -> Column:
    return revenue(t) - (col(t.cost) - _z(t.rebate))
