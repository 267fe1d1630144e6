"""Exact decimal rounding for the DuckDB oracle.

DuckDB averages decimals and divides integers in DOUBLE, and rounds doubles differently
from Spark's half-up decimal rounding. These helpers keep the oracle in integer
arithmetic: values are scaled to integers, divided with explicit half-up rounding, and
turned back into decimals of the same type the Spark jobs return.
"""

from __future__ import annotations


def rhu(a: str, b: str) -> str:
    """round(a / b) half away from zero, integers, b > 0."""
    return f"(sign({a}) * ((2 * abs({a}) + ({b})) // (2 * ({b}))))"


def as_dec(q: str, s: int) -> str:
    """Integer q (in units of 10^-s) as decimal(38, s)."""
    if s == 0:
        return f"cast({q} as decimal(38,0))"
    unit = "0." + "0" * (s - 1) + "1"
    return f"cast(cast({q} as decimal({37 - s},0)) * cast({unit} as decimal({s + 1},{s})) as decimal(38,{s}))"


def avg_units(x: str, s_in: int) -> str:
    """Spark ``avg`` of a decimal with scale s_in, as an integer in units of 10^-(s_in+4)."""
    total = f"sum(cast(({x}) * {10 ** s_in} as hugeint))"
    n = f"cast(count({x}) as hugeint)"
    return f"(case when count({x}) = 0 then null else {rhu(f'{total} * 10000', n)} end)"


def avg_round(x: str, s_in: int, digits: int) -> str:
    """``round(avg(x), digits)`` as decimal(38, digits)."""
    return as_dec(rhu(avg_units(x, s_in), str(10 ** (s_in + 4 - digits))), digits)


def ratio(num: str, den: str, digits: int) -> str:
    """round(num / den, digits) half-up for integer counts; NULL when den = 0."""
    q = rhu(f"cast({num} as hugeint) * {10 ** digits}", f"cast({den} as hugeint)")
    return f"(case when ({den}) = 0 then null else {as_dec(q, digits)} end)"
