"""Column helpers that pin down the rules SQL dialects leave open.

* NULL placement in sorts is always written out (``asc_nulls_last`` / ``desc_nulls_first``:
  NULL counts as the largest value).
* Ranks get a full tie-break so results do not depend on partitioning.
* Money is exact decimal; ratios are decimal quotients rounded half-up.
* Day differences are calendar days.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
MONEY_SUM = "decimal(38,4)"
COUNT_DEC = "decimal(20,0)"

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def asc(c: ColumnOrName) -> Column:
    """Ascending, NULL last (NULL is the largest value)."""
    return col(c).asc_nulls_last()


def desc(c: ColumnOrName) -> Column:
    """Descending, NULL first (NULL is the largest value)."""
    return col(c).desc_nulls_first()


def order_spec(*keys: ColumnOrName | tuple[ColumnOrName, str]) -> list[Column]:
    """``order_spec("a", ("b", "desc"))`` -> sort columns with explicit NULL placement."""
    out = []
    for k in keys:
        if isinstance(k, tuple):
            c, d = k
            out.append(desc(c) if d.lower() == "desc" else asc(c))
        elif isinstance(k, Column):
            out.append(k)
        else:
            out.append(asc(k))
    return out


def money(c: ColumnOrName) -> Column:
    return col(c).cast(MONEY)


def iff(cond: Column, a, b) -> Column:
    """``iff(c, a, b)``: a when c is true, b when c is false **or NULL**."""
    return F.when(cond, a).otherwise(b)


def ratio(num: ColumnOrName, den: ColumnOrName, digits: int | None = None) -> Column:
    """num / den as an exact decimal quotient, optionally rounded half-up.

    Counts are cast to decimal so the quotient never passes through a double; a zero
    divisor gives NULL instead of an error.
    """
    q = F.try_divide(col(num).cast(COUNT_DEC), col(den).cast(COUNT_DEC))
    if digits is None:
        return q
    return F.round(q, digits).cast(f"decimal(38,{digits})")


def parse_int(c: ColumnOrName) -> Column:
    """``try_cast(text as int)``: NULL when the text is not an integer (``'38.5'`` -> NULL)."""
    return col(c).try_cast("int")


def month_start(c: ColumnOrName) -> Column:
    """``date_trunc('month', x)`` as a DATE (not a zoned timestamp)."""
    return F.trunc(col(c).cast("date"), "MM")


def day_diff(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Calendar days from start to end (23:00 -> 01:00 next day = 1)."""
    return F.datediff(col(end).cast("date"), col(start).cast("date"))


def date_window(c: ColumnOrName, first, last) -> Column:
    """``x::date between first and last`` written as a half-open range on x itself.

    The range form keeps the predicate on the raw column, so it reaches the Parquet scan
    (PushedFilters) instead of being evaluated after a per-row cast.
    """
    x = col(c)
    lo = F.lit(first).cast("date")
    hi = F.date_add(F.lit(last).cast("date"), 1)
    return (x >= lo.cast("timestamp_ntz")) & (x < hi.cast("timestamp_ntz"))


def ilike_any(c: ColumnOrName, patterns: Iterable[str]) -> Column:
    """``x ilike any (p1, p2, ...)``; NULL x -> NULL."""
    x = col(c)
    pats = list(patterns)
    if not pats:
        return F.lit(False)
    out = x.ilike(pats[0])
    for p in pats[1:]:
        out = out | x.ilike(p)
    return out


def concat_text(*parts: ColumnOrName) -> Column:
    """``a || b || ...``: numbers become text, any NULL part makes the result NULL."""
    return F.concat(*[col(p).cast("string") for p in parts])


def total_order(keys: Sequence[ColumnOrName | tuple[ColumnOrName, str]],
                tiebreak: Sequence[str] = ()) -> list[Column]:
    """Sort keys followed by ascending tie-break columns, so every rank is deterministic."""
    return order_spec(*keys) + [asc(t) for t in tiebreak]


def mean_from_parts(total: ColumnOrName, count: ColumnOrName, digits: int) -> Column:
    """``round(avg(x), digits)`` for a decimal x with scale 4, from ``sum(x)`` and ``count(x)``.

    Same steps as Spark's ``avg`` on decimal(p,4): the quotient is rounded half-up to 8
    places, then to ``digits``.
    """
    q = F.try_divide(col(total).cast("decimal(28,4)"), col(count).cast(COUNT_DEC))
    return F.round(F.round(q, 8), digits).cast(f"decimal(38,{digits})")
