"""Join building blocks: outer joins with many NULL keys, aggregation below a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.operators.aggregates import join_on_keys

#: NULL keys are dealt over so many values.
SALTS = 1024


def spread_nulls(df: DataFrame, keys: Sequence[str], name: str = "_spread", salts: int = SALTS) -> DataFrame:
    """Adds a number that is 0 where all keys are set, and otherwise a hash of the row's other columns."""
    others = [c for c in df.columns if c not in keys] or list(keys)
    null = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    return df.withColumn(name, F.when(null, F.pmod(F.xxhash64(*others), F.lit(salts)) + 1).otherwise(F.lit(0)))


def left_join_spread(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], spread: str = "_spread",
                     more: Column | None = None) -> DataFrame:
    """Left join on ``(left, right)`` column names; left rows with a NULL key meet nothing and are spread.

    A NULL key matches nothing, yet a plain outer join sends all rows that have one to the same task. Here the exchange
    also hashes the column that ``spread_nulls`` made (0 for every row with a key, and for every right
    row), so these rows go everywhere in one pass over the left side. Joins on the same columns and the same
    spread column share their exchange. ``more``: a further condition.
    """
    r = right.withColumn("_right_spread", F.lit(0).cast("bigint"))
    cond = F.col(spread).cast("bigint") == F.col("_right_spread")
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    return left.join(r, cond if more is None else cond & more, "left").drop("_right_spread")


def join_counts(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], group: Sequence[str],
                distinct: Sequence[str], rows: str = "rows", how: str = "left") -> DataFrame:
    """``select group, count(distinct d) for each d, count(*) from left join right group by group``, eagerly.

    ``group`` are columns of the left side, ``distinct`` of either. Both sides are first reduced to one row for
    each combination of the columns that matter, with its number of rows; the join multiplies these numbers, so
    it never makes more rows than there are different combinations. Distinct counts don't see
    multiplicities, and the number of joined rows is the sum of the products. At least one group and one distinct column.
    """
    ours = [c for c in left.columns if c in {*group, *distinct, *(a for a, _ in on)}]
    theirs = [c for c in right.columns if c in {*distinct, *(b for _, b in on)}]
    joined = reduced_join(with_multiplicity(left.select(*ours)), with_multiplicity(right.select(*theirs)), on, how)
    # one column at a time, so no row is copied for each distinct count
    out = None
    for d in distinct:
        counts = (joined.groupBy(*group, F.col(d).alias("_d")).agg(F.sum("_m").alias("_m")).groupBy(*group)
                  .agg(F.count("_d").alias(d), *([F.sum("_m").alias(rows)] if out is None else [])))
        out = counts if out is None else join_on_keys(out, counts, group)
    return out.select(*group, *distinct, rows)


def with_multiplicity(df: DataFrame, name: str = "_m") -> DataFrame:
    """The different rows, each with the number of its copies (summed, if the frame has such a column already)."""
    keys = [c for c in df.columns if c != name]
    copies = F.sum(name) if name in df.columns else F.count(F.lit(1))
    return df.groupBy(*keys).agg(copies.alias(name))


def reduced_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "left") -> DataFrame:
    """Joins two frames of ``with_multiplicity``; a row of the result stands for the product of both numbers."""
    r = right.withColumnRenamed("_m", "_rm")
    cond = None
    for a, b in on:
        e = F.col(a) == F.col(b)
        cond = e if cond is None else cond & e
    out = left.join(r, cond, how)
    columns = [c for c in out.columns if c not in ("_m", "_rm")]
    return out.select(*columns, (F.col("_m") * F.coalesce("_rm", F.lit(1))).alias("_m"))
