"""Aggregate building blocks: ordered string lists, conditional distinct counts, pivots.

String lists are built from ``collect_set`` / ``collect_list`` per group; Spark merges
them map-side (partial aggregation) before the shuffle, and a group's list only holds its
*distinct* values when ``distinct=True``. They are meant for low-cardinality attributes
(categories, labels, months); for an unbounded value domain aggregate to counts instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, MapType, NumericType, TimestampNTZType, TimestampType

from opsmetrics.functions.semantics import ColumnOrName, col


def listagg(c: ColumnOrName, sep: str = "", distinct: bool = False) -> Column:
    """``listagg([distinct] x, sep)`` with values in ascending order; no values -> NULL.

    The order is fixed (value order) even where the source dialect leaves it open.
    """
    x = col(c)
    values = F.collect_set(x) if distinct else F.collect_list(x)
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), sep))


def listagg_by_counts(df: DataFrame, keys: Sequence[str], value: str, sep: str = "",
                      alias: str = "listagg") -> DataFrame:
    """Plain (non-distinct) ``listagg(value, sep)`` per key, ordered by value.

    Rows are first counted per (key, value), so a hot key ships one row per distinct value
    through the shuffle instead of one per input row; the list is then rebuilt from the
    (value, count) pairs, which gives the same string as collecting every row.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    pairs = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(),
                                               F.struct(F.col(value).alias("v"), F.col("_n").alias("n")))))
    expanded = F.flatten(F.transform(pairs, lambda x: F.array_repeat(x["v"], x["n"].cast("int"))))
    # a key whose values are all NULL keeps its row, with a NULL list
    return counts.groupBy(*keys).agg(F.when(F.size(pairs) > 0, F.array_join(expanded, sep)).alias(alias))


def count_distinct_if(cond: Column, value: ColumnOrName) -> Column:
    """``count(distinct iff(cond, value, null))``."""
    return F.count_distinct(F.when(cond, col(value)))


def sum_if(cond: Column, value, otherwise=0) -> Column:
    """``sum(iff(cond, value, otherwise))``."""
    v = value if isinstance(value, Column) else F.lit(value)
    o = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.sum(F.when(cond, v).otherwise(o))


def pivot_sum(df: DataFrame, keys: Sequence[str], pivot_col: str, values: Sequence, measure: str,
              names: Sequence[str]) -> DataFrame:
    """``pivot(sum(measure) for pivot_col in (values...)) as t(keys..., names...)``.

    Passing the value list avoids the extra job Spark would run to discover the values.
    """
    out = df.groupBy(*keys).pivot(pivot_col, list(values)).agg(F.sum(measure))
    return out.toDF(*keys, *names)


def ordered_pairs(rank: ColumnOrName, *values: ColumnOrName) -> Column:
    """``array_agg`` of several columns kept together and ordered by ``rank``."""
    return F.array_sort(F.collect_list(F.struct(col(rank).alias("r"), *[col(v) for v in values])))


def distinct_counts_by_flags(df: DataFrame, keys: Sequence[str], id_col: str, flags: dict[str, Column],
                             sums: dict[str, Column] | None = None, total: str | None = None) -> DataFrame:
    """Several ``count(distinct iff(flag, id, null))`` per group without row expansion.

    Rows are first reduced to one row per (group, id) carrying ``max(flag)`` per flag (an id
    counts for a flag when any of its rows has it) and the partial ``sums``; the second step
    counts flagged ids per group and adds the sums up. Equal to the distinct counts, with
    two aggregations instead of one row copy per distinct expression. ``total`` names the
    plain ``count(distinct id)``.
    """
    sums = sums or {}
    level1 = df.groupBy(*keys, id_col).agg(
        *[F.max(c).alias(f"_fl_{n}") for n, c in flags.items()],
        *[c.alias(f"_sm_{n}") for n, c in sums.items()])
    has_id = F.col(id_col).isNotNull()
    out = [F.count(F.when(has_id & F.col(f"_fl_{n}"), 1)).alias(n) for n in flags]
    if total:
        out.append(F.count(F.when(has_id, 1)).alias(total))
    out += [F.sum(f"_sm_{n}").alias(n) for n in sums]
    return level1.groupBy(*keys).agg(*out)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Re-assemble two aggregates of the same groups (NULL group keys match each other)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = e if cond is None else cond & e
    return left.join(r, cond, "inner").drop(*[f"_r_{k}" for k in keys])


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key by ``order`` (names ascending, or ``(name, "desc")``; NULL is the largest
    value), with the given columns: ``qualify row_number() = 1`` as one mergeable aggregate.

    The smallest order struct wins, and takes the columns with it. Every task keeps one row a key, so a key with a
    third of all rows costs no more than another, and nothing is sorted. Structs compare field by field and take
    NULL as the smallest, so each field comes with its NULL flag, and falling ones are turned round: numbers,
    decimals, booleans, dates and times are; a falling text has no opposite and raises. Rows equal in all
    order columns are told apart by the columns themselves. The struct holds every column once. NULL keys are
    a key like others.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    nullable = {f.name for f in df.schema.fields if f.nullable}
    columns = [c for c in (columns if columns is not None else df.columns) if c not in keys]
    fields, at = [], {}                                    # at: where the struct holds a column
    for k, o in enumerate(order):
        name, falling = (o[0], o[1].lower() == "desc") if isinstance(o, tuple) else (o, False)
        null = F.col(name).isNull()
        if name in nullable:
            fields.append((~null if falling else null).alias(f"n{k}"))
        fields.append((_opposite(F.col(name), types[name]) if falling else F.col(name)).alias(f"o{k}"))
        if not falling:
            at.setdefault(name, f"o{k}")
    for k, c in enumerate(columns):
        if c not in at and not isinstance(types[c], MapType):
            fields += [F.col(c).isNull().alias(f"m{k}")] * (c in nullable) + [F.col(c).alias(f"t{k}")]
            at[c] = f"t{k}"
    maps = [c for c in columns if c not in at]             # can't be compared
    if maps:
        row = F.struct(F.struct(*fields).alias("s"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(maps)])
        best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*fields)).alias("_best"))
        return best.select(*keys, *[F.col(f"_best.c{maps.index(c)}" if c in maps else f"_best.s.{at[c]}").alias(c) for c in columns])
    best = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{at[c]}").alias(c) for c in columns])


def _opposite(c: Column, kind) -> Column:
    """A value that sorts the other way round."""
    if isinstance(kind, BooleanType):
        return ~c
    if isinstance(kind, DateType):
        return -F.unix_date(c)
    if isinstance(kind, TimestampType):
        return -F.unix_micros(c)
    if isinstance(kind, TimestampNTZType):
        return -F.unix_micros(F.to_timestamp_ltz(c))
    if isinstance(kind, NumericType):
        return -c
    raise TypeError(f"no falling order for {kind.simpleString()}")


def distinct_bitmaps(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """``(keys, bucket, bitmap)``: the different ids of each key as bitmaps of 32,768 ids.

    Mergeable: ``merge_bitmaps`` rolls them up to fewer keys without the rows they came from, and the counts stay
    exact, which sums of distinct counts are not. Ids are whole numbers, NULL ids count nothing. A bitmap takes
    4 KB however few ids it holds, so this is for ids that are dense within a key's buckets.
    """
    bucket = F.bitmap_bucket_number(F.col(id_col).cast("bigint"))
    rows = df.where(F.col(id_col).isNotNull()).select(*keys, bucket.alias("bucket"),
                                                      F.bitmap_bit_position(F.col(id_col).cast("bigint")).alias("_bit"))
    return rows.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bitmap"))


def merge_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bitmaps of fewer keys."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_counts(bitmaps: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``count(distinct id)`` of each key from its bitmaps."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias(name))
