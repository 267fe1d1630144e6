"""Window building blocks: ranks with a full tie-break, QUALIFY-style filters, offsets.

Ranking windows are always partitioned by an entity key so they run as one sorted pass
per hash partition (Spark adds a WindowGroupLimit for ``rank = 1`` / ``rank <= n``). A
rank over *all* rows (no partition) is only used on small per-product aggregates; for a
plain top-N of a large frame use ``top_n_global`` (sort + limit runs as a distributed
take-ordered, never as a single-partition window).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.functions.semantics import ColumnOrName, asc, order_spec, total_order
from opsmetrics.sources.staging import staged

Keys = Sequence[ColumnOrName | tuple[ColumnOrName, str]]


def rank_window(partition: Sequence[ColumnOrName], order: Keys, tiebreak: Sequence[str] = ()):
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return w.orderBy(*total_order(order, tiebreak))


def with_rank(df: DataFrame, name: str, partition: Sequence[ColumnOrName], order: Keys,
              tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add ``row_number()`` as ``name``; ties broken by ``tiebreak`` (ascending, NULL last)."""
    return df.withColumn(name, F.row_number().over(rank_window(partition, order, tiebreak)))


def qualify(df: DataFrame, partition: Sequence[ColumnOrName], order: Keys, keep: Column | int = 1,
            tiebreak: Sequence[str] = (), rank_col: str = "_rn", keep_rank: bool = False) -> DataFrame:
    """``QUALIFY row_number() over (partition by .. order by ..) <pred>``.

    ``keep`` is an int k (rank == k) or a Column predicate over ``rank_col``.
    """
    ranked = with_rank(df, rank_col, partition, order, tiebreak)
    pred = (F.col(rank_col) == keep) if isinstance(keep, int) else keep
    out = ranked.where(pred)
    return out if keep_rank else out.drop(rank_col)


def first_per_key(df: DataFrame, keys: Sequence[ColumnOrName], order: Keys,
                  tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest / first row per key (``qualify rank = 1``)."""
    return qualify(df, keys, order, 1, tiebreak)


def top_n_per_key(df: DataFrame, keys: Sequence[ColumnOrName], order: Keys, n: int,
                  tiebreak: Sequence[str] = (), rank_col: str = "rank") -> DataFrame:
    """Top n rows per key, keeping the rank column."""
    return qualify(df, keys, order, F.col(rank_col) <= n, tiebreak, rank_col, keep_rank=True)


def top_n_global(df: DataFrame, order: Keys, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Top n rows overall: sort + limit (distributed take-ordered)."""
    return df.orderBy(*total_order(order, tiebreak)).limit(n)


# ----------------------------------------------------------------------------- split windows
# Offset and numbering windows over one key are sequential: every row of the key lands in
# one task. Here the rows are range-partitioned on (key, order) instead, so a key with many
# rows fills several ranges, and windowed per (key, range); one summary row per key and
# range repairs the range edges. One plan for every key, whatever its size. NULL keys and
# NULL order values are ordinary values throughout.

def range_bucket(df: DataFrame, key: Sequence[str], order: Keys, name: str = "_rb",
                 partitions: int | None = None) -> DataFrame:
    """Range-partition on (key, order asc nulls last) and tag each row with its range number.

    A key whose rows fill several ranges is spread over several buckets, and bucket numbers
    grow along the order, as ``split_neighbours`` / ``split_row_number`` require. The tagged
    rows are written once (``staged``): ranges come from a sample, and every reader must see
    the same ones.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[asc(k) for k in key], *_sort(order))
    return staged(ranged.withColumn(name, F.spark_partition_id()), "ranges")


def _join_summary(rows: DataFrame, summary: DataFrame, key: Sequence[str], bucket: str) -> DataFrame:
    keys = set(key) | {bucket}
    s = summary.select(*[F.col(c).alias(f"_s_{c}") if c in keys else F.col(c) for c in summary.columns])
    cond = F.col(bucket).eqNullSafe(F.col(f"_s_{bucket}"))
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    out = rows.join(s, cond, "inner")
    return out.drop(*[f"_s_{k}" for k in key], f"_s_{bucket}")


def _sort(order) -> list[Column]:
    return order_spec(*order)


def split_neighbours(df: DataFrame, key: Sequence[str], bucket: str, order: Keys, value: str,
                     prev_name: str, next_name: str | None = None) -> DataFrame:
    """``lag(value)`` / ``lead(value)`` over ``partition by key order by order`` computed per
    (key, bucket). Buckets must follow the order (``range_bucket``). ``order`` items are names
    (ascending) or ``(name, "desc")``. No neighbour -> NULL. ``df`` is read twice (rows, edges),
    so it should be a stored table.
    """
    w = Window.partitionBy(*key, bucket).orderBy(*_sort(order))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    boxed = F.struct(F.col(value).alias("v"))
    out = df.withColumn("_lp", F.lag(boxed).over(w))
    if next_name:
        out = out.withColumn("_ln", F.lead(boxed).over(w))
    ends = (df.withColumn("_bf", F.first(boxed).over(whole)).withColumn("_bl", F.last(boxed).over(whole))
            .groupBy(*key, bucket).agg(F.first("_bl").alias("_last"), F.first("_bf").alias("_first")))
    wb = Window.partitionBy(*key).orderBy(bucket)
    edges = ends.select(*key, bucket, F.lag("_last").over(wb).alias("_bp"), F.lead("_first").over(wb).alias("_bn"))
    out = _join_summary(out, edges, key, bucket)
    out = out.withColumn(prev_name, F.coalesce("_lp", "_bp")["v"])
    if next_name:
        out = out.withColumn(next_name, F.coalesce("_ln", "_bn")["v"])
    return out.drop("_lp", "_ln", "_bp", "_bn")


def split_row_number(df: DataFrame, key: Sequence[str], bucket: str, order: Keys, name: str,
                     total_name: str) -> DataFrame:
    """``row_number() over (partition by key order by order)`` (bigint) and the key's row count,
    numbered per (key, bucket) and offset by the counts of the key's earlier buckets.
    ``df`` feeds both the rows and the counts, so it should be a stored table."""
    w = Window.partitionBy(*key, bucket).orderBy(*_sort(order))
    local = df.withColumn("_lr", F.row_number().over(w))  # same order as the buckets
    counts = df.groupBy(*key, bucket).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, bucket, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                            F.sum("_c").over(Window.partitionBy(*key)).alias(total_name))
    out = _join_summary(local, offsets, key, bucket)
    return out.withColumn(name, F.col("_lr") + F.col("_off")).drop("_lr", "_off")


def hot_keys(rows: DataFrame, key: Sequence[str], partitions: int | None = None) -> DataFrame | None:
    """The keys with more rows than an even range would have, as columns ``_h_<key>``; None if there are none.

    There are fewer of them than ranges, however many keys there are. ``rows`` is a stored table.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, rows.count() / n)
    counts = rows.groupBy(*[F.col(k).alias(f"_h_{k}") for k in key]).agg(F.count(F.lit(1)).alias("_n"))
    hot = staged(counts.where(F.col("_n") > share).drop("_n"), "hot-keys")
    return None if hot.isEmpty() else hot


def by_key_or_ranges(df: DataFrame, key: Sequence[str], order: Keys, partitions: int | None,
                     whole: Callable[[DataFrame], DataFrame], ranged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``whole(rows)`` of the keys that fit a range, united with ``ranged(rows, tagged with _rb)`` of the others.

    Rows are stored once and exchanged once, on the key; only the rows of keys that would fill several ranges
    (``hot_keys``) are cut into ranges of (key, order). Both functions return the same columns.
    """
    rows = staged(df, "window-rows")
    hot = hot_keys(rows, key, partitions)
    if hot is None:
        return whole(rows)
    same = None
    for k in key:
        e = F.col(k).eqNullSafe(F.col(f"_h_{k}"))
        same = e if same is None else same & e
    cold = rows.join(F.broadcast(hot), same, "left_anti")
    spread = range_bucket(rows.join(F.broadcast(hot), same, "left_semi"), key, order, partitions=partitions)
    return whole(cold).unionByName(ranged(spread))


def range_row_number(df: DataFrame, key: Sequence[str], order: Keys, name: str,
                     partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by key order by order asc nulls last)`` (bigint), by ranges where a key is hot."""
    w = Window.partitionBy(*key).orderBy(*_sort(order))

    def whole(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.row_number().over(w).cast("bigint"))

    def ranged(rows: DataFrame) -> DataFrame:
        return split_row_number(rows, key, "_rb", order, name, "_rn_total").drop("_rb", "_rn_total")
    return by_key_or_ranges(df, key, order, partitions, whole, ranged)


def whole_neighbours(df: DataFrame, key: Sequence[str], order: Keys, value: str, prev_name: str,
                     next_name: str | None = None) -> DataFrame:
    """``lag`` / ``lead`` over ``partition by key order by order`` as plain windows."""
    w = Window.partitionBy(*key).orderBy(*_sort(order))
    out = df.withColumn("_lp", F.lag(value).over(w))
    if next_name:
        out = out.withColumn(next_name, F.lead(value).over(w))
    return out.withColumn(prev_name, F.col("_lp")).drop("_lp")


def range_neighbours(df: DataFrame, key: Sequence[str], order: Keys, value: str, prev_name: str,
                     next_name: str | None = None, partitions: int | None = None) -> DataFrame:
    """``lag`` / ``lead`` over ``partition by key order by order``, by ranges where a key is hot."""
    def whole(rows: DataFrame) -> DataFrame:
        return whole_neighbours(rows, key, order, value, prev_name, next_name)

    def ranged(rows: DataFrame) -> DataFrame:
        return split_neighbours(rows, key, "_rb", order, value, prev_name, next_name).drop("_rb")
    return by_key_or_ranges(df, key, order, partitions, whole, ranged)


def global_row_number(df: DataFrame, order: Keys, name: str, tiebreak: Sequence[str] = (),
                      partitions: int | None = None) -> DataFrame:
    """``row_number() over (order by ...)`` over all rows without a single-partition window.

    Rows are range-partitioned on the sort order, numbered inside each range, and offset by
    the row counts of the earlier ranges; that count table has one row per range, so it is
    broadcast with a bound set by the partition count, not by the data.
    """
    sort = total_order(order, tiebreak)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(n, *sort).withColumn("_grb", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("_glr", F.row_number().over(Window.partitionBy("_grb").orderBy(*sort)))
    counts = ranged.groupBy(F.col("_grb").alias("_gcb")).agg(F.count(F.lit(1)).alias("_gc"))
    before = Window.orderBy("_gcb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_gcb", F.coalesce(F.sum("_gc").over(before), F.lit(0)).alias("_goff"))
    out = local.join(F.broadcast(offsets), F.col("_grb") == F.col("_gcb"), "inner")
    return out.withColumn(name, F.col("_glr") + F.col("_goff")).drop("_grb", "_glr", "_gcb", "_goff")


def top_n_members(df: DataFrame, keys: Sequence[str], order: Keys, n: int, flag: str,
                  tiebreak: Sequence[str] = ()) -> DataFrame:
    """Flag the rows that are among the first n by ``order`` (a distributed top-n, joined
    back as a broadcast of at most n keys). ``keys`` identify a row (NULLs match NULLs)."""
    top = df.orderBy(*total_order(order, tiebreak)).limit(n).select(
        *[F.col(k).alias(f"{flag}_{k}") for k in keys], F.lit(True).alias(flag))
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"{flag}_{k}"))
        cond = e if cond is None else cond & e
    out = df.join(F.broadcast(top), cond, "left").drop(*[f"{flag}_{k}" for k in keys])
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def with_partition_total(df: DataFrame, value: ColumnOrName, keys: Sequence[str], name: str) -> DataFrame:
    """``sum(value) over (partition by keys)`` as a column, computed as a grouped sum (combined
    map-side) joined back, so no task holds a whole key's rows. NULL keys form one group."""
    v = F.col(value) if isinstance(value, str) else value
    totals = df.groupBy(*[F.col(k).alias(f"_pt_{k}") for k in keys]).agg(F.sum(v).alias(name))
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"_pt_{k}"))
        cond = e if cond is None else cond & e
    return df.join(totals, cond, "left").drop(*[f"_pt_{k}" for k in keys])
