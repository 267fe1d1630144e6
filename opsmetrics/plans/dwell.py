"""Dwell time: days from an item's "received" scan to the following "put away" scan.

Input is a scan log, one row per scan: item id, log sequence, scan type, description and
scan time. The job

1. tags each scan with the previous / next scan type of the same item (default ``'0'``),
2. drops repeated scans of the same type, put-aways with no earlier scan, and lone scans,
   then numbers the remaining scans per item (numbering runs *after* that filter),
3. drops the last scan of an item when its number is odd (a return with no put-away),
4. gives every put-away the time of the scan before it and the day difference.

One plan for every item, whatever its share of the log: ``event_sets`` is an associative scan over ranges of
(item, sequence), and the job and its single steps (``annotated``, ``pruned``, ``closed``, ``paired``) read their
results from it. NULL items, sequences and times are ordinary values that sort last.
``annotate_neighbours``, ``prune_event_sets``, ``drop_unclosed`` and ``pair_start_end`` are the steps with
one window per item: the definition that the scan is tested against, and the way to go from a frame that has been
annotated or numbered elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.functions.semantics import asc, day_diff
from opsmetrics.operators.windows import range_neighbours
from opsmetrics.sources.staging import staged


@dataclass(frozen=True)
class ScanLogColumns:
    item: str = "hu_id"
    seq: str = "tran_log_id"
    type: str = "tran_type"
    description: str = "description"
    ts: str = "end_tran_date"


def annotate_neighbours(log: DataFrame, types: Sequence[str], since=None,
                        cols: ScanLogColumns = ScanLogColumns(), missing: str = "0") -> DataFrame:
    """Scans of the given types (from ``since`` on) with previous / next type per item."""
    c = cols
    rows = log.where(F.col(c.type).isin(list(types)))
    if since is not None:
        rows = rows.where(F.col(c.ts) >= F.lit(since).cast("timestamp_ntz"))
    w = Window.partitionBy(c.item).orderBy(asc(c.seq))
    return rows.select(
        c.ts, c.seq, c.item, c.type, c.description,
        F.lag(F.col(c.type).cast("string"), 1, missing).over(w).alias("previous_location"),
        F.lead(F.col(c.type).cast("string"), 1, missing).over(w).alias("next_location"),
    )


def prune_event_sets(annotated: DataFrame, end_types: Sequence[str],
                     cols: ScanLogColumns = ScanLogColumns(), missing: str = "0") -> DataFrame:
    """Drop repeats, put-aways with nothing before them and lone scans; number the rest."""
    c = cols
    prev, nxt = F.col("previous_location"), F.col("next_location")
    delete = ((prev == missing) & F.col(c.type).isin(list(end_types))) | ((prev == missing) & (nxt == missing))
    kept = annotated.where((prev != F.col(c.type).cast("string")) & ~F.coalesce(delete, F.lit(False)))
    w = Window.partitionBy(c.item).orderBy(asc(c.seq))
    return kept.select(F.row_number().over(w).alias("rn"), c.seq, c.ts, c.item, c.type, c.description)


def drop_unclosed(sets: DataFrame, cols: ScanLogColumns = ScanLogColumns()) -> DataFrame:
    """Drop a scan when its number is odd and it has no successor, or it is alone.

    ``rn`` is dense from 1, so ``lag(rn) = lead(rn)`` only holds for a single scan (both 0):
    the two rules together mean "odd number and last of its item".
    """
    c = cols
    w = Window.partitionBy(c.item).orderBy(asc(c.seq))
    tagged = sets.select("*", F.lag("rn", 1, 0).over(w).alias("_prev_item"),
                         F.lead("rn", 1, 0).over(w).alias("_next_item"))
    prev_item, next_item = F.col("_prev_item"), F.col("_next_item")
    odd = (F.col("rn") % 2) == 1
    delete = (odd & (prev_item == next_item)) | (odd & (next_item == 0))
    return tagged.where(~F.coalesce(delete, F.lit(False))).drop("_prev_item", "_next_item")


def pair_start_end(closed: DataFrame, end_descriptions: Sequence[str], drop_descriptions: Sequence[str],
                   cols: ScanLogColumns = ScanLogColumns()) -> DataFrame:
    """Put-away rows get the time of the scan before them (ordered by time, then sequence)."""
    c = cols
    w = Window.partitionBy(c.item).orderBy(asc(c.ts), asc(c.seq))
    returned = F.when(F.col(c.description).isin(list(end_descriptions)), F.lag(c.ts, 1).over(w))
    out = closed.select(
        F.col(c.ts).alias("date"),
        F.col(c.item).alias("barcode"),
        F.col(c.description).alias("description"),
        returned.alias("returned_date"),
    )
    out = out.where(~F.col("description").isin(list(drop_descriptions)))
    return out.withColumn("d2s", day_diff("returned_date", "date"))


def event_sets(log: DataFrame, start_types: Sequence[str], end_types: Sequence[str], since=None,
               cols: ScanLogColumns = ScanLogColumns(), partitions: int | None = None, missing: str = "0") -> DataFrame:
    """Every scan of the given types with what its item's other scans say about it.

    Adds ``previous_location``, ``next_location``, ``kept`` (survives the pruning), ``rn`` (its number among the
    kept scans), ``n_kept``, ``prev_kept_ts`` (time of the kept scan before it) and ``disordered`` (the
    times of its item don't follow the sequence).

    An associative scan over ranges of (item, sequence). Inside a range everything but the fate of an item's
    first scan is known, and that depends on the carried state only: the type before it, the number
    of scans kept so far and the time of the last of them. So each (item, range) is a
    transition from one state to the next: its first and last type, how many further scans it keeps, and the time
    of the last one. Only the first and the last item of a range can go on in another one; their
    transitions, at most two a range, are composed in range order and brought back as a broadcast of that size.
    The ranged rows are written once, with their local results, so both steps see the same ranges.
    """
    c = cols
    types = list(start_types) + list(end_types)
    if missing in types:
        raise ValueError("the label for 'no neighbour' is one of the scan types")
    n = partitions or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = log.where(F.col(c.type).isin(types))
    if since is not None:
        rows = rows.where(F.col(c.ts) >= F.lit(since).cast("timestamp_ntz"))
    rows = rows.select(c.ts, c.seq, c.item, F.col(c.type).cast("string").alias(c.type), c.description)
    order = [asc(c.seq), asc(c.ts)]
    rows = rows.repartitionByRange(n, asc(c.item), *order).withColumn("_rb", F.spark_partition_id())

    w = Window.partitionBy(c.item, "_rb").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct(F.col(c.type).alias("type"), F.col(c.ts).alias("ts"))
    rows = rows.withColumn("_lp", F.lag(here).over(w)).withColumn("_ln", F.lead(c.type).over(w))
    further = F.col("_lp").isNotNull() & (F.col(c.type) != F.col("_lp.type"))        # kept, and not the first of the range
    time = F.when(further, F.struct(F.col(c.ts).alias("ts")))
    local = staged(rows.select(
        "*", F.sum(further.cast("bigint")).over(upto).alias("_k"), F.sum(further.cast("bigint")).over(whole).alias("_kt"),
        F.last(time, ignorenulls=True).over(before).alias("_pk"), F.last(time, ignorenulls=True).over(whole).alias("_lk"),
        F.first(here).over(whole).alias("_f"), F.count(F.lit(1)).over(whole).alias("_n"),
        F.max(F.col("_lp").isNotNull() & _later("_lp.ts", c.ts)).over(whole).alias("_inv")), "event-ranges")
    edges = F.broadcast(_carried_states(local, c, end_types))

    joined = local.join(edges, (F.col("_rb") == F.col("e_rb")) & F.col(c.item).eqNullSafe(F.col("e_item")), "left")
    first = F.coalesce("e_first_kept", ~F.col("_f.type").isin(list(end_types)) & (F.col("_n") > 1))
    kept = F.when(F.col("_lp").isNull(), first).otherwise(F.col(c.type) != F.col("_lp.type"))
    return joined.select(
        c.ts, c.seq, c.item, c.type, c.description,
        F.coalesce("_lp.type", "e_before", F.lit(missing)).alias("previous_location"),
        F.coalesce("_ln", "e_after", F.lit(missing)).alias("next_location"),
        kept.alias("kept"),
        F.when(kept, F.coalesce("e_offset", F.lit(0)) + first.cast("bigint") + F.col("_k")).alias("rn"),
        F.coalesce("e_total", first.cast("bigint") + F.col("_kt")).alias("n_kept"),
        F.coalesce("_pk", F.when(F.col("_lp").isNotNull() & first, F.struct(F.col("_f.ts").alias("ts"))), "e_carry")["ts"]
        .alias("prev_kept_ts"),
        F.coalesce("e_disordered", "_inv").alias("disordered"))


def _later(a: str, b: str) -> Column:
    """Whether time ``a`` sorts behind ``b`` (NULL last)."""
    return F.when(F.col(a).isNull(), F.col(b).isNotNull()).otherwise(F.coalesce(F.col(a) > F.col(b), F.lit(False)))


def _carried_states(local: DataFrame, c: ScanLogColumns, end_types: Sequence[str]) -> DataFrame:
    """For the first and the last item of each range: the state carried into it, by composing transitions."""
    key = F.struct(F.col(c.item).isNull().alias("n"), F.col(c.item).alias("item"))
    ends = (local.groupBy("_rb").agg(F.min(key)["item"].alias("_lo"), F.max(key)["item"].alias("_hi"))
            .withColumnRenamed("_rb", "_erb"))
    steps = (local.where(F.col("_ln").isNull())
             .join(F.broadcast(ends), F.col("_rb") == F.col("_erb"))                       # one row a range
             .where(F.col(c.item).eqNullSafe(F.col("_lo")) | F.col(c.item).eqNullSafe(F.col("_hi"))))
    by = Window.partitionBy(c.item).orderBy("_rb")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(c.item)
    steps = (steps.withColumn("_before", F.lag(F.struct(F.col(c.type).alias("type"), F.col(c.ts).alias("ts"))).over(by))
             .withColumn("_after", F.lead("_f.type").over(by)))
    first = F.when(F.col("_before").isNull(), ~F.col("_f.type").isin(list(end_types)) & ((F.col("_n") > 1) | F.col("_after").isNotNull())
                   ).otherwise(F.col("_f.type") != F.col("_before.type"))
    steps = steps.withColumn("_first", first).withColumn("_fts", F.col("_f.ts"))
    kept = F.col("_first").cast("bigint") + F.col("_kt")
    last = F.coalesce("_lk", F.when(F.col("_first"), F.struct(F.col("_fts").alias("ts"))))
    back = F.col("_inv") | (F.col("_before").isNotNull() & _later("_before.ts", "_fts"))
    return steps.select(
        F.col("_rb").alias("e_rb"), F.col(c.item).alias("e_item"), F.col("_before.type").alias("e_before"),
        F.col("_after").alias("e_after"), F.col("_first").alias("e_first_kept"),
        F.coalesce(F.sum(kept).over(earlier), F.lit(0)).alias("e_offset"), F.sum(kept).over(all_).alias("e_total"),
        F.last(last, ignorenulls=True).over(earlier).alias("e_carry"), F.max(back).over(all_).alias("e_disordered"))


def annotated(sets: DataFrame, cols: ScanLogColumns = ScanLogColumns()) -> DataFrame:
    """``annotate_neighbours`` from ``event_sets``."""
    c = cols
    return sets.select(c.ts, c.seq, c.item, c.type, c.description, "previous_location", "next_location")


def pruned(sets: DataFrame, cols: ScanLogColumns = ScanLogColumns()) -> DataFrame:
    """``prune_event_sets`` from ``event_sets``."""
    c = cols
    return sets.where("kept").select("rn", c.seq, c.ts, c.item, c.type, c.description)


def closed(sets: DataFrame, cols: ScanLogColumns = ScanLogColumns()) -> DataFrame:
    """``drop_unclosed`` from ``event_sets``: an odd number that is the last of its item goes."""
    return pruned(sets.where(~F.coalesce((F.col("rn") % 2 == 1) & (F.col("rn") == F.col("n_kept")), F.lit(False))), cols)


def paired(sets: DataFrame, end_descriptions: Sequence[str], drop_descriptions: Sequence[str],
           cols: ScanLogColumns = ScanLogColumns(), partitions: int | None = None) -> DataFrame:
    """``pair_start_end`` from ``event_sets``.

    Where an item's times follow its sequence, the scan before a scan by time is the kept one before
    it. Items with a time that goes back (usually none) are ranged by time as well.
    """
    c = cols
    done = sets.where(F.col("kept") & ~((F.col("rn") % 2 == 1) & (F.col("rn") == F.col("n_kept"))))
    columns = [c.ts, c.item, c.description, F.col("prev_kept_ts").alias("_prev_ts")]
    out = done.where(~F.col("disordered")).select(*columns)
    back = done.where("disordered").select(c.ts, c.seq, c.item, c.description)
    if not back.isEmpty():
        again = range_neighbours(back, [c.item], [c.ts, c.seq], c.ts, "_prev_ts", partitions=partitions)
        out = out.unionByName(again.select(c.ts, c.item, c.description, "_prev_ts"))
    out = out.select(F.col(c.ts).alias("date"), F.col(c.item).alias("barcode"), F.col(c.description).alias("description"),
                     F.when(F.col(c.description).isin(list(end_descriptions)), F.col("_prev_ts")).alias("returned_date"))
    return out.where(~F.col("description").isin(list(drop_descriptions))).withColumn("d2s", day_diff("returned_date", "date"))


def dwell_time(log: DataFrame, start_types: Sequence[str], end_types: Sequence[str],
               end_descriptions: Sequence[str], drop_descriptions: Sequence[str], since=None,
               cols: ScanLogColumns = ScanLogColumns(), partitions: int | None = None,
               missing: str = "0") -> DataFrame:
    """Full job: ``date, barcode, description, returned_date, d2s`` per kept scan.

    ``partitions`` is the number of ranges (default: the session's shuffle partitions). The ranged
    scans are written to the shared checkpoint folder while the frame is built.
    """
    sets = event_sets(log, start_types, end_types, since, cols, partitions, missing)
    return paired(sets, end_descriptions, drop_descriptions, cols, partitions)


def single_pass(log, start_types, end_types, end_descriptions, drop_descriptions, since=None,
                cols: ScanLogColumns = ScanLogColumns()) -> DataFrame:
    """The same job with one window per item: the definition that ``dwell_time`` is tested against."""
    a = annotate_neighbours(log, list(start_types) + list(end_types), since, cols)
    return pair_start_end(drop_unclosed(prune_event_sets(a, end_types, cols), cols), end_descriptions, drop_descriptions, cols)
