"""Helpers shared by the operators: tables, intermediate tables, Arrow batches."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from opsmetrics.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes the rows to a new folder in the shared checkpoint folder and reads them back.

    Cuts the lineage: a lost executor costs the tasks that read the table, not what made it.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: texts are long.
BATCH_ROWS = 1000


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH_ROWS, read_rows: int | None = None):
    """Arrow batches of at most so many rows, and Parquet read by ``read_rows``, for what is written meanwhile."""
    meant = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    if read_rows:
        meant["spark.sql.parquet.columnarReaderBatchSize"] = str(read_rows)
    before = {name: spark.conf.get(name) for name in meant}
    for name, value in meant.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Parquet rows decoded at a time where whole rows go to the Python workers.
READ_ROWS = 512


def keep_batches_short(spark: SparkSession) -> None:
    """Lowers the session's Arrow and Parquet batches to those of ``short_batches`` for good.

    For rows with their texts that the caller writes later: Spark reads these settings only then.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if not 0 < int(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


#: Words and pieces of more characters aren't kept in workers' tables, so that entries bound their bytes too.
KEPT_CHARS = 64

_HELD: dict = {}


def held(key, make):
    """A Python worker's table that outlives a task; a table of another key takes its place.

    Workers are reused by all stages of a session, so tables of several operators would add up.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def cut(it: Iterable[pa.RecordBatch], column: str = "text", size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``size`` bytes of the column, or one row."""
    for b in it:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def text_at(docs: DataFrame) -> int | None:
    """The place of ``text`` among the columns, if it is a string there and needn't be sent beside the row."""
    at = [k for k, c in enumerate(docs.columns) if c.lower() == "text"]
    return at[0] if len(at) == 1 and docs.dtypes[at[0]][1] == "string" else None


def with_text(it: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Adds the column text to batches: the field of ``row`` at that place, without a copy."""
    for b in it:
        yield b.append_column("text", b.column("row").field(at))
