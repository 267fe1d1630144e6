"""Parquet table access.

Jobs take DataFrames; this module only turns a folder of ``<name>.parquet`` files into them.
Reads are lazy, so column pruning and filter pushdown reach the Parquet scan from whatever
the job selects and filters later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of one table of the folder ``root``."""
    if name not in TABLE_NAMES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(root, name))


class Tables:
    """Lazy accessor: ``Tables(spark, root).lineitem`` reads on first use and keeps the frame."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.root, name)
        return self._cache[name]

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)
