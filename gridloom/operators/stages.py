"""Staged builds: named steps, each a table from the tables before it, with re-entry at any step."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


def build(spark: SparkSession, steps: Sequence[tuple[str, Step]], folder: str | None = None, start: str | None = None) -> dict[str, DataFrame]:
    """The tables of all steps by name.

    With a folder every step's table is written there and read back, so that its lineage
    ends; ``start`` then names the first step to be done again, the tables of the steps
    before it are read. Without a folder the steps make one plan.
    """
    names = [n for n, _ in steps]
    if start is not None and (folder is None or start not in names):
        raise ValueError(f"cannot start at {start}")
    first = names.index(start) if start else 0
    tables: dict[str, DataFrame] = {}
    for i, (name, step) in enumerate(steps):
        if i >= first:
            tables[name] = step(spark, tables)
            if folder is None:
                continue
            tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
    return tables


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], rescan: bool = False) -> DataFrame:
    """A table that is costly to scan, kept as Parquet; made again if it is missing or ``rescan``."""
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store)
    if rescan or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
