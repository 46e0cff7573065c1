"""Property registries: every property file below a folder as one table, the last path winning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.sources import codecs

SCHEMA = "path string, crc long, values map<string,array<string>>, problem string"


def scan_properties(spark: SparkSession, folder: str, pattern: str = "*.pr*") -> DataFrame:
    """(path, crc, values, problem) of every file below ``folder``, whatever the depth.

    Files that do not parse have a null id and say why; nothing is dropped.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    p = codecs.read_property(bytes(data))
                    out.append((path, p["crc"], p["values"], None))
                except (ValueError, IndexError) as e:
                    out.append((path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "crc", "values", "problem"]).astype({"crc": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(read, SCHEMA)


def registry(scanned: DataFrame) -> DataFrame:
    """One row an id: of files with one id the last in order of their paths."""
    w = Window.partitionBy("crc").orderBy(F.col("path").desc())
    return scanned.filter("crc IS NOT NULL").withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k", "problem")


def repaired(text: Column) -> Column:
    """Names whose cp949 bytes were read as latin-1, read again; others as they are."""

    @F.pandas_udf("string")
    def again(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return x if x is None or x.isascii() else x.encode("latin-1").decode("cp949")
            except UnicodeError:
                return x

        return s.map(one)

    return again(text)
