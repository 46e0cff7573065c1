"""The rule engine: each rule is a DataFrame of findings, the report their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("blocker", "major", "minor", "info")
COLUMNS = ("rule", "severity", "where_", "symptom", "detail", "fix")


def finding(df: DataFrame, rule: str, severity: str, where: Column, symptom: str, detail: Column, fix: str) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), where.cast("string").alias("where_"), F.lit(symptom).alias("symptom"), detail.cast("string").alias("detail"), F.lit(fix).alias("fix")
    )


def report(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def by_severity(findings: DataFrame) -> list[Column]:
    """The order of a report: worst first, then rule, then place."""
    return [F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")), F.col("rule"), F.col("where_")]
