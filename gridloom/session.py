"""Sessions and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "gridloom", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the running session wins."""
    builder = SparkSession.builder.appName(app)
    if SparkSession.getActiveSession() is None:
        builder = (
            builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the star-schema or corpus tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
