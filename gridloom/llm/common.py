"""Helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of the corpus operators: runs without space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


#: Spark removes an execution's shuffle files at its end, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir, else (tests) a local one.

    Raises an error where the setting is missing and the master is not local: executors
    of a cluster do not see the driver's own disk.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    if not _own:  # one process, as in tests: driver and executors share its disk
        _own.append(tempfile.mkdtemp(prefix="gridloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Spark itself reaches it."""
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def path_exists(spark: SparkSession, path: str) -> bool:
    store, own = hadoop_path(spark, path)
    return store.exists(own)


def delete_path(spark: SparkSession, path: str) -> None:
    store, own = hadoop_path(spark, path)
    store.delete(own, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Columnar, compressed and re-readable after an executor is lost, and its lineage is cut.
    Nothing reads the write's shuffle files again, so they go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` wrote and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, folder)


def fan_out(spark: SparkSession, least: int = 1) -> int:
    """Partitions for an explicit exchange: what the session deals out, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
