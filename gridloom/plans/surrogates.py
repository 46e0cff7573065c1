"""Grid, placement and registry views over the star-schema tables.

No world files are supplied, so the domain is laid over the driver tables: one dense
64 x 64 grid per return flag (height, tile index and attribute byte of a cell), points
from the first two embedding components, headings from key columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import table

SIDE = 64
SECTOR = 16


def cells(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """cell(map, gx, gy, h, t, attr): every position of every map, empty ones 0."""
    items = table(spark, sf_dir, "lineitem")
    filled = items.groupBy(
        F.col("l_returnflag").alias("map"), (F.col("l_orderkey") % side).cast("int").alias("gx"), (F.col("l_partkey") % side).cast("int").alias("gy")
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("h"), F.max("l_linenumber").alias("t"))
    axis = F.sequence(F.lit(0), F.lit(side - 1))
    dense = filled.select("map").distinct().select("map", F.explode(axis).alias("gx")).select("map", "gx", F.explode(axis).alias("gy"))
    h, t = F.coalesce("h", F.lit(0)).cast("bigint"), F.coalesce("t", F.lit(0)).cast("int")
    return dense.join(filled, ["map", "gx", "gy"], "left").select(
        "map", "gx", "gy", h.alias("h"), t.alias("t"), ((h * 37 + t) % 256).cast("int").alias("attr")
    )


def flagged(cell: DataFrame) -> DataFrame:
    """cell with its block and water flags (bits 0 and 1 of the attribute byte)."""
    return cell.withColumn("block", F.col("attr").bitwiseAND(1) != 0).withColumn("water", F.col("attr").bitwiseAND(2) != 0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point(id, label, x, y)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


CELL = """
    filled AS (
        SELECT l_returnflag AS map, (l_orderkey % 64)::INTEGER AS gx, (l_partkey % 64)::INTEGER AS gy,
               sum(l_quantity::BIGINT)::BIGINT AS h, max(l_linenumber)::INTEGER AS t
        FROM lineitem GROUP BY ALL),
    dense AS (
        SELECT map, a.i::INTEGER AS gx, b.i::INTEGER AS gy
        FROM (SELECT DISTINCT map FROM filled), (SELECT unnest(range(64)) AS i) a, (SELECT unnest(range(64)) AS i) b),
    raw AS (SELECT map, gx, gy, coalesce(h, 0)::BIGINT AS h, coalesce(t, 0)::INTEGER AS t FROM dense LEFT JOIN filled USING (map, gx, gy)),
    cell AS (SELECT *, ((h * 37 + t) % 256)::INTEGER AS attr, ((h * 37 + t) % 256) & 1 <> 0 AS block, ((h * 37 + t) % 256) & 2 <> 0 AS water FROM raw)"""

POINTS = "point AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
