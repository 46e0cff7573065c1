"""Neighbourhood operators on cell(map, gx, gy, ...) as window and equi-join plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along_row() -> WindowSpec:
    return Window.partitionBy("map", "gy").orderBy("gx")


def along_column() -> WindowSpec:
    return Window.partitionBy("map", "gx").orderBy("gy")


def neighbours(cell: DataFrame, *names: str, default=None) -> DataFrame:
    """Adds name_w, name_e (row) and name_n, name_s (column) for each name.

    Two sorts whatever the number of names; a dense grid is taken for granted.
    """
    for name in names:
        cell = cell.withColumns({f"{name}_w": F.lag(name, 1, default).over(along_row()), f"{name}_e": F.lead(name, 1, default).over(along_row())})
    for name in names:
        cell = cell.withColumns({f"{name}_n": F.lag(name, 1, default).over(along_column()), f"{name}_s": F.lead(name, 1, default).over(along_column())})
    return cell


def slopes(cell: DataFrame, edge: float = 200.0, height: float = 100.0) -> DataFrame:
    """Adds slope in degrees of the square between a vertex and its east and south ones.

    Each gradient is the mean of two opposite edges; the last row and column have none.
    """
    east = cell.withColumn("e", F.lead("h").over(along_row()))
    both = east.withColumn("s", F.lead("h").over(along_column())).withColumn("se", F.lead("e").over(along_column()))
    dx = ((F.col("e") - F.col("h")) + (F.col("se") - F.col("s"))) * F.lit(height) / 2 / edge
    dy = ((F.col("s") - F.col("h")) + (F.col("se") - F.col("e"))) * F.lit(height) / 2 / edge
    return both.withColumn("slope", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))).filter("slope IS NOT NULL").drop("e", "s", "se")


def window_sums(cell: DataFrame, values: dict[str, Column], radius: int = 1) -> DataFrame:
    """Box sums of side 2 * radius + 1, along rows, then along columns; n counts cells."""
    row, column = along_row().rowsBetween(-radius, radius), along_column().rowsBetween(-radius, radius)
    values = values | {"n": F.lit(1)}
    first = cell.select("*", *[F.sum(v).over(row).alias(f"row_{k}") for k, v in values.items()])
    return first.select(*cell.columns, *[F.sum(f"row_{k}").over(column).alias(k) for k in values])


def erode(cell: DataFrame, mask: str) -> DataFrame:
    """One 4-neighbour erosion of a boolean column; the map's edge does not erode."""
    near = neighbours(cell.select("map", "gx", "gy", mask), mask, default=True)
    kept = F.col(mask)
    for side in "wens":
        kept = kept & F.col(f"{mask}_{side}")
    return near.select("map", "gx", "gy", kept.alias(mask))


def halo(cell: DataFrame, seeds: Column, radius: int) -> DataFrame:
    """Cells within ``radius`` (chessboard) of a seed: two windowed maxima, no join."""
    row, column = along_row().rowsBetween(-radius, radius), along_column().rowsBetween(-radius, radius)
    along = cell.withColumn("near_row", F.max(seeds.cast("int")).over(row))
    return along.withColumn("near", F.max("near_row").over(column) > 0).drop("near_row")


def halved(cell: DataFrame, flag: str) -> DataFrame:
    """2 x 2 blocks with how many of their cells carry the flag."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return cell.groupBy("map", half("gx"), half("gy")).agg(F.count_if(F.col(flag)).alias("set"), F.count(F.lit(1)).alias("n"))
