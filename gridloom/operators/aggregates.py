"""Histogram, share, sweep and quantile aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: Sequence[str], value: Column, low: float, width: float, bins: int) -> DataFrame:
    """(keys, bin, n): fixed-width bins, clamped at both ends."""
    at = F.greatest(F.lit(0), F.least(F.floor((value - low) / width), F.lit(bins - 1))).cast("int")
    return df.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_percentiles(hist: DataFrame, keys: Sequence[str], low: float, width: float, shares: Sequence[float]) -> DataFrame:
    """Centre of the first bin whose cumulative count reaches each share; no sort of rows."""
    w = Window.partitionBy(*keys)
    run = hist.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    pick = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * width + low + width / 2).alias(f"p{round(q * 100)}")
    return run.groupBy(*keys).agg(*[pick(q) for q in shares])


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, shares: Sequence[float]) -> DataFrame:
    """Quantiles at mid-point cumulative weights, interpolated, ends held."""
    summed = df.groupBy(*keys, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys).orderBy("v")
    mid = summed.withColumn("c", F.sum("w").over(w) - F.col("w") / 2).withColumn("all", F.sum("w").over(Window.partitionBy(*keys)))
    mid = mid.withColumns({"pc": F.lag("c").over(w), "pv": F.lag("v").over(w)})
    out = []
    for q in shares:
        t = F.col("all") * q
        inside = (F.col("c") >= t) & ((F.col("pc") < t) | F.col("pc").isNull())
        line = F.when(F.col("pc").isNull(), F.col("v").cast("double")).otherwise(F.col("pv") + (F.col("v") - F.col("pv")) * (t - F.col("pc")) / (F.col("c") - F.col("pc")))
        out.append(F.coalesce(F.max(F.when(inside, line)), F.max("v").cast("double")).alias(f"q{round(q * 100)}"))
    return mid.groupBy(*keys).agg(*out)


def threshold_sweep(df: DataFrame, keys: Sequence[str], degree: Column, truth: Column, last: int) -> DataFrame:
    """(keys, cut, tp, fp, tpr, fpr, j, best): value >= cut predicts truth, cut 0..last.

    Rows are counted once per whole degree; the sweep is a reverse running sum.
    """
    cut = F.least(F.floor(degree), F.lit(last)).cast("int")
    counted = df.groupBy(*keys, cut.alias("cut")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    grid = counted.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(last))).alias("cut"))
    dense = grid.join(counted, [*keys, "cut"], "left").na.fill(0, ["pos", "neg"])
    back = Window.partitionBy(*keys).orderBy(F.col("cut").desc())
    whole = Window.partitionBy(*keys)
    swept = dense.select(
        *keys, "cut", F.sum("pos").over(back).alias("tp"), F.sum("neg").over(back).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("f")
    )
    rate = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(0.0))
    rated = swept.select(*keys, "cut", "tp", "fp", rate("tp", "p").alias("tpr"), rate("fp", "f").alias("fpr")).withColumn("j", F.col("tpr") - F.col("fpr"))
    order = Window.partitionBy(*keys).orderBy(F.col("j").desc(), "cut")
    return rated.withColumn("best", F.row_number().over(order) == 1)


def shares_of(df: DataFrame, keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    """(keys, n, share of the rows with equal ``within``)."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; the window prunes to n rows per task first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
