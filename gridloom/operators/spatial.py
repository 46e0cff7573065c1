"""Radius and nearest-neighbour joins by buckets and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucketed(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, a_label, b_label, d2): every pair within ``radius`` once, a below b.

    Buckets of the radius' side, each point sent to its own and four later neighbours;
    the join is an equi-join on the bucket.
    """
    own = bucketed(points, radius)
    later = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    sent = own.select("*", F.explode(later).alias("o")).select(
        F.col("id").alias("p"), F.col("label").alias("p_label"), F.col("x").alias("px"), F.col("y").alias("py"),
        (F.col("bx") + F.col("o.dx")).alias("bx"), (F.col("by") + F.col("o.dy")).alias("by"), ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("same"),
    )
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    pairs = sent.join(own, ["bx", "by"]).filter(~F.col("same") | (F.col("p") < F.col("id"))).withColumn("d2", dx * dx + dy * dy)
    first = F.col("p") < F.col("id")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return pairs.filter(F.col("d2") <= radius * radius).select(
        pick("p", "id").alias("a"), pick("id", "p").alias("b"), pick("p_label", "label").alias("a_label"), pick("label", "p_label").alias("b_label"), "d2"
    )


def nearest(points: DataFrame, size: float, rounds: int = 6) -> DataFrame:
    """(id, label, same, other): squared distance to the nearest of the same label and of
    any other label, null if there is none.

    Expanding rings of buckets: a point is settled once its best distances lie inside
    the ring searched; only unsettled points go on with buckets four times as wide, so
    dense areas never meet all pairs. The last ring spans all points, so what is still
    open then is searched in full. A point alone with its label does not wait for one.
    """
    extent = points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count_distinct("label")).first()
    reach, others = max(extent[0] or 0.0, extent[1] or 0.0) + size, (extent[2] or 0) > 1
    alone = points.groupBy(F.col("label").alias("l")).agg((F.count(F.lit(1)) == 1).alias("alone"))
    todo, out, side = points.join(alone, F.col("label") == F.col("l")).select("id", "label", "x", "y", "alone"), None, size
    for i in range(rounds + 1):
        side = reach if i == rounds else min(side, reach)
        own = bucketed(points, side).select(F.col("id").alias("c"), F.col("label").alias("c_label"), F.col("x").alias("cx"), F.col("y").alias("cy"), "bx", "by")
        ring = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        sent = bucketed(todo, side).select("id", "label", "x", "y", "bx", "by", F.explode(ring).alias("o")).select(
            "id", "label", "x", "y", (F.col("bx") + F.col("o.dx")).alias("bx"), (F.col("by") + F.col("o.dy")).alias("by")
        )
        dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
        met = sent.join(own, ["bx", "by"]).filter("id <> c").withColumn("d2", dx * dx + dy * dy)
        best = met.groupBy("id").agg(F.min(F.when(F.col("label") == F.col("c_label"), F.col("d2"))).alias("same"), F.min(F.when(F.col("label") != F.col("c_label"), F.col("d2"))).alias("other"))
        best = todo.join(best, "id", "left").persist()  # used twice; also cuts the plan
        inside = lambda c: F.coalesce(c, F.lit(float("inf"))) <= side * side  # noqa: E731, B023
        settled = (F.col("alone") | inside("same")) & (inside("other") if others else F.lit(True))
        if side >= reach:
            settled = F.lit(True)
        done = best.filter(settled).select("id", "label", "same", "other")
        out = done if out is None else out.unionAll(done)
        todo = best.filter(~settled).select("id", "label", "x", "y", "alone")
        if side >= reach or todo.isEmpty():
            break
        side *= 4
    return out


def isolated(points: DataFrame, radius: int) -> DataFrame:
    """Integer points (map, gx, gy) with no other within ``radius`` (chessboard): an anti
    join on buckets of side radius + 1."""
    side = radius + 1
    key = lambda c: F.floor(F.col(c) / side)
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    others = points.select(F.col("map").alias("m"), F.col("gx").alias("ox"), F.col("gy").alias("oy"), F.explode(near).alias("o")).select(
        "m", "ox", "oy", (key("ox") + F.col("o.dx")).alias("kx"), (key("oy") + F.col("o.dy")).alias("ky")
    )
    own = points.withColumns({"bx": key("gx"), "by": key("gy")})
    close = (F.abs(F.col("gx") - F.col("ox")) <= radius) & (F.abs(F.col("gy") - F.col("oy")) <= radius)
    apart = (F.col("gx") != F.col("ox")) | (F.col("gy") != F.col("oy"))
    same = (F.col("map") == F.col("m")) & (F.col("bx") == F.col("kx")) & (F.col("by") == F.col("ky"))
    return own.join(others, same & close & apart, "left_anti").drop("bx", "by")


def companions(pairs: DataFrame, n: int) -> DataFrame:
    """(label, companion, n, rank): for each label the labels met most often nearby."""
    both = pairs.select(F.col("a_label").alias("label"), F.col("b_label").alias("companion")).unionAll(
        pairs.filter("a_label <> b_label").select(F.col("b_label"), F.col("a_label"))
    )
    counted = both.groupBy("label", "companion").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy(F.col("n").desc(), "companion")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
