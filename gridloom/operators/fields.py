"""Measures over dense grids and point sets in their full form: DataFrame -> DataFrame."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import raster


def rows() -> Column:
    return F.count(F.lit(1))


def moments(df: DataFrame, keys: Sequence[str], value: Column, low: float, width: float, bins: int) -> DataFrame:
    """Exact moments, what lies outside the bins, and how many bins are used."""
    at = F.greatest(F.lit(0), F.least(F.floor((value - low) / width), F.lit(bins - 1)))
    return df.groupBy(*keys).agg(
        rows().alias("n"), F.avg(value).alias("mean"), F.round(F.stddev_pop(value), 7).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"),
        F.count_if(value < low).alias("below"), F.count_if(value >= low + width * bins).alias("above"), F.count_distinct(at).alias("used_bins"),
    )


def scored(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision and F1 of a sweep's cuts; of equal scores the first cut is the best."""
    positives = F.max("tp").over(Window.partitionBy(*keys))
    guarded = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    s = sweep.withColumn("p", positives).withColumns({"precision": guarded(F.col("tp"), F.col("tp") + F.col("fp")), "f1": guarded(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p"))})
    first = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(c).desc(), "cut")) == 1
    return s.select(*keys, "cut", "precision", "f1", first("f1").alias("best_f1"), first("j").alias("best_j"))


def crossing(bands: DataFrame, keys: Sequence[str], centre: str, share: str, level: float) -> DataFrame:
    """The place where the share first reaches the level, interpolated from the band before."""
    w = Window.partitionBy(*keys).orderBy(centre)
    p = bands.withColumns({"pm": F.lag(centre).over(w), "pf": F.lag(share).over(w)}).filter(F.col(share) >= level)
    at = F.when(F.col("pf").isNull(), F.col(centre)).otherwise(F.col("pm") + (level - F.col("pf")) * (F.col(centre) - F.col("pm")) / (F.col(share) - F.col("pf")))
    return p.groupBy(*keys).agg(F.round(F.min_by(at, centre), 9).alias("crossing"))


def clark_evans(nearest: DataFrame, key: str, distance: str, area: float) -> DataFrame:
    """R = mean distance over that of a random set of the same density, z and verdict; n >= 8."""
    g = nearest.groupBy(key).agg(rows().alias("n"), F.avg(distance).alias("d")).filter("n >= 8")
    expected, error = 0.5 / F.sqrt(F.col("n") / area), 0.26136 / F.sqrt(F.col("n") * F.col("n") / area)
    r = F.col("d") / expected
    return g.select(key, "n", F.round(r, 6).alias("r"), F.round((F.col("d") - expected) / error, 4).alias("z"), F.when(r < 0.9, "clustered").when(r > 1.1, "regular").otherwise("poisson").alias("verdict"))


def affinity(df: DataFrame, kind: str, ground: str, frequent: int) -> DataFrame:
    """For each kind its highest lift over a ground class and the frequent classes it is never on.

    Kinds and classes are the outputs of aggregates: small tables, whatever the rows.
    """
    grounds = df.groupBy(ground).agg(rows().alias("base"))
    total = Window.partitionBy()
    kinds = df.groupBy(kind).agg(rows().alias("of_kind")).withColumn("all", F.sum("of_kind").over(total))
    dense = kinds.join(grounds).join(df.groupBy(kind, ground).agg(rows().alias("obs")), [kind, ground], "left").na.fill(0, ["obs"])
    lift = F.col("obs") / (F.col("of_kind") * F.col("base") / F.col("all"))
    never = F.array_join(F.array_sort(F.collect_list(F.when((F.col("obs") == 0) & (F.col("base") >= frequent), F.col(ground)))), ",")
    return dense.groupBy(kind).agg(never.alias("never"), F.round(F.max(lift), 9).alias("top_lift"), F.max_by(ground, F.struct(lift, -F.col(ground))).alias("top_ground"))


def pair_lift(points: DataFrame, radii: Sequence[float], area: float, least: int, top: int) -> DataFrame:
    """Pairs of labels within each radius against complete randomness, summed over maps.

    points: (map, id, label, x, y). Buckets of the largest radius; each pair once.
    """
    reach = max(radii)
    bucket = lambda c: F.floor(F.col(c) / reach)
    near = points.withColumn("bx", F.explode(F.array(*[bucket("x") + i for i in (-1, 0, 1)]))).withColumn("by", F.explode(F.array(*[bucket("y") + i for i in (-1, 0, 1)])))
    other = points.select("map", F.col("id").alias("o"), F.col("label").alias("o_label"), F.col("x").alias("ox"), F.col("y").alias("oy"), bucket("x").alias("bx"), bucket("y").alias("by"))
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    pair = near.join(other, ["map", "bx", "by"]).filter("id < o").withColumn("d2", d2)
    within = F.explode(F.filter(F.array(*[F.lit(float(r)) for r in radii]), lambda r: F.col("d2") <= r * r))
    observed = pair.select(within.alias("radius"), F.least("label", "o_label").alias("a"), F.greatest("label", "o_label").alias("b")).groupBy("radius", "a", "b").agg(rows().alias("observed"))
    n = points.groupBy("map", "label").agg(rows().alias("n"))
    both = n.select("map", F.col("label").alias("a"), F.col("n").alias("na")).join(n.select("map", F.col("label").alias("b"), F.col("n").alias("nb")), "map").filter("a <= b")
    pairs = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    chance = both.select("a", "b", pairs.alias("pairs"), F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius"))
    expected = chance.groupBy("radius", "a", "b").agg(F.sum(F.col("pairs") * math.pi * F.col("radius") * F.col("radius") / area).alias("expected"))
    lift = F.col("observed") / F.col("expected")
    ranked = observed.join(expected, ["radius", "a", "b"]).filter(F.col("observed") >= least).withColumn("k", F.row_number().over(Window.partitionBy("radius").orderBy(lift.desc(), "a", "b")))
    return ranked.filter(F.col("k") <= top).select("radius", "a", "b", "observed", F.round("expected", 7).alias("expected"), F.round(lift, 7).alias("lift"), (F.col("a") == F.col("b")).alias("itself"))


def from_edges(cell: DataFrame, side: int) -> DataFrame:
    """Every cell once for each edge: (side, line, depth) and all its columns."""
    at = lambda name, line, depth: F.struct(F.lit(name).alias("side"), line.alias("line"), depth.alias("depth"))
    x, y = F.col("gx"), F.col("gy")
    four = F.array(at("west", y, x), at("east", y, F.lit(side - 1) - x), at("north", x, y), at("south", x, F.lit(side - 1) - y))
    return cell.withColumn("e", F.explode(four)).select("*", "e.side", "e.line", "e.depth").drop("e")


def edge_bands(inward: DataFrame, side: int, strict: float, loose: float) -> DataFrame:
    share = inward.groupBy("map", "side", "depth").agg(F.avg(F.col("block").cast("int")).alias("share"))
    width = lambda least, name: F.coalesce(F.min(F.when(F.col("share") < least, F.col("depth"))), F.lit(side)).alias(name)
    b = share.groupBy("map", "side").agg(width(strict, "strict"), width(loose, "loose"))
    w = Window.partitionBy("map")
    return b.withColumns({"sealed": F.min("loose").over(w) > 0, "runaway": F.max("loose").over(w) >= side // 4})


def open_runs(inward: DataFrame, step: int, band: int, lift: float = 40, walkable: float = 0.3, wet: float = 0.55, longest: int = 16) -> DataFrame:
    """Runs of open stretches along each side; a run ends with its side."""
    ref = inward.filter("side = 'west'").groupBy(F.col("map").alias("r_map")).agg(F.percentile("h", F.lit(0.5)).alias("ref"))
    s = inward.filter(F.col("depth") < band).groupBy("map", "side", F.floor(F.col("line") / step).alias("at")).agg(
        F.avg((F.col("t") == 0).cast("int")).alias("bare"), F.avg(F.col("water").cast("int")).alias("wet"), F.avg((~F.col("block")).cast("int")).alias("free"), F.percentile("h", F.lit(0.5)).alias("mid")
    )
    s = s.join(ref, F.col("map") == F.col("r_map"))
    kind = F.when(F.col("bare") > 0.5, "void").when(F.col("wet") > wet, "water").when((F.col("mid") - F.col("ref") > lift) | (F.col("free") < walkable), "wall").otherwise("open")
    free = s.withColumn("kind", kind).filter("kind = 'open'")
    island = F.col("at") - F.row_number().over(Window.partitionBy("map", "side").orderBy("at"))
    runs = free.withColumn("island", island).groupBy("map", "side", "island").agg((F.min("at") * step).alias("first"), (rows() * step).alias("length"))
    return runs.select("map", "side", "first", "length", (F.col("length") > longest).alias("finding"))


def level_groups(df: DataFrame, key: str, levels: str, span: int) -> DataFrame:
    """(key, low, high, levels): a fold over the sorted values of each row's array.

    A value joins the group if it is within ``span`` of the value before and of the
    group's first; groups of one are dropped.
    """
    empty = F.array().cast("array<array<bigint>>")

    def step(groups: Column, v: Column) -> Column:
        last = F.element_at(groups, -1)
        near = (F.size(groups) > 0) & (v - F.element_at(last, -1) <= span) & (v - F.element_at(last, 1) <= span)
        return F.when(near, F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.concat(last, F.array(v))))).otherwise(F.concat(groups, F.array(F.array(v))))

    folded = df.select(key, F.explode(F.aggregate(F.transform(levels, lambda x: x.cast("bigint")), empty, step)).alias("g")).filter(F.size("g") > 1)
    return folded.select(key, F.element_at("g", 1).alias("low"), F.element_at("g", -1).alias("high"), F.size("g").alias("levels"))


def vertex_gradient(cell: DataFrame, edge: float, height: float) -> DataFrame:
    """Adds dx, dy: central differences, one-sided where a neighbour is missing."""
    near = raster.neighbours(cell, "h")

    def slope(a: str, b: str) -> Column:
        both = F.when(F.col(a).isNull() | F.col(b).isNull(), 1).otherwise(2)
        return (F.coalesce(a, "h") - F.coalesce(b, "h")) * F.lit(height) / (F.lit(edge) * both)

    return near.withColumns({"dx": slope("h_e", "h_w"), "dy": slope("h_s", "h_n")})


def lambert(dx: Column, dy: Column, light: tuple[float, float, float]) -> Column:
    """Light on the surface with that gradient, 0 to 1; ``light`` points to its source."""
    x, y, z = light
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (-dx * x - dy * y + z) / F.sqrt(dx * dx + dy * dy + 1)))


def bilinear(places: DataFrame, ground: DataFrame) -> DataFrame:
    """(id, h): heights at (x, y) from the four vertices around, by their weights."""
    ends = lambda c: F.explode(F.array(F.floor(F.col(c)), F.floor(F.col(c)) + 1))
    four = places.withColumn("gx", ends("x")).withColumn("gy", ends("y"))
    weight = (1 - F.abs(F.col("x") - F.col("gx"))) * (1 - F.abs(F.col("y") - F.col("gy")))
    return four.join(ground, ["gx", "gy"]).groupBy("id").agg(F.sum(F.col("h") * weight).alias("h"))


def boxed(cell: DataFrame, mask: str, how) -> DataFrame:
    first = cell.select("map", "gx", "gy", how(F.col(mask).cast("int")).over(raster.along_row().rowsBetween(-1, 1)).alias("r"))
    return first.select("map", "gx", "gy", (how("r").over(raster.along_column().rowsBetween(-1, 1)) > 0).alias(mask))


def shrink(cell: DataFrame, mask: str) -> DataFrame:
    """3 x 3 erosion; cells outside the map take no part."""
    return boxed(cell, mask, F.min)


def grow(cell: DataFrame, mask: str) -> DataFrame:
    """3 x 3 dilation; cells outside the map take no part."""
    return boxed(cell, mask, F.max)


def dilate(cell: DataFrame, mask: str) -> DataFrame:
    """One 4-neighbour dilation."""
    near = raster.neighbours(cell.select("map", "gx", "gy", mask), mask, default=False)
    out = F.col(mask)
    for side in "wens":
        out = out | F.col(f"{mask}_{side}")
    return near.select("map", "gx", "gy", out.alias(mask))


def majority(cell: DataFrame, mask: str, side: int) -> DataFrame:
    """The majority of 3 x 3, wrapping around: each cell votes on nine places, summed once."""
    step = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    votes = cell.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    to = lambda c, d: F.pmod(F.col(c) + F.col(d), F.lit(side)).alias(c)
    return votes.groupBy("map", to("gx", "dx"), to("gy", "dy")).agg((F.count_if(mask) >= 5).alias(mask))


def city_block(cell: DataFrame, mask: str, most: int) -> DataFrame:
    """City-block distance to the mask, ``most`` beyond: two sweeps along rows, two along columns.

    The distance is separable: min over columns of (row distance + steps), each a running
    minimum of value minus or plus position.
    """
    far = F.lit(10**6)
    start = cell.withColumn("z", F.when(F.col(mask), F.lit(0)).otherwise(far))

    def swept(df: DataFrame, at: str, w) -> DataFrame:
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        return df.withColumn("z", F.least(F.min(F.col("z") - F.col(at)).over(back) + F.col(at), F.min(F.col("z") + F.col(at)).over(ahead) - F.col(at)))

    done = swept(swept(start, "gx", raster.along_row()), "gy", raster.along_column())
    return done.select("map", "gx", "gy", F.least("z", F.lit(most)).cast("int").alias("d"))


def to_edge(width: int, height: int) -> Column:
    x, y = F.col("gx"), F.col("gy")
    return F.least(x + 1, y + 1, F.lit(width) - x, F.lit(height) - y).cast("int")


def to_polyline(cell: DataFrame, line: Sequence[tuple[int, int]]) -> DataFrame:
    """Adds d and signed: distance to the nearest segment, negative on its left; first segment wins ties."""
    x, y = F.col("gx"), F.col("gy")
    best = None
    for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
        dx, dy = x1 - x0, y1 - y0
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / F.lit(float(dx * dx + dy * dy))))
        px, py = x - (x0 + t * dx), y - (y0 + t * dy)
        one = F.struct(F.sqrt(px * px + py * py).alias("d"), F.when(dx * (y - y0) - dy * (x - x0) >= 0, 1).otherwise(-1).alias("sign"))
        best = one if best is None else F.when(one["d"] < best["d"], one).otherwise(best)
    return cell.withColumn("best", best).select("*", F.col("best.d").alias("d"), (F.col("best.d") * F.col("best.sign")).alias("signed")).drop("best")


def downsample(cell: DataFrame, value: str, k: int, side: int, target: int) -> DataFrame:
    """(map, row, col, value): k x k box means at ``target`` evenly spaced rows and columns."""
    picks = [int(i * (side // k - 1) / (target - 1)) for i in range(target)]
    at = F.create_map(*[F.lit(v) for i, p in enumerate(picks) for v in (p, i)])
    box = cell.groupBy("map", F.floor(F.col("gx") / k).cast("int").alias("bx"), F.floor(F.col("gy") / k).cast("int").alias("by")).agg(F.avg(value).alias(value))
    return box.select("map", at[F.col("by")].alias("row"), at[F.col("bx")].alias("col"), value).filter("row IS NOT NULL AND col IS NOT NULL")


def policies(cell: DataFrame, flag: str) -> DataFrame:
    """2 x 2 blocks: any set, two of four, all free, the first cell's value."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    first = F.bool_or(F.col(flag) & (F.col("gx") % 2 == 0) & (F.col("gy") % 2 == 0))
    b = cell.groupBy("map", half("gx"), half("gy")).agg(F.count_if(flag).alias("n"), first.alias("first_set"))
    return b.select("map", "gx", "gy", (F.col("n") > 0).alias("any_set"), (F.col("n") >= 2).alias("two_set"), (F.col("n") == 0).alias("all_free"), "first_set")


def rim_specks(cell: DataFrame, mask: str) -> DataFrame:
    """Cells with one neighbour of the mask at most, near its rim, for each hundred cells of rim."""
    near = raster.neighbours(cell.select("map", "gx", "gy", F.col(mask).cast("int").alias("m")), "m", default=0)
    for n in (1, 2, 3):  # reach of the mask and of its complement, step by step
        near = reached(near, "m" if n == 1 else f"in{n - 1}", f"in{n}")
    near = near.withColumn("off", 1 - F.col("m"))
    near = reached(reached(near, "off", "off1"), "off1", "off2")
    lone = (F.col("m") == 1) & (F.col("m_w") + F.col("m_e") + F.col("m_n") + F.col("m_s") <= 1) & (F.col("in3") == 1) & (F.col("off2") == 1)
    n = near.groupBy("map").agg(F.count_if(lone).alias("specks"), F.count_if((F.col("m") == 1) & (F.col("off1") == 1)).alias("rim"))
    return n.withColumn("rate", 100.0 * F.col("specks") / F.greatest(F.col("rim"), F.lit(1)))


def reached(cell: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the 4-neighbour maximum of a 0/1 column."""
    row, col = raster.along_row(), raster.along_column()
    one = lambda f, w: f(column, 1, 0).over(w)
    return cell.withColumn(name, F.greatest(F.col(column), one(F.lag, row), one(F.lead, row), one(F.lag, col), one(F.lead, col)))


def survival(cell: DataFrame, mask: str) -> DataFrame:
    """Share of the mask and what two and five erosions leave of it; path-like or not."""
    eroded = cell.select("map", "gx", "gy", (1 - F.col(mask).cast("int")).alias("o0"))
    for n in range(5):  # erosion is the growth of the complement
        eroded = reached(eroded, f"o{n}", f"o{n + 1}")
    left = lambda n: F.sum(1 - F.col(f"o{n}")) / F.sum(1 - F.col("o0"))
    s = eroded.groupBy("map").agg(F.avg(1 - F.col("o0")).alias("share"), left(2).alias("e2"), left(5).alias("e5"))
    return s.withColumn("path", F.col("share").between(0.005, 0.10) & F.col("e2").between(0.25, 0.85) & (F.col("e5") < 0.45))


def rings(cell: DataFrame, mask: str, last: int) -> DataFrame:
    """Cells within ``last`` of the mask with their chessboard distance, ring.

    Along rows the nearest set cell at each column distance, then along columns the least
    of the greater of both distances: set cells are spread, not all cells.
    """
    steps = range(-last, last + 1)
    spread = cell.filter(mask).select("map", F.col("gx").alias("mx"), F.col("gy").alias("my"))
    near = spread.withColumn("gx", F.explode(F.array(*[F.col("mx") + d for d in steps]))).groupBy("map", "my", "gx").agg(F.min(F.abs(F.col("gx") - F.col("mx"))).alias("dx"))
    near = near.withColumn("gy", F.explode(F.array(*[F.col("my") + d for d in steps]))).groupBy("map", "gx", "gy").agg(F.min(F.greatest("dx", F.abs(F.col("gy") - F.col("my")))).alias("ring"))
    return cell.join(near, ["map", "gx", "gy"])


def ring_profile(cell: DataFrame, mask: str, index: str, last: int, least: float = 0.10) -> DataFrame:
    """(map, ring, index, share, enrichment, blend) of chessboard rings 1..last outside a mask."""
    n = rings(cell, mask, last).filter(F.col("ring").between(1, last)).groupBy("map", "ring", index).agg(rows().alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("map", "ring")))
    blend = F.coalesce(F.min(F.when(F.col("share") < least, F.col("ring"))).over(Window.partitionBy("map", index)) - 1, F.lit(last))
    base = cell.groupBy("map", index).agg(rows().alias("b")).withColumn("base", F.col("b") / F.sum("b").over(Window.partitionBy("map")))
    return share.withColumn("blend", blend).join(base, ["map", index]).select("map", F.col("ring").cast("int").alias("ring"), index, "share", F.round(F.col("share") / F.col("base"), 9).alias("enrichment"), F.col("blend").cast("int").alias("blend"))


def patches(cell: DataFrame, size: int, stride: int, side: int, best: int = 2) -> DataFrame:
    """Whole windows with descriptors, the features they pass and the best of each map and feature.

    cell: (map, gx, gy, h, slope, water, block); every cell falls into four windows at most.
    """
    last = (side + 1 - size) // stride
    at = lambda k: F.filter(F.transform(F.sequence(F.lit(0), F.lit(size // stride - 1)), lambda i: F.floor(F.col(k) / stride).cast("int") - i), lambda p: (p >= 0) & (p <= last))
    w = cell.withColumn("px", F.explode(at("gx"))).withColumn("py", F.explode(at("gy")))
    q, r = size // 4, size - size // 4 - 1
    core = (F.col("gx") - F.col("px") * stride).between(q, r) & (F.col("gy") - F.col("py") * stride).between(q, r)
    mean = lambda c: F.avg(c.cast("int"))
    d = w.groupBy("map", "px", "py").agg(
        rows().alias("n"), (F.max("h") - F.min("h")).alias("relief"), F.avg("h").alias("mean"), F.stddev_pop("h").alias("rough"), F.avg("slope").alias("slope"), mean(F.col("slope") < 30).alias("flat"),
        mean(F.col("water")).alias("wet"), mean(F.col("block")).alias("blocked"), (F.avg(F.when(core, F.col("h"))) - F.avg(F.when(~core, F.col("h")))).alias("lift"),
    ).filter(F.col("n") == size * size)
    gates = [(F.col("lift") > 5, "dome", F.col("lift")), (F.col("lift") < -5, "basin", -F.col("lift")), (F.col("flat") > 0.2, "plain", F.col("flat")), (F.col("rough") > 60, "rugged", F.col("rough")), (F.col("wet") > 0.5, "wet", F.col("wet"))]
    passed = F.filter(F.array(*[F.when(test, F.struct(F.lit(name).alias("feature"), score.cast("double").alias("score"))) for test, name, score in gates]), lambda x: x.isNotNull())
    f = d.withColumn("f", F.explode(passed)).select("*", "f.feature", "f.score")
    rank = F.row_number().over(Window.partitionBy("map", "feature").orderBy(F.round("score", 9).desc(), "px", "py"))
    return f.withColumn("rank", rank).filter(F.col("rank") <= best).select("map", "feature", "rank", "px", "py", "relief", F.round("mean", 7).alias("mean"), F.round("score", 7).alias("score"))


def widths(cell: DataFrame, mask: str) -> DataFrame:
    """Adds the least run through each set cell along row, column and both diagonals."""
    out = cell.filter(mask)
    x, y = F.col("gx"), F.col("gy")
    names = []
    for n, (line, at) in enumerate(((y, x), (x, y), (x - y, x), (x + y, x))):
        out = out.withColumns({f"l{n}": line})
        out = out.withColumn(f"i{n}", at - F.row_number().over(Window.partitionBy("map", f"l{n}").orderBy(at)))
        out = out.withColumn(f"w{n}", rows().over(Window.partitionBy("map", f"l{n}", f"i{n}")))
        names.append(f"w{n}")
    return out.select("map", "gx", "gy", F.least(*names).alias("width"))


def footprints(objects: DataFrame, cell: DataFrame, reach: int) -> DataFrame:
    """Blocked ground in the window around each object, by id and whether it counts.

    objects: (map, ox, oy, id). Windows cut by the map's edge, and windows less than half
    blocked, are counted apart. An equi join on the window's cells, not a range join.
    """
    span = lambda c: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))
    window = objects.withColumn("gx", span("ox")).withColumn("gy", span("oy"))
    held = window.join(cell.select("map", "gx", "gy", "block"), ["map", "gx", "gy"])
    on = lambda c: F.when(F.col("block"), F.col(c))
    f = held.groupBy("map", "ox", "oy", "id").agg(rows().alias("seen"), F.count_if("block").alias("area"), (F.max(on("gx")) - F.min(on("gx")) + 1).alias("width"), (F.max(on("gy")) - F.min(on("gy")) + 1).alias("depth"))
    status = F.when(F.col("seen") < (2 * reach + 1) ** 2, "cut").when(F.col("area") < 0.5 * F.col("seen"), "thin").otherwise("kept")
    return f.withColumn("status", status).groupBy("map", "id", "status").agg(rows().alias("n"), F.round(F.avg("area"), 7).alias("area"), F.round(F.avg(F.sqrt(F.col("area") / math.pi)), 7).alias("radius"), F.max("width").alias("width"), F.max("depth").alias("depth"))


def planes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-squares plane z = a x + b y + c of each group and its residual over the spread of z."""
    m = points.groupBy(*keys).agg(
        rows().alias("n"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("y", "y").alias("yy"),
        F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"), F.covar_pop("z", "z").alias("zz"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a, b = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    left = F.greatest(F.lit(0.0), F.col("zz") - a * F.col("xz") - b * F.col("yz"))
    return m.select(*keys, "n", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(F.when(F.col("zz") > 0, F.sqrt(left / F.col("zz"))).otherwise(F.lit(0.0)), 6).alias("ratio"))


def opaque_slots(cell: DataFrame, slots: int) -> DataFrame:
    """(map, slot, opaque): cells opaque for each index: equal, or higher with an equal one of 8 near.

    The indices around a cell are one bit set, gathered by two windowed unions.
    """
    bits = cell.withColumn("own", F.expr("shiftleft(1, t)"))
    row = bits.withColumn("r", F.bit_or("own").over(raster.along_row().rowsBetween(-1, 1)))
    near = row.withColumn("near", F.bit_or("r").over(raster.along_column().rowsBetween(-1, 1)))
    on = lambda s: (F.col("t") == s) | ((F.col("t") > s) & (F.col("near").bitwiseAND(1 << s) != 0))
    n = near.groupBy("map").agg(*[F.count_if(on(s)).alias(f"s{s}") for s in range(1, slots + 1)])
    return n.select("map", F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"s{s}").alias("opaque")) for s in range(1, slots + 1)])).alias("x")).select("map", "x.slot", "x.opaque")


def euclid(cell: DataFrame, mask: str, most: int) -> DataFrame:
    """Squared Euclidean distance to the mask within ``most``, exact, in two separable steps.

    Along columns the nearest set cell, by running positions; then along rows the least of
    dx^2 + dy^2 over the cells within reach.
    """
    far, w = F.lit(10**6), raster.along_column()
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    set_at = F.when(F.col(mask), F.col("gy"))
    dy = F.least(F.coalesce(F.col("gy") - F.max(set_at).over(back), far), F.coalesce(F.min(set_at).over(ahead) - F.col("gy"), far))
    near = cell.select("map", "gx", "gy", dy.alias("dy")).filter(F.col("dy") <= most)
    spread = near.withColumn("dx", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select("map", (F.col("gx") + F.col("dx")).alias("gx"), "gy", (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d2"))
    least = spread.filter(F.col("d2") <= most * most).groupBy("map", "gx", "gy").agg(F.min("d2").alias("d2"))
    return cell.join(least, ["map", "gx", "gy"], "left").withColumn("d2", F.coalesce("d2", F.lit(most * most)))


def resampled(points: DataFrame, key: str, order: str, step: float) -> DataFrame:
    """(key, k, x, y): a polyline at every ``step`` of its arc length."""
    w = Window.partitionBy(key).orderBy(order)
    s = points.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).filter("nx IS NOT NULL")
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    s = s.withColumn("length", F.sqrt(dx * dx + dy * dy)).withColumn("after", F.sum("length").over(w)).filter("length > 0")
    before = F.col("after") - F.col("length")
    first, last = F.ceil(before / step), F.ceil(F.col("after") / step) - 1
    k = s.withColumn("before", before).filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    t = (F.col("k") * step - F.col("before")) / F.col("length")
    return k.select(key, "k", (F.col("x") + (F.col("nx") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("ny") - F.col("y")) * t).alias("y"))
