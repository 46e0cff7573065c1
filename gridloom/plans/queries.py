"""The registered queries of the grid, placement and rule operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import aggregates, fields, graph, raster, rules, spatial
from gridloom.plans.surrogates import SECTOR, SIDE, cells, flagged, points
from gridloom.session import table

QUERIES: dict = {}


def whole_map():
    return Window.partitionBy("map")


def query(f):
    QUERIES[f.__name__] = f
    return f


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(cells(spark, sf_dir))


@query
def tile_coverage(spark, sf_dir):
    n = cells(spark, sf_dir).groupBy("map", "t").agg(F.count(F.lit(1)).alias("n"))
    painted = F.sum(F.when(F.col("t") > 0, F.col("n"))).over(whole_map())
    return n.select("map", "t", "n", (F.col("n") / F.sum("n").over(whole_map())).alias("of_valid"), F.when(F.col("t") > 0, F.col("n") / painted).alias("of_painted"))


@query
def attr_flag_coverage(spark, sf_dir):
    on = [F.count_if(F.col("attr").bitwiseAND(1 << bit) != 0).alias(f"b{bit}") for bit in range(8)]
    counts = cells(spark, sf_dir).groupBy("map").agg(F.count(F.lit(1)).alias("all"), *on)
    bits = F.array(*[F.struct(F.lit(bit).alias("bit"), F.col(f"b{bit}").alias("n")) for bit in range(8)])
    return counts.select("map", "all", F.explode(bits).alias("b")).select("map", "b.bit", "b.n", (F.col("b.n") / F.col("all")).alias("share"))


@query
def attr_bytes(spark, sf_dir):
    return aggregates.shares_of(cells(spark, sf_dir), ["map", "attr"], ["map"])


@query
def slope_histogram(spark, sf_dir):
    return aggregates.histogram(raster.slopes(cells(spark, sf_dir)), ["map"], F.col("slope"), 0.0, 5.0, 18)


@query
def hist_percentiles(spark, sf_dir):
    hist = aggregates.histogram(cells(spark, sf_dir), ["map"], F.col("h"), 0, 10, 60)
    return aggregates.histogram_percentiles(hist, ["map"], 0.0, 10.0, (0.05, 0.5, 0.95))


@query
def exact_percentiles(spark, sf_dir):
    at = lambda q, name: F.percentile("h", F.lit(q)).alias(name)
    return cells(spark, sf_dir).groupBy("map").agg(at(0.05, "p5"), at(0.25, "p25"), at(0.5, "p50"), at(0.75, "p75"), at(0.95, "p95"))


@query
def weighted_quantiles(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("w", F.col("t") + 1)
    return aggregates.weighted_quantiles(c, ["map"], "h", "w", (0.1, 0.5, 0.9))


@query
def quantisation_stats(spark, sf_dir):
    by_value = cells(spark, sf_dir).groupBy("map", "h").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("map").orderBy("h")
    gaps = by_value.withColumns({"gap": F.lead("h").over(w) - F.col("h"), "least": F.min("h").over(whole_map())})
    divisor = "aggregate(collect_set(h - least), 0L, (a, b) -> aggregate(sequence(1, 64), named_struct('x', a, 'y', b), (s, i) -> if(s.y = 0, s, named_struct('x', s.y, 'y', s.x % if(s.y = 0, 1, s.y))), s -> s.x))"
    return gaps.groupBy("map").agg(
        F.count(F.lit(1)).alias("distinct_h"),
        F.max_by("h", F.struct("n", (-F.col("h")).alias("o"))).alias("modal_h"),
        (F.max("n") / F.sum("n")).alias("modal_share"),
        (F.sum(F.when(F.col("h") % 5 == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("of_five"),
        F.expr(divisor).alias("divisor"),
        F.min("gap").alias("least_gap"),
        F.percentile("gap", F.lit(0.5)).alias("median_gap"),
    )


@query
def coverage_entropy(spark, sf_dir):
    n = aggregates.shares_of(cells(spark, sf_dir).filter("t > 0"), ["map", "t"], ["map"])
    bits = -F.sum(F.col("share") * F.log2("share"))
    return n.groupBy("map").agg(F.round(bits, 6).alias("bits"), F.round(F.pow(F.lit(2.0), bits), 6).alias("effective"))


EDGES = (0, 5, 10, 15, 20, 25, 30, 35, 40, 50, 60)


@query
def block_by_slope_band(spark, sf_dir):
    band = F.lit(0)
    for i, e in enumerate(EDGES):
        band = F.when(F.col("slope") >= e, i).otherwise(band)
    return raster.slopes(grid(spark, sf_dir)).groupBy("map", band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("block").alias("blocked"), (F.count_if("block") / F.count(F.lit(1))).alias("share")
    )


@query
def roc_sweep_youden(spark, sf_dir):
    return aggregates.threshold_sweep(raster.slopes(grid(spark, sf_dir)), ["map"], F.col("slope"), F.col("block"), 80)


@query
def p50_crossing(spark, sf_dir):
    bins = raster.slopes(grid(spark, sf_dir)).groupBy("map", F.floor("slope").cast("int").alias("degree")).agg(F.count(F.lit(1)).alias("n"), F.count_if("block").alias("b"))
    fits = (F.col("n") >= 20) & (2 * F.col("b") >= F.col("n"))
    return bins.groupBy("map").agg(F.min(F.when(fits, F.col("degree"))).alias("degree"))


@query
def block_budget(spark, sf_dir):
    near = raster.halo(grid(spark, sf_dir), F.col("t") == 7, 1)
    out = (F.col("gx") < 4) | (F.col("gx") > SIDE - 5) | (F.col("gy") < 4) | (F.col("gy") > SIDE - 5)
    cause = F.when(F.col("h") > 80, "slope").when(F.col("water"), "water").when(F.col("near"), "halo").when(out, "out_of_bounds").otherwise("residual")
    return aggregates.shares_of(near.filter("block").withColumn("cause", cause), ["map", "cause"], ["map"])


@query
def mask_agreement(spark, sf_dir):
    a, b = F.col("block"), F.col("water")
    n = grid(spark, sf_dir).groupBy("map").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_block"), F.count_if(~a & b).alias("only_water"))
    both, one, two = F.col("both"), F.col("only_block"), F.col("only_water")
    return n.withColumns({"jaccard": scalar.share(both, both + one + two), "precision": scalar.share(both, both + one), "recall": scalar.share(both, both + two)})


@query
def clark_evans(spark, sf_dir):
    p = points(spark, sf_dir)
    near = spatial.nearest(p, 0.05).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.sqrt("same")).alias("mean_nn"))
    area = p.groupBy("label").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    r = F.col("mean_nn") * 2 * F.sqrt(F.col("n") / F.col("area"))
    kind = F.when(r < 0.9, "clumped").when(r > 1.1, "spread").otherwise("random")
    return near.join(area, "label").filter("n >= 8 AND area > 0").select("label", "n", F.round(r, 6).alias("r"), kind.alias("verdict"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("map"), (F.col("l_partkey") % 360).alias("heading"))


@query
def circular_stats(spark, sf_dir):
    a = F.radians("heading")
    m = headings(spark, sf_dir).groupBy("map").agg(F.count(F.lit(1)).alias("n"), F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"))
    r = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    return m.select("map", "n", F.round(F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)), 4).alias("mean"), F.round(r, 6).alias("resultant"), F.round(F.exp(-F.col("n") * r * r), 6).alias("rayleigh_p"))


@query
def snap_shares(spark, sf_dir):
    on = lambda step: (F.count_if(scalar.snap_residual(F.col("heading").cast("double"), step) < 0.5) / F.count(F.lit(1))).alias(f"on_{int(step)}")
    return headings(spark, sf_dir).groupBy("map").agg(on(15.0), on(45.0), on(90.0), (F.count_if(F.col("heading") != 0) / F.count(F.lit(1))).alias("turned"))


@query
def heading_histogram(spark, sf_dir):
    return aggregates.histogram(headings(spark, sf_dir), ["map"], F.col("heading"), 0, 10, 36)


def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.radius_pairs(points(spark, sf_dir), 0.05)


@query
def radius_pairs(spark, sf_dir):
    return close_pairs(spark, sf_dir).select("a", "b", F.round("d2", 12).alias("d2"))


@query
def cooccurrence_lift(spark, sf_dir):
    p = points(spark, sf_dir)
    seen = close_pairs(spark, sf_dir).groupBy(F.least("a_label", "b_label").alias("la"), F.greatest("a_label", "b_label").alias("lb")).agg(F.count(F.lit(1)).alias("obs"))
    n = p.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    area = p.agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    both = seen.join(n.select(F.col("label").alias("la"), F.col("n").alias("na")), "la").join(n.select(F.col("label").alias("lb"), F.col("n").alias("nb")), "lb").join(F.broadcast(area))
    chance = F.when(F.col("la") == F.col("lb"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    expected = chance * F.pi() * 0.05 * 0.05 / F.col("area")
    return both.select("la", "lb", "obs", F.round(expected, 6).alias("expected"), F.round(F.col("obs") / expected, 6).alias("lift"))


@query
def affinity_lift(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = items.groupBy(F.col("p_brand").alias("id"), F.col("l_returnflag").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    w, c, everything = Window.partitionBy("id"), Window.partitionBy("class"), Window.partitionBy()
    base = F.sum("n").over(c) / F.sum("n").over(everything)
    return n.select("id", "class", "n", (F.col("n") / F.sum("n").over(w)).alias("share"), base.alias("baseline")).withColumn("lift", F.round(F.col("share") / F.col("baseline"), 9))


@query
def density_by_group(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.groupBy("map").agg(F.count_if(F.col("t") > 0).alias("placed"), F.count(F.lit(1)).alias("area")).withColumn("per_hectare", F.col("placed") * 10000 / F.col("area"))


@query
def vocabulary_coverage(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.col("n").desc(), "l_partkey").limit(1000)
    run = Window.orderBy(F.col("n").desc(), "l_partkey")  # 1000 rows
    ranked = top.select(F.row_number().over(run).alias("k"), F.sum("n").over(run).alias("covered"))
    return ranked.filter(F.col("k").isin(25, 50, 100, 250, 500, 1000)).join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("k", "covered", (F.col("covered") / F.col("all")).alias("share"))


@query
def sector_relief(spark, sf_dir):
    s = raster.slopes(cells(spark, sf_dir)).withColumns({"sx": F.floor(F.col("gx") / SECTOR).cast("int"), "sy": F.floor(F.col("gy") / SECTOR).cast("int")})
    return s.groupBy("map", "sx", "sy").agg(
        (F.max("h") - F.min("h")).alias("relief"), F.round(F.percentile("slope", F.lit(0.5)), 6).alias("p50"), F.round(F.max("slope"), 6).alias("steepest"),
        (F.count_if(F.col("slope") < 5) / F.count(F.lit(1))).alias("flat"),
    )


def borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map, axis, sx, sy, d): height steps across the borders of neighbouring sectors."""
    c = cells(spark, sf_dir)
    east = c.withColumn("o", F.lead("h").over(raster.along_row())).filter((F.col("gx") % SECTOR == SECTOR - 1) & F.col("o").isNotNull()).withColumn("axis", F.lit("x"))
    south = c.withColumn("o", F.lead("h").over(raster.along_column())).filter((F.col("gy") % SECTOR == SECTOR - 1) & F.col("o").isNotNull()).withColumn("axis", F.lit("y"))
    sector = lambda k: F.floor(F.col(k) / SECTOR).cast("int")
    return east.unionByName(south).select("map", "axis", sector("gx").alias("sx"), sector("gy").alias("sy"), F.abs(F.col("h") - F.col("o")).alias("d"))


@query
def seam_agreement(spark, sf_dir):
    return borders(spark, sf_dir).groupBy("map", "axis").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") == 0).alias("exact"), F.count_if(F.col("d") <= 1).alias("within_one"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.99)).alias("p99"), F.max("d").alias("most")
    )


@query
def torn_borders(spark, sf_dir):
    m = borders(spark, sf_dir).groupBy("map", "axis", "sx", "sy").agg(F.percentile("d", F.lit(0.5)).alias("median"))
    return m.filter("median > 10")


@query
def plane_fit(spark, sf_dir):
    u, v, h = 2 * F.col("gx") - (SIDE - 1), 2 * F.col("gy") - (SIDE - 1), F.col("h")
    s = cells(spark, sf_dir).groupBy("map").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("sh"), F.sum(h * h).alias("shh"), F.sum(u * h).alias("suh"), F.sum(v * h).alias("svh"), F.sum(u * u).alias("suu"))
    # The grid is complete, so the axes are orthogonal and each slope stands alone.
    a, b = F.col("suh") / F.col("suu"), F.col("svh") / F.col("suu")
    total = F.col("shh") - F.col("sh") * F.col("sh") / F.col("n")
    left = total - a * F.col("suh") - b * F.col("svh")
    return s.select("map", F.round(a * (SIDE - 1), 6).alias("east"), F.round(b * (SIDE - 1), 6).alias("south"), F.round(F.col("sh") / F.col("n"), 6).alias("mean"), F.round(left / total, 6).alias("residual"))


@query
def laplacian_roughness(spark, sf_dir):
    n = raster.neighbours(cells(spark, sf_dir), "h")
    lap = F.abs(F.col("h_w") + F.col("h_e") + F.col("h_n") + F.col("h_s") - 4 * F.col("h"))
    return n.groupBy("map").agg(F.count(lap).alias("n"), F.sum(lap).alias("total"), F.max(lap).alias("most"))


@query
def box_std(spark, sf_dir):
    w = raster.window_sums(cells(spark, sf_dir), {"s": F.col("h"), "q": F.col("h") * F.col("h")}).filter("n = 9")
    return w.groupBy("map").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg(F.sqrt((9 * F.col("q") - F.col("s") * F.col("s")) / 81)), 6).alias("mean_std"))


@query
def rollup_three_grains(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    grains = c.groupingSets([["r_name", "n_name"], ["r_name"], []], "r_name", "n_name")
    return grains.agg(F.grouping_id().cast("int").alias("grain"), F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("c_acctbal")).cast("bigint")).alias("balance"))


@query
def run_lengths(spark, sf_dir):
    w = Window.partitionBy("map", "gy", "t").orderBy("gx")
    runs = cells(spark, sf_dir).withColumn("island", F.col("gx") - F.row_number().over(w)).groupBy("map", "gy", "t", "island").agg(F.count(F.lit(1)).alias("length"))
    return runs.groupBy("map").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.avg("length").alias("mean"), F.percentile("length", F.lit(0.5)).alias("median"))


@query
def event_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    same = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    runs = e.withColumn("island", F.row_number().over(order) - F.row_number().over(same)).groupBy("user_id", "event_type", "island").agg(F.count(F.lit(1)).alias("length"))
    return runs.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.sum("length").alias("events"))


@query
def top_n_per_group(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.top_n(n, ["l_returnflag"], [F.col("n").desc(), F.col("l_partkey")], 10)


@query
def adjacency_pairs(spark, sf_dir):
    c = cells(spark, sf_dir)
    e = c.select("map", "t", F.lead("t").over(raster.along_row()).alias("o"))
    s = c.select("map", "t", F.lead("t").over(raster.along_column()).alias("o"))
    return e.unionAll(s).filter("o IS NOT NULL").groupBy("map", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query
def perimeter_compactness(spark, sf_dir):
    n = raster.neighbours(cells(spark, sf_dir), "t", default=-1)
    sides = sum(((F.col(f"t_{d}") != F.col("t")).cast("int") for d in "wens"), F.lit(0))
    p = n.groupBy("map", "t").agg(F.count(F.lit(1)).alias("area"), F.sum(sides).alias("perimeter"))
    return p.withColumn("compactness", F.round(4 * F.sqrt(F.col("area").cast("double")) / F.col("perimeter"), 9))


@query
def splat_edge_density(spark, sf_dir):
    n = raster.neighbours(cells(spark, sf_dir), "t")
    edge = (F.col("t_e") != F.col("t")).cast("int")
    inside = (F.col("t_w") == F.col("t")) & (F.col("t_e") == F.col("t")) & (F.col("t_n") == F.col("t")) & (F.col("t_s") == F.col("t"))
    return n.groupBy("map").agg(F.avg(edge).alias("edge_density"), (F.count_if(inside) / F.count(F.lit(1))).alias("interior"))


@query
def erode_survival(spark, sf_dir):
    mask = cells(spark, sf_dir).select("map", "gx", "gy", (F.col("h") % 4 == 0).cast("int").alias("o0"))
    off = fields.reached(fields.reached(mask, "o0", "o1"), "o1", "o2")  # erosion is the growth of the complement
    return off.groupBy("map").agg(*[F.count_if(F.col(f"o{n}") == 0).alias(f"e{n}") for n in range(3)])


@query
def alpha_bleed(spark, sf_dir):
    """Cells opaque for each index: equal, or higher with an equal neighbour of 8."""
    return fields.opaque_slots(cells(spark, sf_dir), 7)


@query
def rim_specks(spark, sf_dir):
    """Cells of an index with at most one equal neighbour of 4."""
    n = raster.neighbours(cells(spark, sf_dir), "t", default=-1)
    same = sum(((F.col(f"t_{d}") == F.col("t")).cast("int") for d in "wens"), F.lit(0))
    return n.groupBy("map", "t").agg(F.count_if(same <= 1).alias("specks"), F.count(F.lit(1)).alias("n"))


@query
def downsample_any(spark, sf_dir):
    return raster.halved(grid(spark, sf_dir), "block").groupBy("map").agg(F.count_if(F.col("set") >= 1).alias("any"), F.count_if(F.col("set") == F.col("n")).alias("every"))


@query
def downsample_majority(spark, sf_dir):
    return raster.halved(grid(spark, sf_dir), "block").groupBy("map").agg(F.count_if(F.col("set") >= 2).alias("half"))


@query
def chebyshev_halo(spark, sf_dir):
    return raster.halo(cells(spark, sf_dir), F.col("h") % 50 == 49, 2).groupBy("map").agg(F.count_if("near").alias("near"))


@query
def isolated_points(spark, sf_dir):
    solid = cells(spark, sf_dir).filter("h % 50 = 49")
    return spatial.isolated(solid, 2).select("map", "gx", "gy")


@query
def nearest_neighbours(spark, sf_dir):
    n = spatial.nearest(points(spark, sf_dir), 0.05)
    return n.select("id", "label", F.round("same", 12).alias("same"), F.round("other", 12).alias("other"))


@query
def missing_registry(spark, sf_dir):
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").filter("p_size > 5")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_anti").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query
def registry_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_partkey")
    known = table(spark, sf_dir, "part").filter("p_size > 5").select("p_partkey", "p_brand")
    return items.join(known, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy(F.coalesce("p_brand", F.lit("(unresolved)")).alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query
def bag_difference(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    bag = lambda s: items.filter(F.col("l_linestatus") == s).select("l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    one, two = bag("F"), bag("O")
    count = lambda d, side: d.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return count(one.exceptAll(two), "only_f").unionByName(count(two.exceptAll(one), "only_o"))


@query
def companions_topk(spark, sf_dir):
    return spatial.companions(close_pairs(spark, sf_dir), 10)


def wet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("map", "gx", "gy", (F.col("h") % 3 != 0).alias("m"))


@query
def connected_components(spark, sf_dir):
    return graph.components(wet(spark, sf_dir), "m").groupBy("map", "component").agg(F.count(F.lit(1)).alias("size"))


@query
def largest_component(spark, sf_dir):
    sizes = connected_components(spark, sf_dir)
    return sizes.groupBy("map").agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("components"), F.count_if(F.col("size") == 1).alias("single"), (F.max("size") / F.sum("size")).alias("largest_share"))


@query
def border_mass(spark, sf_dir):
    c = graph.components(wet(spark, sf_dir), "m")
    edge = c.groupBy("map", "component").agg(F.count(F.lit(1)).alias("n"), F.max(((F.col("gx") == 0) | (F.col("gy") == 0) | (F.col("gx") == SIDE - 1) | (F.col("gy") == SIDE - 1)).cast("int")).alias("edge"))
    return edge.groupBy("map").agg(F.sum(F.col("n") * F.col("edge")).alias("border"), F.sum(F.col("n") * (1 - F.col("edge"))).alias("inner"))


@query
def component_shapes(spark, sf_dir):
    c = graph.components(wet(spark, sf_dir), "m").groupBy("map", "component").agg(F.count(F.lit(1)).alias("n"), (F.max("gx") - F.min("gx") + 1).alias("w"), (F.max("gy") - F.min("gy") + 1).alias("d"))
    fill = F.col("n") / (F.col("w") * F.col("d"))
    aspect = F.col("w") / F.col("d")
    kind = F.when(fill >= 0.97, "rect").when(fill.between(0.72, 0.85) & aspect.between(0.9, 1.111), "circle").otherwise("irregular")
    return c.filter("n >= 4").groupBy("map", kind.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query
def graph_invariants(spark, sf_dir):
    """Vertices, 4-neighbour edges, components and independent cycles of a mask."""
    m = raster.neighbours(wet(spark, sf_dir), "m", default=False)
    ve = m.groupBy("map").agg(F.count_if("m").alias("v"), F.sum(((F.col("m") & F.col("m_e")).cast("int") + (F.col("m") & F.col("m_s")).cast("int"))).alias("e"))
    c = connected_components(spark, sf_dir).groupBy("map").agg(F.count(F.lit(1)).alias("c"))
    return ve.join(c, "map").withColumn("cycles", F.col("e") - F.col("v") + F.col("c"))


@query
def findings_union(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c = cells(spark, sf_dir)
    deep = items.filter("l_discount > 0.09 AND l_quantity >= 50")
    lone = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    torn = torn_borders(spark, sf_dir)
    tiles = c.filter("t = 7 AND h > 150")
    return rules.report(
        rules.finding(deep.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")), "ARD-002", "major", F.col("l_orderkey"), "count mismatch", F.col("n"), "recount"),
        rules.finding(lone, "SEC-001", "blocker", F.col("o_orderkey"), "no sectors", F.col("o_orderstatus"), "add sectors"),
        rules.finding(torn, "HGT-001", "major", F.concat_ws("/", "map", "axis", "sx", "sy"), "torn border", F.floor("median"), "weld"),
        rules.finding(tiles, "TIL-001", "minor", F.concat_ws("/", "map", "gx", "gy"), "tile index above count", F.col("t"), "repaint"),
    )


@query
def findings_by_severity(spark, sf_dir):
    return findings_union(spark, sf_dir).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))


@query
def duration_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat((F.col("event_id") % 3).cast("string"), F.lit("h"), (F.col("event_id") % 60).cast("string"), F.lit("m"), (F.col("user_id") % 60).cast("string"), F.when(F.col("event_id") % 2 == 0, "s").otherwise(""))
    return e.select("event_id", text.alias("text"), scalar.duration_seconds(text).alias("seconds"))



@query
def stream_seeds(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", scalar.stream_seed("terrain", F.col("n_nationkey") + 4242).alias("seed"))


def kernel(spark, sf_dir, f, schema):
    return graph.per_map(grid(spark, sf_dir), f, schema)


@query
def chamfer_distance(spark, sf_dir):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        d = graph.chamfer(graph.dense(g, "t") == 7)
        y, x = np.indices(d.shape)
        return pd.DataFrame({"map": g["map"].iloc[0], "gx": x.ravel(), "gy": y.ravel(), "distance": d.ravel()})

    return kernel(spark, sf_dir, run, "map string, gx int, gy int, distance double")


@query
def thin_skeleton(spark, sf_dir):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        y, x = np.nonzero(graph.thinned(graph.dense(g, "h") % 3 != 0))
        return pd.DataFrame({"map": g["map"].iloc[0], "gx": x, "gy": y})

    return kernel(spark, sf_dir, run, "map string, gx int, gy int")


@query
def quadratic_form(spark, sf_dir):
    return kernel(spark, sf_dir, lambda g: pd.DataFrame([{"map": g["map"].iloc[0], **graph.quadratic_form(graph.dense(g, "h"))}]), "map string, low double, high double, form string")


@query
def spectrum(spark, sf_dir):
    return kernel(spark, sf_dir, lambda g: pd.DataFrame({"map": g["map"].iloc[0], "band": range(4), "share": graph.radial_power(graph.dense(g, "h"))}), "map string, band int, share double")


@query
def dijkstra_route(spark, sf_dir):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        cost = 1 + np.where(graph.dense(g, "block"), 60.0, graph.dense(g, "h") / 300)
        total, path = graph.route(cost, (0, 0), (SIDE - 1, SIDE - 1))
        return pd.DataFrame({"map": g["map"].iloc[0], "step": range(len(path)), "gx": [p[1] for p in path], "gy": [p[0] for p in path], "total": total})

    return kernel(spark, sf_dir, run, "map string, step int, gx int, gy int, total double")


@query
def poisson_scatter(spark, sf_dir):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        name = g["map"].iloc[0]
        spots = graph.scatter(~graph.dense(g, "block"), 3.0, sum(name.encode()))
        return pd.DataFrame({"map": name, "gx": spots[:, 1], "gy": spots[:, 0]})

    return kernel(spark, sf_dir, run, "map string, gx int, gy int")


@query
def fbm_terrain(spark, sf_dir):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        name = g["map"].iloc[0]
        z = graph.value_noise((SIDE, SIDE), sum(name.encode()))
        y, x = np.indices(z.shape)
        return pd.DataFrame({"map": name, "gx": x.ravel(), "gy": y.ravel(), "raw": np.round(z.ravel() * 65535).astype(np.int32)})

    return kernel(spark, sf_dir, run, "map string, gx int, gy int, raw int")


@query
def frac_below(spark, sf_dir):
    """Share of cells in the bins wholly below a height."""
    hist = aggregates.histogram(cells(spark, sf_dir), ["map"], F.col("h"), 0, 10, 60)
    return hist.groupBy("map").agg((F.sum(F.when(F.col("bin") < 5, F.col("n")).otherwise(0)) / F.sum("n")).alias("below_50"))


@query
def edge_list_histogram(spark, sf_dir):
    """Half-open ranges of a list of edges, the last one closed."""
    edges = (0, 10, 25, 50, 100, 400)
    band = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        top = (F.col("h") <= edges[i + 1]) if i == len(edges) - 2 else (F.col("h") < edges[i + 1])
        band = F.when((F.col("h") >= edges[i]) & top, i).otherwise(band)
    return cells(spark, sf_dir).groupBy("map", band.alias("band")).agg(F.count(F.lit(1)).alias("n")).filter("band IS NOT NULL")


@query
def repeated_median(spark, sf_dir):
    """Median of the height, each value as often as its tile index, at least once."""
    c = cells(spark, sf_dir).filter("t > 0")
    return c.groupBy("map").agg(F.percentile("h", F.lit(0.5), F.greatest(F.col("t"), F.lit(1)).cast("bigint")).alias("median"))


@query
def style_split(spark, sf_dir):
    flat = raster.slopes(grid(spark, sf_dir)).filter("NOT water AND slope < 20").groupBy("map").agg((F.count_if("block") / F.count(F.lit(1))).alias("rate"))
    return flat.withColumn("style", F.when(F.col("rate") < 0.25, "slope_driven").otherwise("painted_box"))


@query
def control_lift(spark, sf_dir):
    """Block rate under tiles of index 7 against four probes shifted by six cells."""
    c = grid(spark, sf_dir)
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("probe")) for dx, dy, k in ((0, 0, 0), (6, 0, 1), (-6, 0, 1), (0, 6, 1), (0, -6, 1))])
    probes = c.filter("t = 7").select("map", "gx", "gy", F.explode(shifts).alias("s")).select("map", (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"), "s.probe")
    rate = lambda k: F.sum(F.when(F.col("probe") == k, F.col("block").cast("int"))) / F.count_if(F.col("probe") == k)
    return probes.join(c.select("map", "gx", "gy", "block"), ["map", "gx", "gy"]).groupBy("map").agg(rate(0).alias("rate"), rate(1).alias("control"), F.round(rate(0) / rate(1), 9).alias("lift"))


@query
def footprint_check(spark, sf_dir):
    """Median of the mean size per id over its registered size, ids with three or more."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.percentile("l_quantity", F.lit(0.5)).alias("q")).filter("n >= 3")
    both = items.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy("p_brand").agg(F.count(F.lit(1)).alias("ids"), F.percentile(F.col("q") / F.col("p_size"), F.lit(0.5)).alias("ratio"))


@query
def server_compare(spark, sf_dir):
    """Low flag bits of a grid against its 2 x 2 finer copy with some cells changed."""
    c = cells(spark, sf_dir)
    two = F.sequence(F.lit(0), F.lit(1))
    fine = c.select("map", "gx", "gy", "h", F.col("attr").bitwiseAND(7).alias("low"), F.explode(two).alias("ox")).select("*", F.explode(two).alias("oy"))
    fine = fine.select("map", (F.col("gx") * 2 + F.col("ox")).alias("fx"), (F.col("gy") * 2 + F.col("oy")).alias("fy"), F.when((F.col("h") % 97 == 5) & (F.col("ox") == 1), 0).otherwise(F.col("low")).alias("server"))
    near = fine.withColumns({"gx": F.floor(F.col("fx") / 2).cast("int"), "gy": F.floor(F.col("fy") / 2).cast("int")})
    both = near.join(c.select("map", "gx", "gy", F.col("attr").bitwiseAND(7).alias("client")), ["map", "gx", "gy"])
    return both.groupBy("map").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("server") != F.col("client")).alias("differ"), F.max("server").alias("most"))


@query
def patch_scan(spark, sf_dir):
    """Overlapping 16 x 16 patches at stride 8: every cell falls into four at most."""
    c = cells(spark, sf_dir)
    at = lambda k: F.filter(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.floor(F.col(k) / 8).cast("int") - i), lambda p: (p >= 0) & (p <= 6))
    spread = c.select("map", "h", F.explode(at("gx")).alias("px"), "gy").select("map", "h", "px", F.explode(at("gy")).alias("py"))
    patches = spread.groupBy("map", "px", "py").agg(F.count(F.lit(1)).alias("n"), (F.max("h") - F.min("h")).alias("relief"), F.sum("h").alias("total"))
    return aggregates.top_n(patches.filter("n = 256"), ["map"], [F.col("relief").desc(), F.col("total").desc(), F.col("px"), F.col("py")], 2)


@query
def even_samples(spark, sf_dir):
    """Every step-th part of a brand in order, eight at most."""
    p = table(spark, sf_dir, "part")
    w = Window.partitionBy("p_brand")
    r = p.select("p_brand", "p_partkey", (F.row_number().over(w.orderBy("p_partkey")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 8))
    return r.filter((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < 8)).select("p_brand", "p_partkey")


@query
def palette_sets(spark, sf_dir):
    """Declared and used indices: the differences both ways."""
    used = cells(spark, sf_dir).filter("t > 0").groupBy("map").agg(F.collect_set("t").alias("used"))
    declared = F.array(*[F.lit(i) for i in (1, 2, 3, 5, 6, 9)])
    listed = lambda a: F.concat_ws(",", F.transform(F.array_sort(a), lambda x: x.cast("string")))
    return used.select("map", listed(F.array_except(declared, F.col("used"))).alias("unused"), listed(F.array_except("used", declared)).alias("undeclared"), F.size(F.array_intersect("used", declared)).alias("both"))


@query
def submerged_masks(spark, sf_dir):
    """Two readings of "under water at 40": lowest of four corners, or the corner itself."""
    c = raster.neighbours(cells(spark, sf_dir), "h").withColumn("h_se", F.lead("h_e").over(raster.along_column()))
    low = F.least("h", "h_e", "h_s", "h_se")
    return c.filter("h_se IS NOT NULL").groupBy("map").agg(F.count_if(low < 40).alias("lowest"), F.count_if(F.col("h") < 40).alias("corner"))


@query
def exposed_shore(spark, sf_dir):
    """Water cells of the interior with a neighbour that is dry and lower."""
    c = grid(spark, sf_dir)
    n = raster.neighbours(c, "h", "water").filter(f"water AND gx > 0 AND gy > 0 AND gx < {SIDE - 1} AND gy < {SIDE - 1}")
    shore = F.lit(False)
    bare = F.lit(False)
    for d in "wens":
        shore = shore | ~F.col(f"water_{d}")
        bare = bare | (~F.col(f"water_{d}") & (F.col(f"h_{d}") < F.col("h")))
    return n.groupBy("map").agg(F.count(F.lit(1)).alias("plane"), F.count_if(shore).alias("boundary"), F.count_if(bare).alias("exposed"))


@query
def ring_profile(spark, sf_dir):
    """Mean height by chessboard distance 0..4 from cells of a rare height."""
    near = fields.rings(cells(spark, sf_dir).withColumn("m", F.col("h") % 50 == 49), "m", 4)
    return near.groupBy("map", F.col("ring").cast("int").alias("ring")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("total"))


@query
def out_of_range_tiles(spark, sf_dir):
    """Indices above the count, and indices of empty slots."""
    kind = F.when(F.col("t") > 6, "above_count").when(F.col("t") == 4, "empty_slot")
    return cells(spark, sf_dir).withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("map", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def region_filters(spark, sf_dir):
    """Cells inside a disc, a box and a polygon (even-odd at cell centres)."""
    corners = ((5, 5), (50, 10), (40, 55), (10, 40))
    x, y = F.col("gx") + 0.5, F.col("gy") + 0.5
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / F.lit(float(y2 - y1)) + x1)
        crossings = crossings + hit.cast("int")
    disc = (F.col("gx") - 32) * (F.col("gx") - 32) + (F.col("gy") - 32) * (F.col("gy") - 32) <= 400
    return cells(spark, sf_dir).groupBy("map").agg(F.count_if(disc).alias("disc"), F.count_if(F.col("gx").between(8, 20) & F.col("gy").between(8, 20)).alias("box"), F.count_if(crossings % 2 == 1).alias("polygon"))


@query
def deep_unflagged(spark, sf_dir):
    """Maps whose low cells are mostly flagged as water, yet many are missed."""
    n = grid(spark, sf_dir).filter("h < 60").groupBy("map").agg(F.count(F.lit(1)).alias("deep"), F.count_if("water").alias("flagged"))
    return n.withColumn("finding", (F.col("deep") >= 100) & (2 * F.col("flagged") >= F.col("deep")) & (F.col("deep") - F.col("flagged") > 0.4 * F.col("deep")))


@query
def walkable_rock(spark, sf_dir):
    """Walkable share of steep tiles of the rock indices."""
    steep = raster.slopes(grid(spark, sf_dir)).filter("slope >= 25 AND t >= 5")
    return steep.groupBy("map").agg(F.count(F.lit(1)).alias("n"), (F.count_if(~F.col("block")) / F.count(F.lit(1))).alias("walkable"))


@query
def spawn_zone_audit(spark, sf_dir):
    """Walkable share of the zone around each supplier's square; zones outside; empty ones."""
    name = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("map"), ((F.col("s_suppkey") * 7) % 70).cast("int").alias("cx"), ((F.col("s_suppkey") * 13) % 70).cast("int").alias("cy"))
    span = lambda k: F.sequence(F.col(k) - 2, F.col(k) + 2)
    zone = s.select("s_suppkey", "map", F.explode(span("cx")).alias("gx"), "cy").select("s_suppkey", "map", "gx", F.explode(span("cy")).alias("gy"))
    met = zone.join(grid(spark, sf_dir).select("map", "gx", "gy", "block"), ["map", "gx", "gy"], "left").groupBy("s_suppkey").agg(F.count("block").alias("inside"), F.count_if(~F.col("block")).alias("free"))
    kind = F.when(F.col("inside") < 25, "outside").when(F.col("free") < 0.6 * F.col("inside"), "blocked").otherwise("fine")
    return met.groupBy(kind.alias("finding")).agg(F.count(F.lit(1)).alias("zones"))


@query
def sector_blocks(spark, sf_dir):
    """Sectors that hang together over borders whose median step is at most sixty."""
    m = borders(spark, sf_dir).groupBy("map", "axis", "sx", "sy").agg(F.percentile("d", F.lit(0.5)).alias("median")).filter("median <= 60")
    side = SIDE // SECTOR

    def run(g: pd.DataFrame) -> pd.DataFrame:
        block = list(range(side * side))
        for r in g.itertuples():
            a = r.sy * side + r.sx
            b = a + 1 if r.axis == "x" else a + side
            low, high = sorted((block[a], block[b]))
            block = [low if x == high else x for x in block]
        return pd.DataFrame({"map": g["map"].iloc[0], "sx": [i % side for i in range(side * side)], "sy": [i // side for i in range(side * side)], "block": block})

    return m.groupBy("map").applyInPandas(run, "map string, sx int, sy int, block int")


@query
def filled_holes(spark, sf_dir):
    """A mask with its holes: the complement's components that do not touch the border."""
    dry = cells(spark, sf_dir).select("map", "gx", "gy", (F.col("h") % 3 == 0).alias("m"))
    c = graph.components(dry, "m").withColumn("edge", ((F.col("gx") == 0) | (F.col("gy") == 0) | (F.col("gx") == SIDE - 1) | (F.col("gy") == SIDE - 1)).cast("int"))
    holes = c.groupBy("map", "component").agg(F.count(F.lit(1)).alias("n"), F.max("edge").alias("edge")).filter("edge = 0")
    return holes.groupBy("map").agg(F.count(F.lit(1)).alias("holes"), F.sum("n").alias("filled"))
