"""Grid measures in their full form: histograms, sweeps, borders, rings, samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import aggregates, fields, raster
from gridloom.plans.oracles import NEAREST, SLOPE
from gridloom.plans.surrogates import CELL, POINTS, SIDE, cells, flagged, points
from gridloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def n_rows():
    return F.count(F.lit(1))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(cells(spark, sf_dir))


# ---- distributions


@query
def histogram_moments(spark, sf_dir):
    """Exact moments next to a clamped histogram, with what fell outside it."""
    c = cells(spark, sf_dir)
    return fields.moments(c, ["map"], F.col("h"), 20, 10, 30)


SQL["histogram_moments"] = f"""
    WITH {CELL}
    SELECT map, count(*) AS n, avg(h) AS mean, round(stddev_pop(h), 7) AS std, min(h) AS least, max(h) AS greatest, count(*) FILTER (h < 20) AS below, count(*) FILTER (h >= 320) AS above,
           count(DISTINCT greatest(0, least((h - 20) // 10, 29))) AS used_bins FROM cell GROUP BY map"""


@query
def sweep_scores(spark, sf_dir):
    """Precision and F1 at every cut; the first best cut by F1 and by Youden's J."""
    s = aggregates.threshold_sweep(raster.slopes(grid(spark, sf_dir)), ["map"], F.col("slope"), F.col("block"), 80)
    return fields.scored(s, ["map"])


SQL["sweep_scores"] = f"""
    WITH {CELL}, {SLOPE},
    b AS (SELECT map, least(floor(slope), 80)::INTEGER AS cut, count(*) FILTER (block) AS pos, count(*) FILTER (NOT block) AS neg FROM slope GROUP BY 1, 2),
    d AS (SELECT m.map, i.cut, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM (SELECT DISTINCT map FROM b) m, (SELECT unnest(range(81))::INTEGER AS cut) i LEFT JOIN b ON m.map = b.map AND i.cut = b.cut),
    s AS (SELECT map, cut, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY map) AS p, sum(neg) OVER (PARTITION BY map) AS f FROM d WINDOW w AS (PARTITION BY map ORDER BY cut DESC)),
    r AS (SELECT map, cut, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fp + p > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END AS f1, CASE WHEN p > 0 THEN tp / p ELSE 0 END - CASE WHEN f > 0 THEN fp / f ELSE 0 END AS j FROM s)
    SELECT map, cut, precision, f1, row_number() OVER (PARTITION BY map ORDER BY f1 DESC, cut) = 1 AS best_f1, row_number() OVER (PARTITION BY map ORDER BY j DESC, cut) = 1 AS best_j FROM r"""


@query
def crossing_interpolated(spark, sf_dir):
    """Where the blocked share first crosses a half, interpolated between band centres."""
    band = F.floor(F.col("slope") / 4).cast("int")
    b = raster.slopes(grid(spark, sf_dir)).withColumn("block", F.col("block") & (F.col("slope") > 30) | (F.col("t") == 7)).groupBy("map", band.alias("band")).agg(F.avg(F.col("block").cast("int")).alias("share"))
    return fields.crossing(b.withColumn("centre", F.col("band") * 4.0 + 2).filter("band >= 1"), ["map"], "centre", "share", 0.5)


SQL["crossing_interpolated"] = f"""
    WITH {CELL}, {SLOPE},
    b AS (SELECT map, floor(slope / 4)::INTEGER AS band, avg((block AND slope > 30 OR t = 7)::INTEGER) AS f FROM slope GROUP BY 1, 2),
    p AS (SELECT map, band * 4.0::DOUBLE + 2 AS mid, f, lag(band * 4.0::DOUBLE + 2) OVER w AS pm, lag(f) OVER w AS pf FROM b WHERE band >= 1 WINDOW w AS (PARTITION BY map ORDER BY band)),
    k AS (SELECT *, row_number() OVER (PARTITION BY map ORDER BY mid) AS k FROM p WHERE f >= 0.5)
    SELECT map, round(CASE WHEN pf IS NULL THEN mid ELSE pm + (0.5 - pf) * (mid - pm) / (f - pf) END, 9) AS crossing FROM k WHERE k = 1"""


@query
def clark_evans_verdict(spark, sf_dir):
    """R, z and verdict of the nearest-neighbour distances of each label in the unit square."""
    p = points(spark, sf_dir)
    q = p.select(F.col("id").alias("o"), F.col("label").alias("o_label"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return fields.clark_evans(nearest_same(p, q), "label", "d", 1.0)


def nearest_same(p: DataFrame, q: DataFrame, reach: float = 0.5) -> DataFrame:
    """Distance to the nearest of the same label, where one is within ``reach``."""
    near = p.withColumn("bx", F.explode(F.array(*[F.floor(F.col("x") / reach) + i for i in (-1, 0, 1)]))).withColumn("by", F.explode(F.array(*[F.floor(F.col("y") / reach) + i for i in (-1, 0, 1)])))
    there = q.withColumns({"bx": F.floor(F.col("ox") / reach), "by": F.floor(F.col("oy") / reach)})
    pair = near.join(there, ["bx", "by"]).filter("o_label = label AND o <> id")
    d2 = (F.col("ox") - F.col("x")) * (F.col("ox") - F.col("x")) + (F.col("oy") - F.col("y")) * (F.col("oy") - F.col("y"))
    return pair.groupBy("id", "label").agg(F.sqrt(F.min(d2)).alias("d")).filter(F.col("d") <= reach)


SQL["clark_evans_verdict"] = f"""
    WITH {POINTS}, {NEAREST},
    g AS (SELECT label, count(*) AS n, avg(sqrt(same)) AS d FROM nn WHERE sqrt(same) <= 0.5 GROUP BY label HAVING count(*) >= 8),
    r AS (SELECT label, n, d, 0.5 / sqrt(n / 1.0::DOUBLE) AS e, 0.26136 / sqrt(n * n / 1.0::DOUBLE) AS se FROM g)
    SELECT label, n, round(d / e, 6) AS r, round((d - e) / se, 4) AS z, CASE WHEN d / e < 0.9 THEN 'clustered' WHEN d / e > 1.1 THEN 'regular' ELSE 'poisson' END AS verdict FROM r"""


@query
def heading_signs(spark, sf_dir):
    """Shares of headings at the grid's multiples, of turned objects, and of each sign."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("map"), (F.col("l_partkey") % 360).cast("double").alias("a"), (F.col("l_suppkey") % 21 - 10).alias("bias"))
    share = lambda c: F.avg(c.cast("int"))
    snap = [share(scalar.snap_residual(F.col("a"), float(s)) < 0.5).alias(f"snap_{s}") for s in (90, 45, 15)]
    return i.groupBy("map").agg(*snap, share(F.col("a") != 0).alias("turned"), share(F.col("bias") > 0).alias("raised"), share(F.col("bias") < 0).alias("sunk"))


SQL["heading_signs"] = """
    WITH i AS (SELECT l_returnflag AS map, l_partkey % 360 AS a, l_suppkey % 21 - 10 AS bias FROM lineitem)
    SELECT map, avg((a % 90 = 0)::INTEGER) AS snap_90, avg((a % 45 = 0)::INTEGER) AS snap_45, avg((a % 15 = 0)::INTEGER) AS snap_15, avg((a <> 0)::INTEGER) AS turned, avg((bias > 0)::INTEGER) AS raised, avg((bias < 0)::INTEGER) AS sunk FROM i GROUP BY map"""


@query
def relief_percentiles(spark, sf_dir):
    """Relief, slope quantiles and flat share of every sector."""
    s = raster.slopes(cells(spark, sf_dir)).withColumns({"sx": F.floor(F.col("gx") / 16), "sy": F.floor(F.col("gy") / 16)})
    q = lambda p: F.round(F.percentile("slope", F.lit(p)), 7)
    return s.groupBy("map", "sx", "sy").agg((F.max("h") - F.min("h")).alias("relief"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.round(F.max("slope"), 7).alias("steepest"), F.avg((F.col("slope") < 5).cast("int")).alias("flat"))


SQL["relief_percentiles"] = f"""
    WITH {CELL}, {SLOPE}
    SELECT map, gx // 16 AS sx, gy // 16 AS sy, max(h) - min(h) AS relief, round(quantile_cont(slope, 0.5), 7) AS p50, round(quantile_cont(slope, 0.95), 7) AS p95, round(max(slope), 7) AS steepest, avg((slope < 5)::INTEGER) AS flat FROM slope GROUP BY 1, 2, 3"""


@query
def density_units(spark, sf_dir):
    """Objects for each hectare, hundred square metres and sector of the present cells; proxies aside."""
    area = cells(spark, sf_dir).filter("t > 0").groupBy("map").agg(n_rows().alias("cells"), F.count_distinct(F.floor(F.col("gx") / 16), F.floor(F.col("gy") / 16)).alias("sectors"))
    placed = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 7").groupBy(F.col("l_returnflag").alias("map")).agg(n_rows().alias("n"))
    j = placed.join(area, "map")
    m2 = F.col("cells") * 4
    return j.select("map", (F.col("n") * 10000 / m2).alias("hectare"), (F.col("n") * 100 / m2).alias("hundred"), (F.col("n") / F.col("sectors")).alias("sector"))


SQL["density_units"] = f"""
    WITH {CELL},
    a AS (SELECT map, count(*) AS c, count(DISTINCT (gx // 16, gy // 16)) AS s FROM cell WHERE t > 0 GROUP BY map),
    p AS (SELECT l_returnflag AS map, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1)
    SELECT map, n * 10000 / (c * 4) AS hectare, n * 100 / (c * 4) AS hundred, n / s AS sector FROM p JOIN a USING (map)"""


@query
def affinity_never(spark, sf_dir):
    """Lift of every kind over each ground class, and the classes a frequent kind is never on."""
    i = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 8).alias("kind"), F.when((F.col("l_partkey") % 8 != 3) | (F.col("l_linenumber") != 2), F.col("l_linenumber")).otherwise(1).alias("ground"))
    return fields.affinity(i, "kind", "ground", 200)


SQL["affinity_never"] = """
    WITH i AS (SELECT l_partkey % 8 AS kind, CASE WHEN l_partkey % 8 <> 3 OR l_linenumber <> 2 THEN l_linenumber ELSE 1 END AS ground FROM lineitem),
    g AS (SELECT ground, count(*) AS base FROM i GROUP BY 1), k AS (SELECT kind, count(*) AS n FROM i GROUP BY 1), c AS (SELECT kind, ground, count(*) AS n FROM i GROUP BY 1, 2),
    x AS (SELECT k.kind, g.ground, coalesce(c.n, 0) AS obs, k.n * base / (SELECT count(*) FROM i) AS expected, base FROM k CROSS JOIN g LEFT JOIN c ON k.kind = c.kind AND g.ground = c.ground)
    SELECT kind, coalesce(array_to_string(list(ground ORDER BY ground) FILTER (obs = 0 AND base >= 200), ','), '') AS never, round(max(obs / expected), 9) AS top_lift, arg_max(ground, (obs / expected, -ground)) AS top_ground FROM x GROUP BY kind"""


RADII = (0.02, 0.05, 0.1)


@query
def pair_lifts(spark, sf_dir):
    """Observed against random pairs of labels at three radii, over the maps they share."""
    p = points(spark, sf_dir).withColumn("map", F.col("id") % 3)
    return fields.pair_lift(p, RADII, area=1.0, least=10, top=15)


SQL["pair_lifts"] = f"""
    WITH {POINTS},
    p AS (SELECT *, id % 3 AS map FROM point),
    r AS (SELECT unnest([0.02, 0.05, 0.1])::DOUBLE AS r),
    n AS (SELECT map, label, count(*) AS n FROM p GROUP BY 1, 2),
    o AS (
        SELECT r, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*) AS observed FROM r, p a JOIN p b ON a.map = b.map AND a.id < b.id
        WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= r * r GROUP BY ALL),
    e AS (
        SELECT r, a.label AS a, b.label AS b, sum(CASE WHEN a.label = b.label THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END * pi() * r * r / 1.0::DOUBLE) AS expected
        FROM r, n a JOIN n b ON a.map = b.map AND a.label <= b.label GROUP BY ALL),
    l AS (SELECT r, a, b, observed, expected, row_number() OVER (PARTITION BY r ORDER BY observed / expected DESC, a, b) AS k FROM o JOIN e USING (r, a, b) WHERE observed >= 10)
    SELECT r AS radius, a, b, observed, round(expected, 7) AS expected, round(observed / expected, 7) AS lift, a = b AS itself FROM l WHERE k <= 15"""


# ---- map edges


@query
def edge_run_sides(spark, sf_dir):
    """Blocked run inward from each of the four edges."""
    inward = fields.from_edges(grid(spark, sf_dir), SIDE)
    run = inward.groupBy("map", "side", "line").agg(F.coalesce(F.min(F.when(~F.col("block"), F.col("depth"))), F.lit(SIDE)).alias("run"))
    return run.groupBy("map", "side").agg(F.sum("run").alias("total"), F.max("run").alias("deepest"), F.percentile("run", F.lit(0.5)).alias("median"))


INWARD = f"""
    inward AS (
        SELECT map, 'west' AS side, gy AS line, gx AS depth, block FROM cell UNION ALL SELECT map, 'east', gy, {SIDE - 1} - gx, block FROM cell
        UNION ALL SELECT map, 'north', gx, gy, block FROM cell UNION ALL SELECT map, 'south', gx, {SIDE - 1} - gy, block FROM cell)"""
SQL["edge_run_sides"] = f"""
    WITH {CELL}, {INWARD},
    r AS (SELECT map, side, line, coalesce(min(depth) FILTER (NOT block), {SIDE}) AS run FROM inward GROUP BY 1, 2, 3)
    SELECT map, side, sum(run) AS total, max(run) AS deepest, quantile_cont(run, 0.5) AS median FROM r GROUP BY 1, 2"""


@query
def edge_band_sides(spark, sf_dir):
    """Width of the blocked band at each edge, strict and loose, and whether the map is sealed."""
    return fields.edge_bands(fields.from_edges(grid(spark, sf_dir), SIDE), SIDE, strict=0.60, loose=0.50)


SQL["edge_band_sides"] = f"""
    WITH {CELL}, {INWARD},
    s AS (SELECT map, side, depth, avg(block::INTEGER) AS share FROM inward GROUP BY 1, 2, 3),
    b AS (SELECT map, side, coalesce(min(depth) FILTER (share < 0.60), {SIDE}) AS strict, coalesce(min(depth) FILTER (share < 0.50), {SIDE}) AS loose FROM s GROUP BY 1, 2)
    SELECT *, min(loose) OVER (PARTITION BY map) > 0 AS sealed, max(loose) OVER (PARTITION BY map) >= {SIDE // 4} AS runaway FROM b"""


@query
def open_edge_runs(spark, sf_dir):
    """Edge stretches of four cells, judged on a band of three; the runs of open ones."""
    return fields.open_runs(fields.from_edges(grid(spark, sf_dir), SIDE), step=4, band=3)


SQL["open_edge_runs"] = f"""
    WITH {CELL}, {INWARD.replace("block FROM", "block, water, t, h FROM")},
    mid AS (SELECT map, quantile_cont(h, 0.5) AS ref FROM inward WHERE side = 'west' GROUP BY map),
    s AS (
        SELECT i.map, side, line // 4 AS nth, avg((t = 0)::INTEGER) AS bare, avg(water::INTEGER) AS wet, avg((NOT block)::INTEGER) AS free, quantile_cont(h, 0.5) - any_value(ref) AS lift
        FROM inward i JOIN mid m ON i.map = m.map WHERE depth < 3 GROUP BY 1, 2, 3),
    k AS (SELECT *, CASE WHEN bare > 0.5 THEN 'void' WHEN wet > 0.55 THEN 'water' WHEN lift > 40 OR free < 0.3 THEN 'wall' ELSE 'open' END AS kind FROM s),
    g AS (SELECT map, side, nth, nth - row_number() OVER (PARTITION BY map, side ORDER BY nth) AS island FROM k WHERE kind = 'open'),
    r AS (SELECT map, side, min(nth) * 4 AS first, count(*) * 4 AS length FROM g GROUP BY map, side, island)
    SELECT map, side, first, length, length > 16 AS finding FROM r"""


@query
def level_chains(spark, sf_dir):
    """Runs of used heights within the span of the value before and of the run's first; two at least."""
    used = cells(spark, sf_dir).filter("h % 3 = 0").groupBy("map").agg(F.array_sort(F.collect_set("h")).alias("levels"))
    return fields.level_groups(used, "map", "levels", 12)


# A greedy walk along the used heights, one recursive step a value.
SQL["level_chains"] = f"""
    WITH RECURSIVE {CELL.strip()},
    used AS (SELECT map, h, row_number() OVER (PARTITION BY map ORDER BY h) AS i FROM (SELECT DISTINCT map, h FROM cell WHERE h % 3 = 0)),
    walk AS (
        SELECT map, h, i, h AS first, 1 AS grp FROM used WHERE i = 1
        UNION ALL
        SELECT u.map, u.h, u.i, CASE WHEN u.h - w.h <= 12 AND u.h - w.first <= 12 THEN w.first ELSE u.h END, CASE WHEN u.h - w.h <= 12 AND u.h - w.first <= 12 THEN w.grp ELSE w.grp + 1 END
        FROM walk w JOIN used u ON u.map = w.map AND u.i = w.i + 1)
    SELECT map, min(h) AS low, max(h) AS high, count(*) AS levels FROM walk GROUP BY map, grp HAVING count(*) > 1"""


# ---- neighbourhoods


@query
def vertex_slopes(spark, sf_dir):
    """Central differences, one-sided at the edges: another slope than the square's."""
    v = fields.vertex_gradient(cells(spark, sf_dir), 200.0, 100.0)
    slope = F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))))
    return v.groupBy("map").agg(F.round(F.avg(slope), 7).alias("mean"), F.round(F.max(slope), 7).alias("steepest"), F.round(F.percentile(slope, F.lit(0.5)), 7).alias("median"))


GRADIENT = f"""
    lined AS (
        SELECT *, lag(h) OVER r AS w, lead(h) OVER r AS e, lag(h) OVER k AS n, lead(h) OVER k AS s FROM cell
        WINDOW r AS (PARTITION BY map, gy ORDER BY gx), k AS (PARTITION BY map, gx ORDER BY gy)),
    gradient AS (
        SELECT *, (coalesce(e, h) - coalesce(w, h)) * 100.0::DOUBLE / (200.0::DOUBLE * CASE WHEN w IS NULL OR e IS NULL THEN 1 ELSE 2 END) AS dx,
               (coalesce(s, h) - coalesce(n, h)) * 100.0::DOUBLE / (200.0::DOUBLE * CASE WHEN n IS NULL OR s IS NULL THEN 1 ELSE 2 END) AS dy FROM lined)"""
SQL["vertex_slopes"] = f"""
    WITH {CELL}, {GRADIENT},
    a AS (SELECT map, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope FROM gradient)
    SELECT map, round(avg(slope), 7) AS mean, round(max(slope), 7) AS steepest, round(quantile_cont(slope, 0.5), 7) AS median FROM a GROUP BY map"""


@query
def lit_ground(spark, sf_dir):
    """Lambert light from the gradient, in five-bit grey levels."""
    v = fields.vertex_gradient(cells(spark, sf_dir), 200.0, 10.0)
    light = fields.lambert(F.col("dx"), F.col("dy"), (-0.5, -0.5, 0.7071067811865476))
    return v.groupBy("map", F.floor(light * 31 + 0.0000001).cast("int").alias("grey")).agg(n_rows().alias("n"))


SQL["lit_ground"] = f"""
    WITH {CELL}, {GRADIENT.replace("100.0::DOUBLE /", "10.0::DOUBLE /")}
    SELECT map, floor(greatest(0.0, least(1.0, (dx * 0.5 + dy * 0.5 + 0.7071067811865476) / sqrt(dx * dx + dy * dy + 1))) * 31 + 0.0000001)::INTEGER AS grey, count(*) AS n FROM gradient GROUP BY 1, 2"""


@query
def bilinear_samples(spark, sf_dir):
    """Heights at fractional places from their four vertices."""
    p = points(spark, sf_dir).filter("x >= 0 AND y >= 0").select("id", (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y")).filter(f"x < {SIDE - 1} AND y < {SIDE - 1}")
    ground = cells(spark, sf_dir).filter("map = 'N'").select("gx", "gy", "h")
    return fields.bilinear(p, ground).select("id", F.round("h", 6).alias("h"))


SQL["bilinear_samples"] = f"""
    WITH {CELL}, {POINTS},
    p AS (SELECT id, x * 100 AS x, y * 100 AS y FROM point WHERE x >= 0 AND y >= 0 AND x * 100 < {SIDE - 1} AND y * 100 < {SIDE - 1}),
    w AS (SELECT id, gx, gy, h, (1 - abs(x - gx)) * (1 - abs(y - gy)) AS w FROM p JOIN cell ON map = 'N' AND gx IN (floor(x), floor(x) + 1) AND gy IN (floor(y), floor(y) + 1))
    SELECT id, round(sum(h * w), 6) AS h FROM w GROUP BY id"""


@query
def opened_closed(spark, sf_dir):
    """A mask opened and closed by 3 x 3; outside cells neither erode nor grow it."""
    m = cells(spark, sf_dir).select("map", "gx", "gy", (F.col("h") % 5 != 0).alias("m"))
    opened = fields.grow(fields.shrink(m, "m"), "m")
    closed = fields.shrink(fields.grow(opened, "m"), "m")
    n = lambda d, c: d.groupBy("map").agg(F.count_if("m").alias(c))
    return n(m, "raw").join(n(opened, "opened"), "map").join(n(closed, "closed"), "map")


def box(name: str, source: str, column: str, how: str) -> str:
    """3 x 3 minimum or maximum of a mask, as two windowed passes."""
    return f"""
    {name}_r AS (SELECT map, gx, gy, {how}({column}::INTEGER) OVER (PARTITION BY map, gy ORDER BY gx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM {source}),
    {name} AS (SELECT map, gx, gy, {how}(m) OVER (PARTITION BY map, gx ORDER BY gy ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM {name}_r)"""


SQL["opened_closed"] = f"""
    WITH {CELL}, mask AS (SELECT map, gx, gy, (h % 5 <> 0)::INTEGER AS m FROM cell),
    {box("e1", "mask", "m", "min")}, {box("opened", "e1", "m", "max")}, {box("d2", "opened", "m", "max")}, {box("closed", "d2", "m", "min")}
    SELECT m.map, sum(m.m)::BIGINT AS raw, sum(o.m)::BIGINT AS opened, sum(c.m)::BIGINT AS closed FROM mask m JOIN opened o USING (map, gx, gy) JOIN closed c USING (map, gx, gy) GROUP BY m.map"""


@query
def majority_wrapped(spark, sf_dir):
    """Each cell as the majority of its 3 x 3 neighbourhood, around the edges."""
    m = cells(spark, sf_dir).select("map", "gx", "gy", (F.col("h") % 2 == 0).alias("m"))
    return fields.majority(m, "m", SIDE).groupBy("map").agg(F.count_if("m").alias("set"), F.sum(F.when(F.col("m"), F.col("gx") * 64 + F.col("gy"))).alias("places"))


SQL["majority_wrapped"] = f"""
    WITH {CELL}, d AS (SELECT unnest([-1, 0, 1]) AS d),
    n AS (SELECT c.map, (c.gx + a.d + {SIDE}) % {SIDE} AS gx, (c.gy + b.d + {SIDE}) % {SIDE} AS gy, sum((h % 2 = 0)::INTEGER) AS n FROM cell c, d a, d b GROUP BY 1, 2, 3)
    SELECT map, count(*) FILTER (n >= 5) AS set, sum(gx * 64 + gy) FILTER (n >= 5) AS places FROM n GROUP BY map"""


@query
def city_block(spark, sf_dir):
    """City-block distance to the nearest high cell, at most 12, and inside the mask."""
    m = cells(spark, sf_dir).select("map", "gx", "gy", (F.col("h") > 200).alias("m"))
    return fields.city_block(m, "m", 12).groupBy("map", "d").agg(n_rows().alias("n"))


SQL["city_block"] = f"""
    WITH {CELL}, s AS (SELECT map, gx, gy FROM cell WHERE h > 200),
    d AS (SELECT c.map, c.gx, c.gy, coalesce(min(abs(c.gx - s.gx) + abs(c.gy - s.gy)), 12) AS d FROM cell c LEFT JOIN s ON c.map = s.map AND abs(c.gx - s.gx) + abs(c.gy - s.gy) < 12 GROUP BY ALL)
    SELECT map, d::INTEGER AS d, count(*) AS n FROM d GROUP BY 1, 2"""


@query
def edge_distance(spark, sf_dir):
    """Distance to the outside of the map, one cell of padding around it."""
    c = cells(spark, sf_dir)
    return c.groupBy("map", fields.to_edge(SIDE, SIDE).alias("d")).agg(n_rows().alias("n"), F.sum("h").alias("h"))


SQL["edge_distance"] = f"WITH {CELL} SELECT map, least(gx + 1, gy + 1, {SIDE} - gx, {SIDE} - gy)::INTEGER AS d, count(*) AS n, sum(h) AS h FROM cell GROUP BY 1, 2"


LINE = ((5, 60), (20, 30), (20, 12), (58, 4))


@query
def polyline_distance(spark, sf_dir):
    """Exact and signed distance to a polyline: the sign of the nearest segment's side."""
    d = fields.to_polyline(cells(spark, sf_dir), LINE)
    return d.groupBy("map", F.floor(F.col("signed")).cast("int").alias("ring")).agg(n_rows().alias("n"), F.round(F.avg("d"), 7).alias("mean"))


def segment_sql(a, b) -> str:
    (x0, y0), (x1, y1) = a, b
    dx, dy = x1 - x0, y1 - y0
    u = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((gx - {x0}) * ({dx}) + (gy - {y0}) * ({dy})) / {float(dx * dx + dy * dy)}::DOUBLE))"
    return f"""SELECT map, gx, gy, sqrt((gx - ({x0} + u * ({dx}))) * (gx - ({x0} + u * ({dx}))) + (gy - ({y0} + u * ({dy}))) * (gy - ({y0} + u * ({dy})))) AS d,
        CASE WHEN ({dx}) * (gy - {y0}) - ({dy}) * (gx - {x0}) >= 0 THEN 1 ELSE -1 END AS sign, {x0} * 1000 + {y0} AS seg FROM (SELECT *, {u} AS u FROM cell)"""


SQL["polyline_distance"] = f"""
    WITH {CELL}, s AS ({" UNION ALL ".join(segment_sql(a, b) for a, b in zip(LINE, LINE[1:], strict=False))}),
    o AS (SELECT *, CASE seg {" ".join(f"WHEN {x * 1000 + y} THEN {i}" for i, (x, y) in enumerate(LINE))} END AS i FROM s),
    m AS (SELECT map, gx, gy, d, sign, row_number() OVER (PARTITION BY map, gx, gy ORDER BY d, i) AS k FROM o)
    SELECT map, floor(d * sign)::INTEGER AS ring, count(*) AS n, round(avg(d), 7) AS mean FROM m WHERE k = 1 GROUP BY 1, 2"""


@query
def box_downsample(spark, sf_dir):
    """Means of 4 x 4 boxes, picked at evenly spaced rows and columns."""
    return fields.downsample(cells(spark, sf_dir), "h", 4, SIDE, 10).select("map", "row", "col", F.round("h", 9).alias("h"))


PICKS = [int(i * (SIDE // 4 - 1) / 9) for i in range(10)]
SQL["box_downsample"] = f"""
    WITH {CELL}, p AS (SELECT unnest({PICKS}) AS at, unnest(range(10)) AS i),
    b AS (SELECT map, gx // 4 AS bx, gy // 4 AS by_, avg(h) AS h FROM cell GROUP BY 1, 2, 3)
    SELECT map, r.i::INTEGER AS row, c.i::INTEGER AS col, round(h, 9) AS h FROM b JOIN p r ON by_ = r.at JOIN p c ON bx = c.at"""


@query
def sample_policies(spark, sf_dir):
    """2 x 2 blocks by four policies: any, two of four, all free, and the first cell."""
    return fields.policies(grid(spark, sf_dir), "block").groupBy("map").agg(*[F.count_if(c).alias(c) for c in ("any_set", "two_set", "all_free", "first_set")])


SQL["sample_policies"] = f"""
    WITH {CELL}, b AS (SELECT map, gx // 2 AS x, gy // 2 AS y, count(*) FILTER (block) AS n, bool_or(block AND gx % 2 = 0 AND gy % 2 = 0) AS f FROM cell GROUP BY 1, 2, 3)
    SELECT map, count(*) FILTER (n > 0) AS any_set, count(*) FILTER (n >= 2) AS two_set, count(*) FILTER (n = 0) AS all_free, count(*) FILTER (f) AS first_set FROM b GROUP BY map"""


@query
def seam_holes(spark, sf_dir):
    """Dry cells between two water levels along a row or a column."""
    level = F.when(F.col("water"), F.floor(F.col("gx") / 16))
    near = raster.neighbours(grid(spark, sf_dir).withColumn("l", level), "l")
    between = F.col("l").isNull() & ((F.col("l_w") != F.col("l_e")) | (F.col("l_n") != F.col("l_s")))
    return near.groupBy("map").agg(F.count_if(F.coalesce(between, F.lit(False))).alias("holes"), F.count_if(F.coalesce(F.col("l") != F.col("l_e"), F.lit(False))).alias("contacts"))


SQL["seam_holes"] = f"""
    WITH {CELL}, v AS (SELECT map, gx, gy, CASE WHEN water THEN gx // 16 END AS l FROM cell),
    n AS (
        SELECT map, l, lag(l) OVER r AS w, lead(l) OVER r AS e, lag(l) OVER k AS n, lead(l) OVER k AS s FROM v
        WINDOW r AS (PARTITION BY map, gy ORDER BY gx), k AS (PARTITION BY map, gx ORDER BY gy))
    SELECT map, count(*) FILTER (l IS NULL AND (w <> e OR n <> s)) AS holes, count(*) FILTER (l <> e) AS contacts FROM n GROUP BY map"""


@query
def rim_speck_rate(spark, sf_dir):
    """Loose tiles within three cells of a road's rim for each hundred cells of rim."""
    road = cells(spark, sf_dir).select("map", "gx", "gy", (F.col("t") == 6).alias("m"))
    return fields.rim_specks(road, "m").withColumn("finding", F.col("rate") < 2)


def cross(name: str, source: str, how: str, outside: str) -> str:
    """4-neighbour minimum or maximum of a 0/1 mask."""
    return f"""{name} AS (
        SELECT map, gx, gy, {how}(m, lag(m, 1, {outside}) OVER r, lead(m, 1, {outside}) OVER r, lag(m, 1, {outside}) OVER k, lead(m, 1, {outside}) OVER k) AS m FROM {source}
        WINDOW r AS (PARTITION BY map, gy ORDER BY gx), k AS (PARTITION BY map, gx ORDER BY gy))"""


SQL["rim_speck_rate"] = f"""
    WITH {CELL}, road AS (SELECT map, gx, gy, (t = 6)::INTEGER AS m FROM cell), off AS (SELECT map, gx, gy, 1 - m AS m FROM road),
    {cross("o1", "off", "greatest", "0")}, {cross("o2", "o1", "greatest", "0")}, {cross("g1", "road", "greatest", "0")}, {cross("g2", "g1", "greatest", "0")}, {cross("g3", "g2", "greatest", "0")},
    near AS (
        SELECT *, lag(m, 1, 0) OVER r + lead(m, 1, 0) OVER r + lag(m, 1, 0) OVER k + lead(m, 1, 0) OVER k AS n FROM road WINDOW r AS (PARTITION BY map, gy ORDER BY gx), k AS (PARTITION BY map, gx ORDER BY gy)),
    c AS (
        SELECT a.map, count(*) FILTER (a.m = 1 AND n <= 1 AND g3.m = 1 AND o2.m = 1) AS specks, count(*) FILTER (a.m = 1 AND o1.m = 1) AS rim
        FROM near a JOIN o1 USING (map, gx, gy) JOIN o2 USING (map, gx, gy) JOIN g3 USING (map, gx, gy) GROUP BY a.map)
    SELECT map, specks, rim, 100.0::DOUBLE * specks / greatest(rim, 1) AS rate, 100.0::DOUBLE * specks / greatest(rim, 1) < 2 AS finding FROM c"""


@query
def erosion_shares(spark, sf_dir):
    """Path-like indices: a small share of the map that survives two erosions and not five."""
    c = cells(spark, sf_dir)
    masks = [c.select(F.concat_ws("-", "map", F.lit(str(t))).alias("map"), "gx", "gy", (F.col("t") >= t).alias("m")) for t in (2, 4, 6)]
    return fields.survival(masks[0].unionAll(masks[1]).unionAll(masks[2]), "m")


SQL["erosion_shares"] = f"""
    WITH {CELL}, mask AS (SELECT map || '-' || k AS map, gx, gy, (t >= k)::INTEGER AS m FROM cell, (SELECT unnest([2, 4, 6]) AS k)),
    {cross("e1", "mask", "least", "1")}, {cross("e2", "e1", "least", "1")}, {cross("e3", "e2", "least", "1")}, {cross("e4", "e3", "least", "1")}, {cross("e5", "e4", "least", "1")},
    s AS (SELECT a.map, avg(a.m) AS share, sum(e2.m) / sum(a.m) AS e2, sum(e5.m) / sum(a.m) AS e5 FROM mask a JOIN e2 USING (map, gx, gy) JOIN e5 USING (map, gx, gy) GROUP BY a.map)
    SELECT map, share, e2, e5, share BETWEEN 0.005 AND 0.10 AND e2 BETWEEN 0.25 AND 0.85 AND e5 < 0.45 AS path FROM s"""


@query
def ring_enrichment(spark, sf_dir):
    """Around a mask, ring by ring: each index's share and its enrichment over the whole map; the blend's width."""
    c = cells(spark, sf_dir).withColumn("m", (F.col("gx") * 7 + F.col("gy") * 3) % 97 == 0)
    return fields.ring_profile(c, "m", "t", 14)


SQL["ring_enrichment"] = f"""
    WITH {CELL}, m AS (SELECT *, (gx * 7 + gy * 3) % 97 = 0 AS m FROM cell),
    d AS (SELECT a.map, a.gx, a.gy, a.t, min(greatest(abs(a.gx - b.gx), abs(a.gy - b.gy))) AS ring FROM m a JOIN m b ON a.map = b.map AND b.m AND abs(a.gx - b.gx) <= 14 AND abs(a.gy - b.gy) <= 14 GROUP BY ALL),
    r AS (SELECT map, ring, t, count(*) AS n FROM d WHERE ring BETWEEN 1 AND 14 GROUP BY 1, 2, 3),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY map, ring) AS share FROM r),
    b AS (SELECT map, t, count(*) / 4096 AS base FROM cell GROUP BY 1, 2),
    e AS (SELECT map, t, coalesce(min(ring) FILTER (share < 0.10) - 1, 14) AS blend FROM s GROUP BY 1, 2)
    SELECT s.map, s.ring::INTEGER AS ring, s.t, s.share, round(s.share / base, 9) AS enrichment, e.blend::INTEGER AS blend FROM s JOIN b USING (map, t) JOIN e USING (map, t)"""


@query
def dilated(spark, sf_dir):
    """A mask after one and two 4-neighbour dilations and erosions."""
    m = cells(spark, sf_dir).select("map", "gx", "gy", (F.col("h") > 150).alias("m"))
    g1 = fields.dilate(m, "m")
    steps = {"d1": g1, "d2": fields.dilate(g1, "m"), "e1": raster.erode(m, "m")}
    out = m.groupBy("map").agg(F.count_if("m").alias("raw"))
    for name, d in steps.items():
        out = out.join(d.groupBy("map").agg(F.count_if("m").alias(name)), "map")
    return out


SQL["dilated"] = f"""
    WITH {CELL}, mask AS (SELECT map, gx, gy, (h > 150)::INTEGER AS m FROM cell), {cross("a1", "mask", "greatest", "0")}, {cross("a2", "a1", "greatest", "0")}, {cross("b1", "mask", "least", "1")}
    SELECT map, sum(m.m)::BIGINT AS raw, sum(a1.m)::BIGINT AS d1, sum(a2.m)::BIGINT AS d2, sum(b1.m)::BIGINT AS e1 FROM mask m JOIN a1 USING (map, gx, gy) JOIN a2 USING (map, gx, gy) JOIN b1 USING (map, gx, gy) GROUP BY map"""


@query
def patch_gates(spark, sf_dir):
    """Overlapping 16 x 16 patches: descriptors, the features they pass, two best a feature and map."""
    return fields.patches(raster.slopes(grid(spark, sf_dir)), 16, 8, SIDE - 1)


SQL["patch_gates"] = f"""
    WITH {CELL}, {SLOPE},
    w AS (SELECT s.*, px.i AS px, py.i AS py FROM slope s JOIN (SELECT unnest(range(7)) AS i) px ON gx BETWEEN px.i * 8 AND px.i * 8 + 15 JOIN (SELECT unnest(range(7)) AS i) py ON gy BETWEEN py.i * 8 AND py.i * 8 + 15),
    d AS (
        SELECT map, px, py, max(h) - min(h) AS relief, avg(h) AS mean, stddev_pop(h) AS rough, avg(slope) AS slope, avg((slope < 30)::INTEGER) AS flat, avg(water::INTEGER) AS wet, avg(block::INTEGER) AS blocked,
               avg(h) FILTER (gx - px * 8 BETWEEN 4 AND 11 AND gy - py * 8 BETWEEN 4 AND 11) - avg(h) FILTER (NOT (gx - px * 8 BETWEEN 4 AND 11 AND gy - py * 8 BETWEEN 4 AND 11)) AS lift
        FROM w GROUP BY 1, 2, 3 HAVING count(*) = 256),
    f AS (
        SELECT *, unnest([CASE WHEN lift > 5 THEN 'dome' END, CASE WHEN lift < -5 THEN 'basin' END, CASE WHEN flat > 0.2 THEN 'plain' END, CASE WHEN rough > 60 THEN 'rugged' END, CASE WHEN wet > 0.5 THEN 'wet' END]) AS feature,
               unnest([lift, -lift, flat, rough, wet]) AS score FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY map, feature ORDER BY round(score, 9) DESC, px, py) AS rank FROM f WHERE feature IS NOT NULL)
    SELECT map, feature, rank::INTEGER AS rank, px::INTEGER AS px, py::INTEGER AS py, relief, round(mean, 7) AS mean, round(score, 7) AS score FROM k WHERE rank <= 2"""


@query
def cross_sections(spark, sf_dir):
    """Height over the centreline of a road, folded about it: the mean rise by distance."""
    c = cells(spark, sf_dir).filter("gx BETWEEN 24 AND 40")
    centre = c.filter("gx = 32").select("map", "gy", F.col("h").alias("h0"))
    d = c.join(centre, ["map", "gy"]).withColumn("off", F.abs(F.col("gx") - 32))
    return d.groupBy("map", "off").agg(n_rows().alias("n"), F.avg(F.col("h") - F.col("h0")).alias("rise"), F.percentile(F.col("h") - F.col("h0"), F.lit(0.5)).alias("median"))


SQL["cross_sections"] = f"""
    WITH {CELL}
    SELECT c.map, abs(c.gx - 32) AS off, count(*) AS n, avg(c.h - o.h) AS rise, quantile_cont(c.h - o.h, 0.5) AS median FROM cell c JOIN cell o ON c.map = o.map AND c.gy = o.gy AND o.gx = 32 WHERE c.gx BETWEEN 24 AND 40 GROUP BY 1, 2"""


@query
def transect_widths(spark, sf_dir):
    """A mask's width through each of its cells: the least of its runs along row, column and diagonals."""
    m = cells(spark, sf_dir).select("map", "gx", "gy", (F.col("h") % 4 != 0).alias("m"))
    return fields.widths(m, "m").groupBy("map", "width").agg(n_rows().alias("n"))


def run_sql(name: str, line: str, at: str) -> str:
    return f"""
    {name}_i AS (SELECT map, gx, gy, {line} AS line, {at} - row_number() OVER (PARTITION BY map, {line} ORDER BY {at}) AS island FROM cell WHERE h % 4 <> 0),
    {name} AS (SELECT map, gx, gy, count(*) OVER (PARTITION BY map, line, island) AS n FROM {name}_i)"""


SQL["transect_widths"] = f"""
    WITH {CELL}, {run_sql("r", "gy", "gx")}, {run_sql("c", "gx", "gy")}, {run_sql("d", "gx - gy", "gx")}, {run_sql("u", "gx + gy", "gx")}
    SELECT map, least(r.n, c.n, d.n, u.n) AS width, count(*) AS n FROM r JOIN c USING (map, gx, gy) JOIN d USING (map, gx, gy) JOIN u USING (map, gx, gy) GROUP BY 1, 2"""


@query
def footprint_sizes(spark, sf_dir):
    """Blocked ground around isolated objects: box, area, equivalent radius, and why others are rejected."""
    o = cells(spark, sf_dir).filter("h > 250").select("map", F.col("gx").alias("ox"), F.col("gy").alias("oy"), F.col("t").alias("id"))
    return fields.footprints(o, grid(spark, sf_dir), 2)


SQL["footprint_sizes"] = f"""
    WITH {CELL}, o AS (SELECT map, gx AS ox, gy AS oy, t AS id FROM cell WHERE h > 250),
    f AS (
        SELECT o.map, o.ox, o.oy, o.id, count(*) AS seen, count(*) FILTER (block) AS area, max(gx) FILTER (block) - min(gx) FILTER (block) + 1 AS width, max(gy) FILTER (block) - min(gy) FILTER (block) + 1 AS depth
        FROM o JOIN cell c ON o.map = c.map AND abs(gx - ox) <= 2 AND abs(gy - oy) <= 2 GROUP BY ALL),
    s AS (SELECT *, CASE WHEN seen < 25 THEN 'cut' WHEN area < 0.5 * seen THEN 'thin' ELSE 'kept' END AS status FROM f)
    SELECT map, id, status, count(*) AS n, round(avg(area), 7) AS area, round(avg(sqrt(area / pi())), 7) AS radius, max(width) AS width, max(depth) AS depth FROM s GROUP BY 1, 2, 3"""


@query
def stipple_check(spark, sf_dir):
    """Median run of sampled rows and the share of each map's base index."""
    c = cells(spark, sf_dir).filter("gy % 2 = 0")
    island = F.col("gx") - F.row_number().over(Window.partitionBy("map", "gy", "t").orderBy("gx"))
    runs = c.withColumn("island", island).groupBy("map", "gy", "t", "island").agg(n_rows().alias("n"))
    base = c.groupBy("map", "t").agg(n_rows().alias("n")).groupBy("map").agg((F.max("n") / F.sum("n")).alias("base_share"))
    return runs.groupBy("map").agg(F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("longest")).join(base, "map")


SQL["stipple_check"] = f"""
    WITH {CELL}, c AS (SELECT *, gx - row_number() OVER (PARTITION BY map, gy, t ORDER BY gx) AS island FROM cell WHERE gy % 2 = 0),
    r AS (SELECT map, gy, t, island, count(*) AS n FROM c GROUP BY 1, 2, 3, 4), b AS (SELECT map, t, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT r.map, quantile_cont(n, 0.5) AS median, max(n) AS longest, (SELECT max(b.n) / sum(b.n) FROM b WHERE b.map = r.map) AS base_share FROM r GROUP BY r.map"""


@query
def plane_residuals(spark, sf_dir):
    """Plane through the present cells of every sector, by full normal equations; its residual ratio."""
    c = cells(spark, sf_dir).filter("t > 1").withColumns({"sx": F.floor(F.col("gx") / 16), "sy": F.floor(F.col("gy") / 16)})
    c = c.select("map", "sx", "sy", ((F.col("gx") % 16) / 7.5 - 1).alias("x"), ((F.col("gy") % 16) / 7.5 - 1).alias("y"), F.col("h").cast("double").alias("z"))
    return fields.planes(c, ["map", "sx", "sy"])


SQL["plane_residuals"] = f"""
    WITH {CELL}, c AS (SELECT map, gx // 16 AS sx, gy // 16 AS sy, (gx % 16) / 7.5::DOUBLE - 1 AS x, (gy % 16) / 7.5::DOUBLE - 1 AS y, h::DOUBLE AS z FROM cell WHERE t > 1),
    m AS (SELECT map, sx, sy, count(*) AS n, covar_pop(x, y) AS xy, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, var_pop(z) AS zz FROM c GROUP BY 1, 2, 3),
    b AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM m)
    SELECT map, sx, sy, n, round(a, 6) AS a, round(b, 6) AS b, round(CASE WHEN zz > 0 THEN sqrt(greatest(0.0, zz - a * xz - b * yz) / zz) ELSE 0 END, 6) AS ratio FROM b"""
