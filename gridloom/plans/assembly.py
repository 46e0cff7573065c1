"""Queries that put maps together from sectors and join the layers, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import aggregates, raster
from gridloom.plans.oracles import SLOPE
from gridloom.plans.surrogates import CELL, POINTS, cells, flagged, points
from gridloom.session import table
from gridloom.sources import codecs, textfiles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def n_rows():
    return F.count(F.lit(1))


# ---- layers and mosaics


@query
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute and tile layers written as bytes, read again and laid out as cells."""

    def write(g: pd.DataFrame) -> pd.DataFrame:
        attr, tile = np.zeros((256, 256), "u1"), np.zeros((258, 258), "u1")
        attr[g["gy"], g["gx"]], tile[g["gy"] + 1, g["gx"] + 1] = g["attr"], g["t"]
        return pd.DataFrame({"map": g["map"].iloc[:1], "attr": [codecs.write_attr(codecs.Grid(attr))], "tile": [codecs.write_plain(codecs.Grid(tile, b"end"))]})

    def read(batches):
        for batch in batches:
            for name, attr, tile in batch.itertuples(index=False):
                a, t = codecs.read_attr(attr).values, codecs.read_tile(tile).values[1:-1, 1:-1]
                y, x = np.nonzero((a > 0) | (t > 0))
                yield pd.DataFrame({"map": name, "gx": x.astype("i4"), "gy": y.astype("i4"), "attr": a[y, x].astype("i4"), "t": t[y, x].astype("i4")})

    files = cells(spark, sf_dir).groupBy("map").applyInPandas(write, "map string, attr binary, tile binary")
    return files.mapInPandas(read, "map string, gx int, gy int, attr int, t int")


SQL["codec_roundtrip"] = f"WITH {CELL} SELECT map, gx, gy, attr, t FROM cell WHERE attr > 0 OR t > 0"


def vertices(spark, sf_dir) -> DataFrame:
    """vertex(map, sx, sy, vx, vy, h): sectors of 17 x 17 vertices whose borders disagree a little."""
    c = cells(spark, sf_dir)
    owners = lambda k: F.filter(F.array(F.floor(F.col(k) / 16), F.floor(F.col(k) / 16) - 1), lambda s: (s >= 0) & (F.col(k) - s * 16 <= 16))
    v = c.select("map", "gx", "gy", "h", F.explode(owners("gx")).alias("sx")).select("*", F.explode(owners("gy")).alias("sy"))
    return v.select("map", "sx", "sy", (F.col("gx") - F.col("sx") * 16).alias("vx"), (F.col("gy") - F.col("sy") * 16).alias("vy"), (F.col("h") + (F.col("sx") + 2 * F.col("sy")) % 3).alias("h"))


VERTEX = """
    side AS (SELECT unnest(range(4)) AS s),
    vertex AS (
        SELECT c.map, a.s AS sx, b.s AS sy, gx - a.s * 16 AS vx, gy - b.s * 16 AS vy, h + (a.s + 2 * b.s) % 3 AS h
        FROM cell c JOIN side a ON gx BETWEEN a.s * 16 AND a.s * 16 + 16 JOIN side b ON gy BETWEEN b.s * 16 AND b.s * 16 + 16)"""


def mosaic(vertex: DataFrame, side: int) -> DataFrame:
    """(map, gx, gy, last, mean, tear, inner): shared vertices by three policies.

    ``last`` is the value of the sector that is written last in sorted order, ``mean``
    that of all owners with ``tear`` their spread, ``inner`` the one owner whose first
    row and column it is on. No stitching: the key is arithmetic.
    """
    at = vertex.withColumns({"gx": F.col("sx") * side + F.col("vx"), "gy": F.col("sy") * side + F.col("vy")})
    inside = (F.col("vx") < side) & (F.col("vy") < side)
    return at.groupBy("map", "gx", "gy").agg(
        F.max_by("h", F.struct("sx", "sy")).alias("last"), F.avg("h").alias("mean"), (F.max("h") - F.min("h")).alias("tear"), F.max(F.when(inside, F.col("h"))).alias("inner"), n_rows().alias("owners")
    )


@query
def mosaic_policies(spark, sf_dir):
    m = mosaic(vertices(spark, sf_dir), 16)
    return m.select("map", "gx", "gy", "last", F.round("mean", 9).alias("mean"), "tear", "inner", "owners")


SQL["mosaic_policies"] = f"""
    WITH {CELL}, {VERTEX}
    SELECT map, sx * 16 + vx AS gx, sy * 16 + vy AS gy, arg_max(h, sx * 10 + sy) AS last, round(avg(h), 9) AS mean, max(h) - min(h) AS tear, max(h) FILTER (vx < 16 AND vy < 16) AS inner, count(*) AS owners
    FROM vertex GROUP BY ALL"""


@query
def seam_skirts(spark, sf_dir):
    """Shared borders, and each sector's line inside them against its neighbour's, both ways."""
    v = vertices(spark, sf_dir).filter("vx IN (0, 1, 15, 16)")
    a, b = v.alias("a"), v.alias("b")
    next_to = (F.col("a.map") == F.col("b.map")) & (F.col("a.sy") == F.col("b.sy")) & (F.col("a.vy") == F.col("b.vy")) & (F.col("b.sx") == F.col("a.sx") + 1)
    kind = F.when((F.col("a.vx") == 16) & (F.col("b.vx") == 0), "shared").when((F.col("a.vx") == 16) & (F.col("b.vx") == 1), "forward").when((F.col("a.vx") == 15) & (F.col("b.vx") == 0), "backward")
    d = a.join(b, next_to).select(F.col("a.map").alias("map"), kind.alias("kind"), F.abs(F.col("a.h") - F.col("b.h")).alias("d")).filter("kind IS NOT NULL")
    return d.groupBy("map", "kind").agg(n_rows().alias("n"), F.avg((F.col("d") == 0).cast("int")).alias("exact"), F.avg((F.col("d") <= 1).cast("int")).alias("near"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.99)).alias("p99"), F.max("d").alias("largest"))


SQL["seam_skirts"] = f"""
    WITH {CELL}, {VERTEX},
    d AS (
        SELECT a.map, CASE WHEN a.vx = 16 AND b.vx = 0 THEN 'shared' WHEN a.vx = 16 AND b.vx = 1 THEN 'forward' WHEN a.vx = 15 AND b.vx = 0 THEN 'backward' END AS kind, abs(a.h - b.h) AS d
        FROM vertex a JOIN vertex b ON a.map = b.map AND a.sy = b.sy AND a.vy = b.vy AND b.sx = a.sx + 1)
    SELECT map, kind, count(*) AS n, avg((d = 0)::INTEGER) AS exact, avg((d <= 1)::INTEGER) AS near, avg(d) AS mean, quantile_cont(d, 0.99) AS p99, max(d) AS largest FROM d WHERE kind IS NOT NULL GROUP BY map, kind"""


# ---- joins of layers


@query
def taxonomy_join(spark, sf_dir):
    """Maps with their archetype, 'unclassified' where the list has none."""
    maps = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("map"), F.when(F.col("n_nationkey") % 6 == 0, F.lit(99)).otherwise(F.col("n_regionkey")).alias("r"))
    known = table(spark, sf_dir, "region").select("r_regionkey", F.lower("r_name").alias("archetype"))
    return maps.join(known, F.col("r") == F.col("r_regionkey"), "left").select("map", F.coalesce("archetype", F.lit("unclassified")).alias("archetype"))


SQL["taxonomy_join"] = "SELECT n_nationkey AS map, coalesce(lower(r_name), 'unclassified') AS archetype FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND n_nationkey % 6 <> 0"


@query
def palette_join(spark, sf_dir):
    """Tiles of every map with their slot's texture; missing slots read '(none)'."""
    slots = table(spark, sf_dir, "part").filter("p_partkey <= 5").select(F.col("p_partkey").alias("slot"), F.col("p_name").alias("texture"))
    n = cells(spark, sf_dir).groupBy("map", "t").agg(n_rows().alias("n"))
    return n.join(slots, F.col("t") == F.col("slot"), "left").groupBy("map", F.coalesce("texture", F.lit("(none)")).alias("texture")).agg(F.sum("n").alias("n"))


SQL["palette_join"] = f"WITH {CELL} SELECT map, coalesce(p_name, '(none)') AS texture, count(*) AS n FROM cell LEFT JOIN part ON t = p_partkey AND p_partkey <= 5 GROUP BY 1, 2"


@query
def point_ground(spark, sf_dir):
    """Points of every map with the tile and ground below them; null outside."""
    at = lambda c: F.floor(F.col(c) * 160).cast("int")
    p = points(spark, sf_dir).select("id", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("id") % 3 + 1).cast("int")).alias("map"), at("x").alias("gx"), at("y").alias("gy"))
    fine = cells(spark, sf_dir).select("map", "gx", "gy", "t", "attr")
    coarse = cells(spark, sf_dir).select("map", F.col("gx").alias("cx"), F.col("gy").alias("cy"), "h")
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    return p.join(fine, ["map", "gx", "gy"], "left").withColumns({"cx": half("gx"), "cy": half("gy")}).join(coarse, ["map", "cx", "cy"], "left").select("id", "map", "gx", "gy", "t", "attr", "h")


SQL["point_ground"] = f"""
    WITH {CELL}, {POINTS},
    p AS (SELECT id, ['A', 'N', 'R'][id % 3 + 1] AS map, floor(x * 160)::INTEGER AS gx, floor(y * 160)::INTEGER AS gy FROM point)
    SELECT id, p.map, p.gx, p.gy, f.t, f.attr, c.h FROM p LEFT JOIN cell f ON p.map = f.map AND p.gx = f.gx AND p.gy = f.gy
    LEFT JOIN cell c ON p.map = c.map AND floor(p.gx / 2) = c.gx AND floor(p.gy / 2) = c.gy"""


@query
def attr_slope_join(spark, sf_dir):
    """Fine attribute cells with the slope of the coarse cell they lie in: no replication."""
    slope = raster.slopes(cells(spark, sf_dir)).select("map", F.col("gx").alias("cx"), F.col("gy").alias("cy"), "slope")
    fine = flagged(cells(spark, sf_dir)).select("map", "block", "water", F.floor(F.col("gx") / 2).cast("int").alias("cx"), F.floor(F.col("gy") / 2).cast("int").alias("cy"))
    j = fine.join(slope, ["map", "cx", "cy"])
    return j.groupBy("map", F.floor(F.col("slope") / 15).cast("int").alias("band")).agg(n_rows().alias("n"), F.count_if("block").alias("blocked"), F.count_if("water").alias("wet"))


SQL["attr_slope_join"] = f"""
    WITH {CELL}, {SLOPE}
    SELECT f.map, floor(s.slope / 15)::INTEGER AS band, count(*) AS n, count(*) FILTER (f.block) AS blocked, count(*) FILTER (f.water) AS wet
    FROM cell f JOIN slope s ON f.map = s.map AND f.gx // 2 = s.gx AND f.gy // 2 = s.gy GROUP BY 1, 2"""


@query
def blocked_any_slope(spark, sf_dir):
    """Coarse cells: whether any of their four fine cells is blocked, next to the slope."""
    slope = raster.slopes(cells(spark, sf_dir)).select("map", "gx", "gy", "slope")
    coarse = flagged(cells(spark, sf_dir)).groupBy("map", F.floor(F.col("gx") / 2).cast("int").alias("gx"), F.floor(F.col("gy") / 2).cast("int").alias("gy")).agg(F.bool_or("block").alias("any"), F.bool_and("block").alias("all"))
    return coarse.join(slope, ["map", "gx", "gy"]).groupBy("map", "any", "all").agg(n_rows().alias("n"), F.round(F.avg("slope"), 7).alias("slope"))


SQL["blocked_any_slope"] = f"""
    WITH {CELL}, {SLOPE},
    c AS (SELECT map, gx // 2 AS gx, gy // 2 AS gy, bool_or(block) AS "any", bool_and(block) AS "all" FROM cell GROUP BY 1, 2, 3)
    SELECT c.map, "any", "all", count(*) AS n, round(avg(slope), 7) AS slope FROM c JOIN slope s USING (map, gx, gy) GROUP BY 1, 2, 3"""


# ---- object joins


def pieces(spark, sf_dir, keep: str) -> DataFrame:
    """piece(grp, id, kind, x, y, roll): placed objects in centimetres."""
    i = table(spark, sf_dir, "lineitem").filter(keep)
    return i.select(
        (F.col("l_suppkey") % 4).alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 12).alias("kind"),
        (F.col("l_orderkey") * 37 % 4000).alias("x"), (F.col("l_partkey") * 53 % 4000).alias("y"), (F.col("l_suppkey") * 15 % 360).cast("double").alias("roll"),
    ).groupBy("grp", "id").agg(F.min("kind").alias("kind"), F.min("x").alias("x"), F.min("y").alias("y"), F.min("roll").alias("roll"))


def piece_sql(keep: str) -> str:
    return f"""
    piece AS (
        SELECT l_suppkey % 4 AS grp, l_orderkey * 10 + l_linenumber AS id, min(l_partkey % 12) AS kind, min(l_orderkey * 37 % 4000) AS x, min(l_partkey * 53 % 4000) AS y, min(l_suppkey * 15 % 360)::DOUBLE AS roll
        FROM lineitem WHERE {keep} GROUP BY 1, 2)"""


def locate(placed: DataFrame, paste: DataFrame, tolerance: int) -> DataFrame:
    """(grp, site, ox, oy, matched): where a paste of offsets stands among placed objects.

    The paste's rarest kind is the anchor; every placed object of that kind is tried, and
    the other offsets are looked up around it within ``tolerance``: an equi join on the
    kind and coarse position, then the exact test. paste: (slot, kind, dx, dy).
    """
    frequency = placed.groupBy("kind").agg(n_rows().alias("n"))
    anchor = paste.join(frequency, "kind").orderBy("n", "slot").limit(1).select(F.col("kind").alias("a_kind"), F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    # The anchor is one row: a constant to every other row.
    sites = placed.join(F.broadcast(anchor), F.col("kind") == F.col("a_kind")).select("grp", F.col("id").alias("site"), (F.col("x") - F.col("ax")).alias("ox"), (F.col("y") - F.col("ay")).alias("oy"))
    wanted = sites.join(F.broadcast(paste)).select("grp", "site", "slot", F.col("kind").alias("w_kind"), (F.col("ox") + F.col("dx")).alias("wx"), (F.col("oy") + F.col("dy")).alias("wy"))
    cell = 2 * tolerance + 1
    bucket = lambda c: F.floor(F.col(c) / cell)
    near = wanted.withColumn("bx", F.explode(F.array(*[bucket("wx") + i for i in (-1, 0, 1)]))).withColumn("by", F.explode(F.array(*[bucket("wy") + i for i in (-1, 0, 1)])))
    there = placed.select(F.col("grp").alias("p_grp"), "id", "kind", "x", "y", bucket("x").alias("px"), bucket("y").alias("py"))
    hit = near.join(there, (F.col("grp") == F.col("p_grp")) & (F.col("w_kind") == F.col("kind")) & (F.col("bx") == F.col("px")) & (F.col("by") == F.col("py")))
    hit = hit.filter((F.abs(F.col("x") - F.col("wx")) <= tolerance) & (F.abs(F.col("y") - F.col("wy")) <= tolerance))
    found = hit.groupBy("grp", "site").agg(F.count_distinct("slot").alias("matched"))
    return sites.select("grp", "site", "ox", "oy").join(found, ["grp", "site"], "left").na.fill(0, ["matched"])


PASTE = [(0, 3, 0, 0), (1, 5, 37, 53), (2, 7, 200, 120), (3, 1, -90, 400), (4, 4, 60, -30)]


@query
def locate_paste(spark, sf_dir):
    paste = spark.createDataFrame(PASTE, "slot int, kind long, dx long, dy long")
    return locate(pieces(spark, sf_dir, "l_linenumber <= 3"), paste, 40)


SQL["locate_paste"] = f"""
    WITH {piece_sql("l_linenumber <= 3")},
    paste AS (SELECT * FROM (VALUES {", ".join(map(str, PASTE))}) t(slot, kind, dx, dy)),
    anchor AS (SELECT p.* FROM paste p JOIN (SELECT kind, count(*) AS n FROM piece GROUP BY kind) f USING (kind) ORDER BY n, slot LIMIT 1),
    site AS (SELECT p.grp, p.id AS site, p.x - a.dx AS ox, p.y - a.dy AS oy FROM piece p JOIN anchor a ON p.kind = a.kind),
    hit AS (SELECT s.grp, site, slot FROM site s, paste w WHERE EXISTS (SELECT 1 FROM piece p WHERE p.grp = s.grp AND p.kind = w.kind AND abs(p.x - s.ox - w.dx) <= 40 AND abs(p.y - s.oy - w.dy) <= 40))
    SELECT s.grp, s.site, ox, oy, count(slot) AS matched FROM site s LEFT JOIN hit h ON s.grp = h.grp AND s.site = h.site GROUP BY ALL"""


def trace_pairs(floors: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(traces, pairs): pieces by where they stand, and how many cells their floors share.

    Pieces on the same cells of a group are one place, and those of the same places in all
    groups one trace: (t, id), t the least such piece. pairs: (ta, tb, shared) counts cells
    of tb under ta grown by one cell, itself included. Only traces that both stand in
    several groups are summed over these; all other pairs are joined out.
    """
    stand = floors.groupBy("grp", "id").agg(F.array_sort(F.collect_set(F.struct("cx", "cy"))).alias("cells"))
    placed = stand.select("grp", "id", "cells", F.min("id").over(Window.partitionBy("grp", "cells")).alias("place"))
    where = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("grp", "place"))).alias("w"))
    traces = where.select(F.min("id").over(Window.partitionBy("w")).alias("t"), "id")
    at = where.groupBy("w").agg(F.min("id").alias("t")).select("t", (F.size("w") > 1).alias("several"), F.explode("w").alias("x")).select("t", "several", "x.grp", "x.place")

    own = stand.groupBy("grp", "cells").agg(F.min("id").alias("p")).select("grp", "p", F.explode("cells").alias("c")).select("grp", "p", "c.cx", "c.cy")
    step = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    grown = own.select("grp", F.col("p").alias("pa"), "cx", "cy", F.explode(step).alias("d")).select("grp", "pa", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy")).distinct()
    met = grown.join(own.withColumnRenamed("p", "pb"), ["grp", "cx", "cy"]).groupBy("grp", "pa", "pb").agg(n_rows().alias("shared"))

    def paired(ours: DataFrame, theirs: DataFrame, pairs: DataFrame) -> DataFrame:
        for x, side in (("a", ours), ("b", theirs)):
            side = side.select(F.col("grp").alias(f"g{x}"), F.col("place").alias(f"q{x}"), F.col("t").alias(f"t{x}"))
            pairs = pairs.join(side, (F.col("grp") == F.col(f"g{x}")) & (F.col(f"p{x}") == F.col(f"q{x}")))
        return pairs.select("ta", "tb", "shared")

    one, several, near = at.filter("NOT several"), at.filter("several"), met.filter(F.col("shared") >= least)
    summed = paired(several, several, met).groupBy("ta", "tb").agg(F.sum("shared").alias("shared")).filter(F.col("shared") >= least)
    return traces, paired(one, at, near).unionAll(paired(several, one, near)).unionAll(summed)


def contacts(floors: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, shared): pieces whose floors touch: cells of b under a grown by one cell.

    floors: (grp, id, cx, cy), a piece's floor cells. Pairs of pieces go nowhere but into
    the result.
    """
    traces, pairs = trace_pairs(floors, least)
    for x in "ab":
        pairs = pairs.join(traces.select(F.col("t").alias(f"u{x}"), F.col("id").alias(x)), F.col(f"t{x}") == F.col(f"u{x}"))
    return pairs.filter("a <> b").select("a", "b", "shared")


def contact_counts(floors: DataFrame, least: int = 3) -> DataFrame:
    """(shared, n): how many contacts share so many cells, from the traces' sizes alone."""
    traces, pairs = trace_pairs(floors, least)
    sizes = traces.groupBy("t").agg(n_rows().alias("n"))
    for x in "ab":
        pairs = pairs.join(sizes.select(F.col("t").alias(f"u{x}"), F.col("n").alias(f"n{x}")), F.col(f"t{x}") == F.col(f"u{x}"))
    itself = F.when(F.col("ta") == F.col("tb"), F.col("na")).otherwise(0)  # a piece is no contact of its own
    return pairs.groupBy("shared").agg(F.sum(F.col("na") * F.col("nb") - itself).alias("n")).filter("n > 0")


def floors(spark, sf_dir) -> DataFrame:
    p = pieces(spark, sf_dir, "l_linenumber = 1 AND l_orderkey % 8 = 0")
    span = lambda c, n: F.explode(F.sequence(F.floor(F.col(c) / 40), F.floor(F.col(c) / 40) + n))
    return p.select("grp", "id", span("x", 2).alias("cx"), "y").select("grp", "id", "cx", span("y", 3).alias("cy"))


@query
def floor_contacts(spark, sf_dir):
    return contacts(floors(spark, sf_dir))


FLOORS = f"""{piece_sql("l_linenumber = 1 AND l_orderkey % 8 = 0")},
    f AS (SELECT grp, id, x // 40 + i AS cx, y // 40 + j AS cy FROM piece, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(4)) AS j)),
    grown AS (SELECT DISTINCT grp, id AS a, cx + dx AS cx, cy + dy AS cy FROM f, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)),
    contact AS (SELECT a, id AS b, count(*) AS shared FROM grown JOIN f USING (grp, cx, cy) WHERE a <> id GROUP BY 1, 2 HAVING count(*) >= 3)"""
SQL["floor_contacts"] = f"WITH {FLOORS} SELECT * FROM contact"


@query
def join_overlaps(spark, sf_dir):
    """How many cells joined floors share: p5, p50, p95, and the most frequent count."""
    c = contact_counts(floors(spark, sf_dir))
    mode = F.max_by("shared", F.struct("n", (-F.col("shared")).alias("o")))
    at = lambda q, name: F.percentile("shared", F.lit(q), F.col("n")).alias(name)
    return c.agg(at(0.05, "p5"), at(0.5, "p50"), at(0.95, "p95"), F.coalesce(F.sum("n"), F.lit(0)).alias("joins"), mode.alias("modal"))


SQL["join_overlaps"] = f"""
    WITH {FLOORS}
    SELECT quantile_cont(shared, 0.05) AS p5, quantile_cont(shared, 0.5) AS p50, quantile_cont(shared, 0.95) AS p95, count(*) AS joins,
           (SELECT shared FROM contact GROUP BY shared ORDER BY count(*) DESC, shared LIMIT 1) AS modal FROM contact"""


@query
def rider_assignment(spark, sf_dir):
    """Every small object with the piece whose box holds it, the one with the nearest centre."""
    host = pieces(spark, sf_dir, "l_linenumber = 1 AND l_orderkey % 8 = 0").select("grp", F.col("id").alias("host"), F.col("x").alias("hx"), F.col("y").alias("hy"))
    rider = pieces(spark, sf_dir, "l_linenumber = 2 AND l_orderkey % 4 = 0")
    # Boxes of 300 x 200 reach at most two buckets of 300 along x and of 200 along y.
    spread = host.withColumn("bx", F.explode(F.sequence(F.floor((F.col("hx") - 150) / 300), F.floor((F.col("hx") + 150) / 300)))).withColumn("by", F.explode(F.sequence(F.floor((F.col("hy") - 100) / 200), F.floor((F.col("hy") + 100) / 200))))
    at = rider.withColumns({"bx": F.floor(F.col("x") / 300), "by": F.floor(F.col("y") / 200)})
    held = at.join(spread, ["grp", "bx", "by"]).filter("abs(x - hx) <= 150 AND abs(y - hy) <= 100")
    d2 = (F.col("x") - F.col("hx")) * (F.col("x") - F.col("hx")) + (F.col("y") - F.col("hy")) * (F.col("y") - F.col("hy"))
    return held.groupBy("grp", "id").agg(F.min(F.struct(d2.alias("d2"), "host")).alias("m"), n_rows().alias("holders")).select("grp", "id", "m.host", "m.d2", "holders")


SQL["rider_assignment"] = f"""
    WITH {piece_sql("true")},
    h AS (SELECT * FROM piece WHERE id % 10 = 1 AND id // 10 % 8 = 0),
    r AS (SELECT * FROM piece WHERE id % 10 = 2 AND id // 10 % 4 = 0),
    held AS (SELECT r.grp, r.id, h.id AS host, (r.x - h.x) * (r.x - h.x) + (r.y - h.y) * (r.y - h.y) AS d2 FROM r JOIN h ON r.grp = h.grp AND abs(r.x - h.x) <= 150 AND abs(r.y - h.y) <= 100)
    SELECT grp, id, arg_min(host, (d2, host)) AS host, min(d2) AS d2, count(*) AS holders FROM held GROUP BY grp, id"""


@query
def linked_alignment(spark, sf_dir):
    """How tightly roll plus bearing to the nearest linked piece clusters, modulo 180."""
    p = pieces(spark, sf_dir, "l_linenumber = 1 AND l_orderkey % 16 = 0")
    link = 600
    bucket = lambda c, i: F.floor(F.col(c) / link) + i
    q = p.select("grp", F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.floor(F.col("x") / link).alias("bx"), F.floor(F.col("y") / link).alias("by"))
    near = p.withColumn("bx", F.explode(F.array(*[bucket("x", i) for i in (-1, 0, 1)]))).withColumn("by", F.explode(F.array(*[bucket("y", i) for i in (-1, 0, 1)])))
    d2 = (F.col("ox") - F.col("x")) * (F.col("ox") - F.col("x")) + (F.col("oy") - F.col("y")) * (F.col("oy") - F.col("y"))
    best = near.join(q, ["grp", "bx", "by"]).filter("o <> id").withColumn("d2", d2).filter(F.col("d2") <= link * link)
    best = best.groupBy("grp", "id", "x", "y", "roll").agg(F.min(F.struct("d2", "o", "ox", "oy")).alias("m"))
    angle = F.radians(2 * F.pmod(F.col("roll") + F.degrees(F.atan2(F.col("m.oy") - F.col("y"), F.col("m.ox") - F.col("x"))), F.lit(180.0)))
    sums = best.groupBy("grp").agg(F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s"), n_rows().alias("n"))
    return sums.select("grp", "n", F.round(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")), 7).alias("concentration"))


SQL["linked_alignment"] = f"""
    WITH {piece_sql("l_linenumber = 1 AND l_orderkey % 16 = 0")},
    near AS (
        SELECT p.grp, p.id, p.x, p.y, p.roll, q.x AS ox, q.y AS oy, row_number() OVER (PARTITION BY p.grp, p.id ORDER BY (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), q.id) AS k
        FROM piece p JOIN piece q ON p.grp = q.grp AND p.id <> q.id AND (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 360000),
    b AS (SELECT grp, roll + degrees(atan2((oy - y)::DOUBLE, (ox - x)::DOUBLE)) AS b FROM near WHERE k = 1),
    a AS (SELECT grp, radians(2 * (b - 180 * floor(b / 180))) AS a FROM b)
    SELECT grp, count(*) AS n, round(sqrt(avg(cos(a)) * avg(cos(a)) + avg(sin(a)) * avg(sin(a))), 7) AS concentration FROM a GROUP BY grp"""


@query
def pivot_order(spark, sf_dir):
    """Objects around a pivot by distance, then kind and place; the first fifty of each group."""
    p = pieces(spark, sf_dir, "l_linenumber = 1")
    d2 = (F.col("x") - 2000) * (F.col("x") - 2000) + (F.col("y") - 2000) * (F.col("y") - 2000)
    top = aggregates.top_n(p.withColumn("d2", d2), ["grp"], [F.col("d2"), F.col("kind"), F.col("x"), F.col("y"), F.col("id")], 50)
    return top.select("grp", "rank", "id", "d2")


SQL["pivot_order"] = f"""
    WITH {piece_sql("l_linenumber = 1")},
    r AS (SELECT *, (x - 2000) * (x - 2000) + (y - 2000) * (y - 2000) AS d2 FROM piece),
    k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY d2, kind, x, y, id) AS rank FROM r)
    SELECT grp, rank::INTEGER AS rank, id, d2 FROM k WHERE rank <= 50"""


@query
def block_extents(spark, sf_dir):
    """Extent, area and commonest heading of every group's objects."""
    p = pieces(spark, sf_dir, "l_linenumber <= 2")
    heading = p.groupBy("grp", (F.floor(F.col("roll") / 45) * 45).alias("heading")).agg(n_rows().alias("n")).groupBy("grp").agg(F.max_by("heading", F.struct("n", (-F.col("heading")).alias("o"))).alias("heading"))
    box = p.groupBy("grp").agg(n_rows().alias("n"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("depth"), F.count_distinct("kind").alias("kinds"))
    return box.join(heading, "grp")


SQL["block_extents"] = f"""
    WITH {piece_sql("l_linenumber <= 2")},
    h AS (SELECT grp, floor(roll / 45)::BIGINT * 45 AS heading, count(*) AS n FROM piece GROUP BY 1, 2),
    m AS (SELECT grp, heading, row_number() OVER (PARTITION BY grp ORDER BY n DESC, heading) AS k FROM h)
    SELECT p.grp, count(*) AS n, max(x) - min(x) AS width, max(y) - min(y) AS depth, count(DISTINCT kind) AS kinds, any_value(m.heading) AS heading
    FROM piece p JOIN m ON p.grp = m.grp AND m.k = 1 GROUP BY p.grp"""


@query
def walk_probability(spark, sf_dir):
    """Cells of each kind's footprint that are open often enough to walk on."""
    p = pieces(spark, sf_dir, "l_linenumber = 1")
    seen = p.select("kind", (F.col("x") % 8).alias("i"), (F.col("y") % 8).alias("j"), (F.col("id") % 3 == 0).alias("open"))
    n = seen.groupBy("kind", "i", "j").agg(n_rows().alias("seen"), F.count_if("open").alias("opened"))
    return n.withColumn("walkable", (F.col("opened") >= 0.25 * F.col("seen")) & (F.col("i") > 0))


SQL["walk_probability"] = f"""
    WITH {piece_sql("l_linenumber = 1")}
    SELECT kind, x % 8 AS i, y % 8 AS j, count(*) AS seen, count(*) FILTER (id % 3 = 0) AS opened, count(*) FILTER (id % 3 = 0) >= 0.25 * count(*) AND x % 8 > 0 AS walkable FROM piece GROUP BY kind, x % 8, y % 8"""


@query
def majority_modes(spark, sf_dir):
    """The commonest rider of every kind, kept where it has a majority or a share of 0.12."""
    p = pieces(spark, sf_dir, "l_linenumber <= 3").withColumn("rider", F.col("roll") % 90)
    n = aggregates.shares_of(p, ["kind", "rider"], ["kind"])
    m = n.groupBy("kind").agg(F.max_by(F.struct("rider", "n", "share"), F.struct("n", (-F.col("rider")).alias("o"))).alias("m"))
    return m.select("kind", "m.rider", "m.n", "m.share", (F.col("m.share") > 0.5).alias("majority"), (F.col("m.share") >= 0.12).alias("kept"))


SQL["majority_modes"] = f"""
    WITH {piece_sql("l_linenumber <= 3")},
    n AS (SELECT kind, roll % 90 AS rider, count(*) AS n FROM piece GROUP BY 1, 2),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY kind) AS share, row_number() OVER (PARTITION BY kind ORDER BY n DESC, rider) AS k FROM n)
    SELECT kind, rider, n, share, share > 0.5 AS majority, share >= 0.12 AS kept FROM s WHERE k = 1"""


# ---- roll-ups


@query
def archetype_rollup(spark, sf_dir):
    """Per map a few measures, then per archetype their mean, median, least and greatest; nulls skipped."""
    i = table(spark, sf_dir, "lineitem")
    per_map = i.groupBy((F.col("l_suppkey") % 25).alias("map")).agg(n_rows().alias("n"), F.avg("l_quantity").alias("q"), F.avg(F.when(F.col("l_suppkey") % 25 != 7, F.col("l_discount"))).alias("d"))
    kinds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("map"), F.col("n_regionkey").alias("archetype"))
    r = lambda f, c: F.round(f(c), 7)
    return per_map.join(kinds, "map").groupBy("archetype").agg(
        F.count("d").alias("maps"), r(F.avg, "q").alias("mean_q"), r(F.median, "q").alias("median_q"), F.min("n").alias("least_n"), F.max("n").alias("greatest_n"), r(F.avg, "d").alias("mean_d"), r(F.median, "d").alias("median_d")
    )


SQL["archetype_rollup"] = """
    WITH m AS (SELECT l_suppkey % 25 AS map, count(*) AS n, avg(l_quantity) AS q, avg(l_discount) FILTER (l_suppkey % 25 <> 7) AS d FROM lineitem GROUP BY 1)
    SELECT n_regionkey AS archetype, count(d) AS maps, round(avg(q), 7) AS mean_q, round(median(q), 7) AS median_q, min(n) AS least_n, max(n) AS greatest_n, round(avg(d), 7) AS mean_d, round(median(d), 7) AS median_d
    FROM m JOIN nation ON map = n_nationkey GROUP BY 1"""


@query
def road_aggregates(spark, sf_dir):
    """p10, median and p90 of widths of roads, by archetype; ribbons only count."""
    i = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("archetype"), (F.col("l_quantity") / 3).alias("width"), F.when(F.col("l_discount") < 0.06, "road").otherwise("terrain_ribbon").alias("verdict"))
    at = lambda q, name: F.round(F.percentile(F.when(F.col("verdict") == "road", F.col("width")), F.lit(q)), 7).alias(name)
    return i.groupBy("archetype").agg(F.count_if(F.col("verdict") == "road").alias("roads"), F.count_if(F.col("verdict") != "road").alias("ribbons"), at(0.1, "p10"), at(0.5, "median"), at(0.9, "p90"))


SQL["road_aggregates"] = """
    SELECT l_suppkey % 5 AS archetype, count(*) FILTER (l_discount < 0.06) AS roads, count(*) FILTER (NOT l_discount < 0.06) AS ribbons,
           round(quantile_cont(l_quantity / 3, 0.1) FILTER (l_discount < 0.06), 7) AS p10, round(quantile_cont(l_quantity / 3, 0.5) FILTER (l_discount < 0.06), 7) AS median, round(quantile_cont(l_quantity / 3, 0.9) FILTER (l_discount < 0.06), 7) AS p90
    FROM lineitem GROUP BY 1"""


@query
def scan_counters(spark, sf_dir):
    """Models by scan status, with the first problem of each."""
    p = table(spark, sf_dir, "part")
    status = F.when(F.col("p_size") % 13 == 0, "missing").when(F.col("p_retailprice") < 950, "unreadable").when(F.col("p_partkey") % 9 == 0, "no_box").otherwise("measured")
    return p.groupBy(status.alias("status")).agg(n_rows().alias("n"), F.min("p_partkey").alias("first"), F.count_distinct("p_brand").alias("families"))


SQL["scan_counters"] = """
    SELECT CASE WHEN p_size % 13 = 0 THEN 'missing' WHEN p_retailprice < 950 THEN 'unreadable' WHEN p_partkey % 9 = 0 THEN 'no_box' ELSE 'measured' END AS status, count(*) AS n, min(p_partkey) AS first, count(DISTINCT p_brand) AS families FROM part GROUP BY 1"""


@query
def role_vocabulary(spark, sf_dir):
    """The five most used textures of every role, with in how many maps they occur."""
    n = cells(spark, sf_dir).filter("t > 0").groupBy("map", "t").agg(n_rows().alias("n"))
    named = n.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("t"), "p_name", "p_type"), "t")
    total = named.groupBy(F.col("p_type").alias("role"), F.col("p_name").alias("texture")).agg(F.sum("n").alias("tiles"), F.count_distinct("map").alias("maps"))
    return aggregates.top_n(total, ["role"], [F.col("tiles").desc(), F.col("texture")], 5)


SQL["role_vocabulary"] = f"""
    WITH {CELL},
    v AS (SELECT p_type AS role, p_name AS texture, count(*) AS tiles, count(DISTINCT map) AS maps FROM cell JOIN part ON t = p_partkey WHERE t > 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY tiles DESC, texture) AS rank FROM v)
    SELECT role, texture, tiles, maps, rank::INTEGER AS rank FROM r WHERE rank <= 5"""


@query
def diverse_selection(spark, sf_dir):
    """The best patches of each feature: one of a map and archetype first, then two a map.

    Ranks stand for the greedy walk: the best of each archetype's maps comes first where
    neither its map nor its archetype was taken, which is the best patch of every archetype
    since a map has one archetype; then each map's next best, twelve in all.
    """
    i = table(spark, sf_dir, "lineitem").filter("l_orderkey % 50 = 0").select(
        F.col("l_linenumber").alias("feature"), (F.col("l_suppkey") % 25).alias("map"), (F.col("l_suppkey") % 25 % 5).alias("archetype"), (F.col("l_orderkey") * 10 + F.col("l_partkey") / 10000).alias("score")
    ).distinct()
    best = lambda *k: F.row_number().over(Window.partitionBy("feature", *k).orderBy(F.col("score").desc(), "map"))
    first = i.withColumns({"of_map": best("map"), "of_arch": best("archetype")}).withColumn("early", F.col("of_arch") == 1)
    left = first.withColumn("taken", F.max(F.col("early").cast("int")).over(Window.partitionBy("feature", "map")))
    # Of a map that gave its best early one more may come, else two.
    may = F.col("early") | (F.col("of_map") <= 2)
    order = Window.partitionBy("feature").orderBy(F.col("early").desc(), F.col("score").desc(), "map")
    return left.filter(may).withColumn("rank", F.row_number().over(order)).filter("rank <= 12").select("feature", "map", "archetype", F.round("score", 6).alias("score"), "rank")


SQL["diverse_selection"] = """
    WITH i AS (SELECT DISTINCT l_linenumber AS feature, l_suppkey % 25 AS map, l_suppkey % 25 % 5 AS archetype, l_orderkey * 10 + l_partkey / 10000 AS score FROM lineitem WHERE l_orderkey % 50 = 0),
    r AS (
        SELECT *, row_number() OVER (PARTITION BY feature, map ORDER BY score DESC, map) AS of_map, row_number() OVER (PARTITION BY feature, archetype ORDER BY score DESC, map) AS of_arch FROM i),
    k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY of_arch = 1 DESC, score DESC, map) AS rank FROM r WHERE of_arch = 1 OR of_map <= 2)
    SELECT feature, map, archetype, round(score, 6) AS score, rank::INTEGER AS rank FROM k WHERE rank <= 12"""


@query
def polyline_turns(spark, sf_dir):
    """Arc length, turn angles and straight runs along each user's path."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 17 % 101).cast("double").alias("x"), (F.col("event_id") * 29 % 97).cast("double").alias("y"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = e.withColumns({"dx": F.lead("x").over(w) - F.col("x"), "dy": F.lead("y").over(w) - F.col("y")})
    s = s.withColumns({"length": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "bearing": F.degrees(F.atan2("dy", "dx"))}).filter("length > 0")
    raw = F.lead("bearing").over(w) - F.col("bearing")
    turn = F.abs(F.pmod(raw + 180, F.lit(360.0)) - 180)
    return s.withColumn("turn", turn).groupBy("user_id").agg(F.round(F.sum("length"), 6).alias("arc"), F.round(F.max("turn"), 6).alias("sharpest"), F.count_if(F.col("turn") < 15).alias("straight"), n_rows().alias("segments"))


SQL["polyline_turns"] = """
    WITH e AS (SELECT user_id, event_id, (event_id * 17 % 101)::DOUBLE AS x, (event_id * 29 % 97)::DOUBLE AS y FROM events),
    d AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT *, sqrt(dx * dx + dy * dy) AS length, degrees(atan2(dy, dx)) AS bearing FROM d WHERE dx * dx + dy * dy > 0),
    r AS (SELECT *, lead(bearing) OVER (PARTITION BY user_id ORDER BY event_id) - bearing + 180 AS raw FROM s),
    t AS (SELECT *, abs(raw - 360 * floor(raw / 360) - 180) AS turn FROM r)
    SELECT user_id, round(sum(length), 6) AS arc, round(max(turn), 6) AS sharpest, count(*) FILTER (turn < 15) AS straight, count(*) AS segments FROM t GROUP BY user_id"""


@query
def baseline_band(spark, sf_dir):
    """A baseline from every seventh point, by position and not by chance."""
    p = points(spark, sf_dir).withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).filter("at % 7 = 0")
    at = lambda q, name: F.round(F.percentile("x", F.lit(q)), 9).alias(name)
    return p.groupBy("label").agg(n_rows().alias("n"), at(0.1, "low"), at(0.9, "high"))


SQL["baseline_band"] = f"""
    WITH {POINTS}, p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS nth FROM point)
    SELECT label, count(*) AS n, round(quantile_cont(x, 0.1), 9) AS low, round(quantile_cont(x, 0.9), 9) AS high FROM p WHERE nth % 7 = 0 GROUP BY label"""


# ---- text sources


def files(spark, sf_dir, line, header: str = "") -> DataFrame:
    """(file, text): one text a nation, a line a supplier in order of their keys."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), F.struct("s_suppkey", line.alias("line")).alias("l"))
    return s.groupBy("file").agg(F.concat(F.lit(header), F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\r\n"), F.lit("\r\n")).alias("text"))


@query
def dungeon_areas(spark, sf_dir):
    """Dungeon files: a name and five numbers a line, comments and short lines skipped."""
    k = F.col("s_suppkey")
    line = F.when(k % 7 == 0, F.lit("# remark 1 2 3 4 5")).when(k % 5 == 0, F.lit("short 1 2")).otherwise(F.concat_ws(" ", F.concat(F.lit("area"), k), k * 3, k * 5, F.concat(k, F.lit("m")), F.lit("junk"), k % 4))
    return textfiles.dungeons(files(spark, sf_dir, line))


SQL["dungeon_areas"] = """
    SELECT s_nationkey AS file, 'area' || s_suppkey AS name, [s_suppkey * 3, s_suppkey * 5, s_suppkey, 0, s_suppkey % 4]::BIGINT[] AS n FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0"""
SQL["dungeon_areas"] = f"SELECT file, name, n[1] AS x, n[2] AS y, n[3] AS sx, n[4] AS sy, n[5] AS dir FROM ({SQL['dungeon_areas']})"


@query
def map_index(spark, sf_dir):
    """Index files: number and name, the duplicates marked."""
    k = F.col("s_suppkey")
    line = F.when(k % 6 == 0, F.lit("// remark")).otherwise(F.concat(F.lit("\t"), k % 9, F.lit("  map_"), k))
    return textfiles.indexes(files(spark, sf_dir, line))


SQL["map_index"] = """
    WITH e AS (SELECT s_nationkey AS file, s_suppkey % 9 AS number, 'map_' || s_suppkey AS name, s_suppkey FROM supplier WHERE s_suppkey % 6 <> 0)
    SELECT file, number, name, row_number() OVER (PARTITION BY file, number ORDER BY s_suppkey) > 1 AS duplicate FROM e"""


@query
def town_places(spark, sf_dir):
    """Town files: one place, and three more where eight numbers stand."""
    k = F.col("s_suppkey")
    return textfiles.towns(files(spark, sf_dir, F.concat_ws(" ", k, k * 2), "// towns\r\n"))


SQL["town_places"] = """
    WITH n AS (SELECT s_nationkey AS file, list(v ORDER BY s_suppkey, i) AS n FROM (SELECT s_nationkey, s_suppkey, unnest([s_suppkey, s_suppkey * 2]) AS v, unnest([1, 2]) AS i FROM supplier) GROUP BY 1)
    SELECT file, n[1] AS x, n[2] AS y, CASE WHEN len(n) >= 8 THEN n[3] END AS x1, CASE WHEN len(n) >= 8 THEN n[4] END AS y1, CASE WHEN len(n) >= 8 THEN n[5] END AS x2, CASE WHEN len(n) >= 8 THEN n[6] END AS y2,
           CASE WHEN len(n) >= 8 THEN n[7] END AS x3, CASE WHEN len(n) >= 8 THEN n[8] END AS y3 FROM n"""


@query
def reserve_list(spark, sf_dir):
    """Retired ids, and which of them are in use again."""
    k = F.col("s_suppkey")
    retired = textfiles.reserves(files(spark, sf_dir, F.when(k % 4 == 0, F.lit(" ")).otherwise(F.concat(k * 3, F.lit(" old")))))
    used = table(spark, sf_dir, "part").filter("p_size > 20").select(F.col("p_partkey").alias("id")).withColumn("reused", F.lit(True))
    return retired.join(used, "id", "left").select("file", "id", F.coalesce("reused", F.lit(False)).alias("reused"))


SQL["reserve_list"] = "SELECT s_nationkey AS file, s_suppkey * 3 AS id, s_suppkey * 3 IN (SELECT p_partkey FROM part WHERE p_size > 20) AS reused FROM supplier WHERE s_suppkey % 4 <> 0"


@query
def clipboard_paste(spark, sf_dir):
    """Pasted objects: offsets, y growing north, records with at least eight fields."""
    k = F.col("s_suppkey")
    line = F.when(k % 9 == 0, F.lit("1 2 3")).otherwise(F.concat_ws(" ", k, k * 2, F.lit("0"), k * 7, F.lit("0"), F.lit("0"), k * 50, F.lit("1.5")))
    return textfiles.pastes(files(spark, sf_dir, line, "OBJECTS\r\n4\r\n"), "OBJECTS")


SQL["clipboard_paste"] = "SELECT s_nationkey AS file, s_suppkey::DOUBLE AS x, s_suppkey * 2::DOUBLE AS y, s_suppkey * 7 AS id, (s_suppkey * 50 % 360)::DOUBLE AS roll, 1.5::DOUBLE AS bias FROM supplier WHERE s_suppkey % 9 <> 0"


@query
def environment_groups(spark, sf_dir):
    """Environment files: values inside brace groups, by the path of their groups."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    text = F.concat(F.lit('ScriptType Sky\r\nGroup Fog\r\n{\r\n  Enable '), k % 2, F.lit("\r\n  Color "), k, F.lit(" 0.5 1\r\n  Group Deep\r\n  {\r\n    Near "), k * 10, F.lit("\r\n  }\r\n}\r\nGroup Light\r\n{\r\n  Name \"a "), k, F.lit("\"\r\n}\r\n"))
    return textfiles.groups(s.select(k.alias("file"), text.alias("text")))


SQL["environment_groups"] = """
    SELECT s_suppkey AS file, unnest(['scripttype', 'fog/enable', 'fog/color', 'fog/deep/near', 'light/name']) AS key,
           unnest(['Sky', (s_suppkey % 2)::VARCHAR, s_suppkey || ',0.5,1', (s_suppkey * 10)::VARCHAR, 'a ' || s_suppkey]) AS "values" FROM supplier"""


@query
def orphan_sectors(spark, sf_dir):
    """Sector folders one level too deep: never read, but found by a recursive search."""
    s = table(spark, sf_dir, "supplier")
    name = lambda a: F.lpad((F.col("s_suppkey") % a * 1000 + F.col("s_suppkey") % 7).cast("string"), 6, "0")
    path = F.concat(F.lit("m"), F.col("s_nationkey"), F.lit("/"), name(5), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("/"), name(3))).otherwise(F.lit("")), F.lit("/height.raw"))
    return s.select(path.alias("path")).distinct().filter(F.col("path").rlike(r"^[^/]+/[0-9]{6}/[0-9]{6}/height\.raw$"))


SQL["orphan_sectors"] = r"""
    SELECT DISTINCT 'm' || s_nationkey || '/' || lpad((s_suppkey % 5 * 1000 + s_suppkey % 7)::VARCHAR, 6, '0') || '/' || lpad((s_suppkey % 3 * 1000 + s_suppkey % 7)::VARCHAR, 6, '0') || '/height.raw' AS path FROM supplier WHERE s_suppkey % 4 = 0"""


@query
def pattern_reader(spark, sf_dir):
    """Typed reading of JSON patterns; unknown keys are reported, broken ones fail."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.replace(F.col("props"), F.lit("}"), F.lit(', "odd": 1}'))).otherwise(F.col("props"))
    read = e.select("event_id", F.from_json(text, "k int", {"mode": "FAILFAST"}).alias("p"), F.array_join(F.array_except(F.json_object_keys(text), F.array(F.lit("k"))), ",").alias("unknown"))
    return read.select("event_id", "p.k", "unknown")


SQL["pattern_reader"] = "SELECT event_id, (props->>'k')::INTEGER AS k, CASE WHEN event_id % 5 = 0 THEN 'odd' ELSE '' END AS unknown FROM events"


@query
def model_boxes(spark, sf_dir):
    """Boxes, centres and sizes of models from their triangles."""
    i = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("model"), (F.col("l_orderkey") % 977).cast("double").alias("x"), (F.col("l_suppkey") * 3).cast("double").alias("y"), F.col("l_quantity").alias("z"))
    ends = [f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.min, "low"), (F.max, "high"))]
    return i.groupBy("model").agg(n_rows().alias("vertices"), *ends).withColumns({"width": F.col("x_high") - F.col("x_low"), "depth": F.col("y_high") - F.col("y_low"), "height": F.col("z_high") - F.col("z_low")})


SQL["model_boxes"] = """
    WITH v AS (SELECT l_partkey % 40 AS model, (l_orderkey % 977)::DOUBLE AS x, (l_suppkey * 3)::DOUBLE AS y, l_quantity AS z FROM lineitem)
    SELECT model, count(*) AS vertices, min(x) AS x_low, max(x) AS x_high, min(y) AS y_low, max(y) AS y_high, min(z) AS z_low, max(z) AS z_high, max(x) - min(x) AS width, max(y) - min(y) AS depth, max(z) - min(z) AS height FROM v GROUP BY model"""


@query
def corpus_pruned(spark, sf_dir):
    """A corpus scan of some maps only, each with its first sectors."""
    c = cells(spark, sf_dir).filter(F.col("map").isin("A", "R"))
    s = c.groupBy("map", F.floor(F.col("gx") / 16).alias("sx"), F.floor(F.col("gy") / 16).alias("sy")).agg(F.sum("h").alias("h"))
    return aggregates.top_n(s, ["map"], [F.col("sx"), F.col("sy")], 6).drop("rank")


SQL["corpus_pruned"] = f"""
    WITH {CELL}, s AS (SELECT map, gx // 16 AS sx, gy // 16 AS sy, sum(h) AS h FROM cell WHERE map IN ('A', 'R') GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY map ORDER BY sx, sy) AS k FROM s) SELECT map, sx, sy, h FROM r WHERE k <= 6"""
