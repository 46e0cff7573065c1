"""Generators, edits and renderers: tables in, tables out; seeded steps are the same wherever they run."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import raster


def rows() -> Column:
    return F.count(F.lit(1))


# ---- graphs


def bfs(free: np.ndarray, start: tuple[int, int], most: int | None = None) -> np.ndarray:
    """4-connected steps from ``start`` over free positions, -1 where not reached within ``most``."""
    d = np.full(free.shape, -1, np.int64)
    front = np.zeros(free.shape, bool)
    front[start] = True
    step = 0
    while front.any() and (most is None or step <= most):
        d[front] = step
        wide = np.zeros_like(front)
        wide[1:] |= front[:-1]
        wide[:-1] |= front[1:]
        wide[:, 1:] |= front[:, :-1]
        wide[:, :-1] |= front[:, 1:]
        front = wide & free & (d < 0)
        step += 1
    return d


def maze(width: int, height: int, seed: int, loops: int = 0) -> list[tuple[int, int]]:
    """Doors between rooms of a grid: a random spanning tree, and ``loops`` walls reopened."""
    walls = [(y * width + x, y * width + x + 1) for y in range(height) for x in range(width - 1)]
    walls += [(y * width + x, (y + 1) * width + x) for y in range(height - 1) for x in range(width)]
    up = list(range(width * height))
    doors, shut = [], []
    for i in np.random.default_rng(seed).permutation(len(walls)).tolist():
        a, b = (find(up, n) for n in walls[i])
        (doors if a != b else shut).append(walls[i])
        up[max(a, b)] = min(a, b)
    return doors + shut[:loops]


def find(up: list[int], n: int) -> int:
    while up[n] != n:
        up[n] = up[up[n]]
        n = up[n]
    return n


def pieces_of(n: int, edges: list[tuple[int, int]]) -> int:
    """Number of components of n nodes."""
    up = list(range(n))
    for a, b in edges:
        a, b = find(up, a), find(up, b)
        up[max(a, b)] = min(a, b)
    return sum(up[i] == i for i in range(n))


def fill_runs(runs: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Adds the fewest pieces that fill ``length`` exactly, no two neighbours alike; null if none do.

    A dynamic program over length and last piece, folded inside the row: its state is one
    small array for each piece length.
    """
    k = len(lengths)
    far = F.lit(10**6)
    start = F.array(F.array(*[F.lit(0) for _ in range(k)]))  # nothing filled, any piece may come

    def step(best: Column, n: Column) -> Column:
        def one(i: int) -> Column:
            before = F.get(best, n - lengths[i])
            others = [F.get(before, F.lit(j)) for j in range(k) if j != i]
            first = F.when(n == lengths[i], F.lit(1))
            return F.coalesce(first, F.when(n > lengths[i], F.least(far, F.least(*others) + 1)), far)

        return F.concat(best, F.array(F.array(*[one(i) for i in range(k)])))

    table = F.aggregate(F.sequence(F.lit(1), F.col("length")), start, step)
    least = F.array_min(F.element_at(table, -1))
    return runs.select("length", F.when(least < far, least).alias("pieces"))


def reachable(edges: DataFrame, start: int) -> DataFrame:
    """(node): what undirected edges reach from ``start``; the frontier grows until it stands still."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().persist()
    seen, count = {start}, 0
    while len(seen) > count:  # nodes are rooms of one building: a small set on the driver
        count = len(seen)
        known = both.sparkSession.createDataFrame([(n,) for n in seen], "node long")
        seen |= {r["b"] for r in both.join(known, F.col("a") == F.col("node")).select("b").distinct().collect()}
    both.unpersist()
    return edges.sparkSession.createDataFrame([(n,) for n in sorted(seen)], "node long")


def arms(cell: DataFrame) -> DataFrame:
    """Adds the number of set 4-neighbours of a 0/1 mask m."""
    near = raster.neighbours(cell.select("map", "gx", "gy", "m"), "m", default=0)
    return near.select("map", "gx", "gy", "m", (F.col("m_w") + F.col("m_e") + F.col("m_n") + F.col("m_s")).alias("arms"))


def pruned(cell: DataFrame, rounds: int) -> DataFrame:
    """A skeleton whose loose ends inside the map are taken off, one cell a round."""
    for _ in range(rounds):
        a = arms(cell)
        w = Window.partitionBy("map")
        inner = (F.col("gx") > 0) & (F.col("gy") > 0) & (F.col("gx") < F.max("gx").over(w)) & (F.col("gy") < F.max("gy").over(w))
        cell = a.select("map", "gx", "gy", F.when((F.col("m") == 1) & (F.col("arms") <= 1) & inner, 0).otherwise(F.col("m")).alias("m"))
    return cell


def nodes(cell: DataFrame) -> DataFrame:
    """(map, gx, gy, kind) of a skeleton's cells: lone, end, path, T or X."""
    a = arms(cell).filter("m = 1")
    return a.select("map", "gx", "gy", F.element_at(F.array(*[F.lit(k) for k in ("lone", "end", "path", "T", "X")]), F.col("arms") + 1).alias("kind"))


# ---- ground


def plateau(cell: DataFrame, share: float) -> DataFrame:
    """Heights cut at the quantile that makes the wanted share one flat top."""
    top = F.sort_array(F.collect_list("h"))
    cut = cell.groupBy(F.col("map").alias("c_map")).agg(F.element_at(top, F.ceil(F.count(F.lit(1)) * F.lit(1 - share)).cast("int")).alias("cut"))
    j = cell.join(cut, F.col("map") == F.col("c_map"))
    return j.select("map", "gx", "gy", F.least("h", "cut").alias("h"), (F.col("h") >= F.col("cut")).alias("flat"))


def pad(cell: DataFrame, centre: tuple[int, int], radius: float, feather: float, height: float, unit: float) -> DataFrame:
    """Heights blended to a level pad by a smooth step of the distance, in whole raw units."""
    x, y = F.col("gx") - centre[0], F.col("gy") - centre[1]
    u = scalar.smoothstep((F.sqrt((x * x + y * y).cast("double")) - radius) / feather)
    return cell.withColumn("raw", F.floor((F.lit(height) + (F.col("h") - height) * u) / unit + 0.5))


def banded(bed: DataFrame, arc: str, length: int, above: int) -> DataFrame:
    """Cells with their band's surface (highest bed + ``above``) and its number inside the sector."""
    b = bed.withColumn("band", F.floor(F.col(arc) / length))
    s = b.withColumn("surface", F.max("h").over(Window.partitionBy("map", "band")) + above)
    s = s.withColumns({"sx": F.floor(F.col("gx") / 16), "sy": F.floor(F.col("gy") / 16)})
    return s.withColumn("layer", F.dense_rank().over(Window.partitionBy("map", "sx", "sy").orderBy("surface")) - 1)


def proportional(score: DataFrame, keys: Sequence[str], slot: str, wanted: Column, rounds: int) -> DataFrame:
    """Iterative proportional fitting of w: rows sum to one, slots approach their wanted shares.

    score: (keys, n, slot, w), one row for each key and slot: a small table of classes.
    """
    for _ in range(rounds):
        score = score.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*keys)))
        got = F.sum(F.col("w") * F.col("n")).over(Window.partitionBy(keys[0], slot)) / F.sum(F.col("w") * F.col("n")).over(Window.partitionBy(keys[0]))
        score = score.withColumn("w", F.col("w") * F.sqrt(wanted[F.col(slot)] / got))
    return score.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*keys)))


def attributes(cell: DataFrame, side: int) -> DataFrame:
    """Adds attr from slope, h and t by rules in their order; later rules write over earlier ones."""
    x, y = F.col("gx"), F.col("gy")
    border = (x < 2) | (y < 2) | (x > side - 4) | (y > side - 4)
    a = F.when((F.col("slope") >= 70) | border, 1).otherwise(0)
    a = F.when(F.col("h") < 60, a.bitwiseOR(2)).otherwise(a)
    a = F.when(F.col("t") == 6, scalar.clear_flag(a, 1)).otherwise(a)
    a = F.when((x < 2) | (y < 2), a.bitwiseOR(1)).otherwise(a)
    a = F.when(F.col("h") > 250, a.bitwiseOR(1)).otherwise(a)
    a = F.when(x.between(20, 30) & y.between(20, 30), a.bitwiseOR(4)).otherwise(a)
    return cell.withColumn("attr", a)


def server_copy(cell: DataFrame, mask: int, sector: int) -> DataFrame:
    """(map, sx, sy, x, y, value): masked flags at twice the resolution."""
    two = F.array(F.lit(0), F.lit(1))
    wide = cell.select("map", F.col("attr").bitwiseAND(mask).alias("value"), "gx", "gy", F.explode(two).alias("dx")).select("*", F.explode(two).alias("dy"))
    wide = wide.select("map", "value", (F.col("gx") * 2 + F.col("dx")).alias("x"), (F.col("gy") * 2 + F.col("dy")).alias("y"))
    return wide.withColumns({"sx": F.floor(F.col("x") / sector), "sy": F.floor(F.col("y") / sector)})


def spawn_cells(cell: DataFrame, block: int, least: int, stream: str) -> DataFrame:
    """(map, bx, by, gx, gy, free): of each block with room the free cell first in the stream's order."""
    free = cell.filter("NOT block").withColumn("k", F.md5(F.concat_ws(":", F.lit(stream), "map", "gx", "gy").cast("binary")))
    b = free.groupBy("map", F.floor(F.col("gx") / block).alias("bx"), F.floor(F.col("gy") / block).alias("by"))
    return b.agg(F.min_by("gx", "k").alias("gx"), F.min_by("gy", "k").alias("gy"), rows().alias("free")).filter(F.col("free") >= least)


def mesas(cell: DataFrame, centres: DataFrame, height: int) -> DataFrame:
    """Water cells within a centre's radius raised to ``height`` at least. centres: (cx, cy, r), a few."""
    disc = centres.select("cx", "cy", "r", F.explode(F.sequence(F.col("cx") - F.col("r"), F.col("cx") + F.col("r"))).alias("gx")).select("*", F.explode(F.sequence(F.col("cy") - F.col("r"), F.col("cy") + F.col("r"))).alias("gy"))
    disc = disc.filter("(gx - cx) * (gx - cx) + (gy - cy) * (gy - cy) <= r * r").select("gx", "gy").distinct().withColumn("in", F.lit(True))
    j = cell.join(disc, ["gx", "gy"], "left").withColumn("raised", F.coalesce("in", F.lit(False)) & F.col("water"))
    return j.select("map", "gx", "gy", F.when(F.col("raised"), F.greatest("h", F.lit(height))).otherwise(F.col("h")).alias("h"), "raised")


def stamp(places: DataFrame, pattern: DataFrame) -> DataFrame:
    """(gx, gy, value, stamps): a pattern at every place, turned by quarters; the last ordinal wins.

    places: (ordinal, x, y, quarter). pattern: (dx, dy, value), a set piece of bounded size,
    carried as one array column.
    """
    whole = pattern.agg(F.collect_list(F.struct("dx", "dy", "value")).alias("p"))
    c = places.join(F.broadcast(whole)).select("ordinal", "x", "y", "quarter", F.explode("p").alias("p"))
    q, dx, dy = F.col("quarter"), F.col("p.dx"), F.col("p.dy")
    gx = F.col("x") + F.when(q == 0, dx).when(q == 1, -dy).when(q == 2, -dx).otherwise(dy)
    gy = F.col("y") + F.when(q == 0, dy).when(q == 1, dx).when(q == 2, -dy).otherwise(-dx)
    return c.groupBy(gx.alias("gx"), gy.alias("gy")).agg(F.max_by("p.value", "ordinal").alias("value"), rows().alias("stamps"))


def changed(before: DataFrame, after: DataFrame, column: str, sector: int) -> DataFrame:
    """(map, sx, sy, n): the sectors an edit touched, the only ones to be written."""
    d = after.select("map", "gx", "gy", column).exceptAll(before.select("map", "gx", "gy", column))
    return d.groupBy("map", F.floor(F.col("gx") / sector).alias("sx"), F.floor(F.col("gy") / sector).alias("sy")).agg(rows().alias("n"))


def weld(vertex: DataFrame, side: int) -> DataFrame:
    """(map, gx, gy, h, tear, owners): vertices at the weighted mean of the sectors that own them."""
    at = vertex.withColumns({"gx": F.col("sx") * side + F.col("vx"), "gy": F.col("sy") * side + F.col("vy")})
    return at.groupBy("map", "gx", "gy").agg((F.sum(F.col("h") * F.col("weight")) / F.sum("weight")).alias("h"), (F.max("h") - F.min("h")).alias("tear"), rows().alias("owners"))


def merged(first: DataFrame, second: DataFrame, offset: int) -> DataFrame:
    """Two maps' cells in one key space, the second moved east, its slots numbered behind the first's."""
    used = first.agg(F.max("t").alias("used"))
    one = first.select("gx", "gy", F.col("t").alias("slot"), "h")
    # One row: the number of slots of the first map.
    two = second.join(F.broadcast(used)).select((F.col("gx") + offset).alias("gx"), "gy", F.when(F.col("t") == 0, 0).otherwise(F.col("t") + F.col("used")).alias("slot"), "h")
    both = one.unionAll(two)
    return both.withColumns({"sx": F.floor(F.col("gx") / 16), "sy": F.floor(F.col("gy") / 16)})


# ---- texts and bytes


def rendered(records: DataFrame) -> DataFrame:
    """(sector, text): placement files. records: (sector, order, x, y, z, id)."""
    end = "\r\n"
    listed = records.groupBy("sector").agg(F.array_sort(F.collect_list(F.struct("order", "x", "y", "z", "id"))).alias("r"))
    block = lambda r, i: F.concat_ws(end, F.format_string("Start Object%03d", i), F.format_string("  %.6f %.6f %.6f", r["x"], r["y"], r["z"]), F.concat(F.lit("  "), r["id"]), F.lit("End Object"))
    return listed.select("sector", F.concat(F.lit(f"AreaDataFile{end}ObjectCount "), F.size("r"), F.lit(end), F.array_join(F.transform("r", block), end), F.lit(end)).alias("text"))


def replayed(raw: Column, parsed: Column, wanted: Column, canonical: Column) -> Column:
    """The source as it was while its value is unchanged, else the canonical text."""
    return F.when(parsed.eqNullSafe(wanted), raw).otherwise(canonical)


def patch_bytes(cell: DataFrame, size: int, best: int) -> DataFrame:
    """(map, px, py, relief, hex, rank): the patches of most relief, heights as 16-bit little-endian."""
    h = F.struct("gy", "gx", "h")
    p = cell.groupBy("map", F.floor(F.col("gx") / size).alias("px"), F.floor(F.col("gy") / size).alias("py")).agg((F.max("h") - F.min("h")).alias("relief"), F.array_sort(F.collect_list(h)).alias("v"))
    hexed = F.array_join(F.transform("v", lambda x: F.format_string("%02X%02X", x["h"].bitwiseAND(255), F.shiftright(x["h"], 8))), "")
    rank = F.row_number().over(Window.partitionBy("map").orderBy(F.col("relief").desc(), "px", "py"))
    return p.withColumn("rank", rank).filter(F.col("rank") <= best).select("map", "px", "py", "relief", hexed.alias("hex"), "rank")
