"""DuckDB SQL of the registered queries, written apart from the Spark plans."""

from __future__ import annotations

import zlib

from gridloom.plans.surrogates import CELL, POINTS

SLOPE = """
    corner AS (
        SELECT map, gx, gy, h, t, attr, block, water,
               lead(h) OVER (PARTITION BY map, gy ORDER BY gx) AS e, lead(h) OVER (PARTITION BY map, gx ORDER BY gy) AS s FROM cell),
    square AS (SELECT *, lead(e) OVER (PARTITION BY map, gx ORDER BY gy) AS se FROM corner),
    grad AS (SELECT *, ((e - h) + (se - s)) * 100.0::DOUBLE / 2 / 200.0::DOUBLE AS dx, ((s - h) + (se - e)) * 100.0::DOUBLE / 2 / 200.0::DOUBLE AS dy FROM square WHERE se IS NOT NULL),
    slope AS (SELECT *, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope FROM grad)"""
NEAR4 = """
    near AS (
        SELECT *, lag({c}) OVER r AS w, lead({c}) OVER r AS e, lag({c}) OVER k AS n, lead({c}) OVER k AS s FROM cell
        WINDOW r AS (PARTITION BY map, gy ORDER BY gx), k AS (PARTITION BY map, gx ORDER BY gy))"""
BORDER = """
    step AS (
        SELECT map, 'x' AS axis, gx, gy, h, lead(h) OVER (PARTITION BY map, gy ORDER BY gx) AS o FROM cell
        UNION ALL SELECT map, 'y', gx, gy, h, lead(h) OVER (PARTITION BY map, gx ORDER BY gy) FROM cell),
    border AS (
        SELECT map, axis, gx // 16 AS sx, gy // 16 AS sy, abs(h - o) AS d FROM step
        WHERE o IS NOT NULL AND CASE axis WHEN 'x' THEN gx ELSE gy END % 16 = 15)"""
PAIRS = """
    pair AS (
        SELECT p.id AS a, q.id AS b, p.label AS a_label, q.label AS b_label, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2
        FROM point p JOIN point q ON p.id < q.id WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.05::DOUBLE * 0.05::DOUBLE)"""
NEAREST = """
    nn AS (
        SELECT p.id, p.label, min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) FILTER (p.label = q.label) AS same,
               min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) FILTER (p.label <> q.label) AS other
        FROM point p LEFT JOIN point q ON p.id <> q.id GROUP BY p.id, p.label)"""
# Components by closure over runs: rows of set cells as runs, linked where they overlap.
COMPONENTS = """
    wet AS (SELECT map, gx, gy, gx - row_number() OVER (PARTITION BY map, gy ORDER BY gx) AS k FROM cell WHERE h % 3 <> 0),
    runs AS (SELECT map, gy, min(gx) AS a, max(gx) AS b, gy * 64 + min(gx) AS id FROM wet GROUP BY map, gy, k),
    links AS (
        SELECT p.map, p.id AS u, q.id AS v FROM runs p JOIN runs q ON p.map = q.map AND abs(p.gy - q.gy) = 1 AND p.a <= q.b AND q.a <= p.b),
    reach AS (SELECT map, id AS u, id AS v FROM runs UNION SELECT r.map, r.u, l.v FROM reach r JOIN links l ON r.map = l.map AND r.v = l.u),
    named AS (SELECT map, u AS id, min(v) AS component FROM reach GROUP BY map, u),
    comp AS (SELECT r.map, n.component, r.gy, r.a, r.b, r.b - r.a + 1 AS n FROM runs r JOIN named n ON r.map = n.map AND r.id = n.id)"""
HEADING = "heading AS (SELECT l_returnflag AS map, (l_partkey % 360)::BIGINT AS heading FROM lineitem)"


def build(body: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(p.strip() for p in parts)} {body}"


def cell(body: str, *parts: str, recursive: bool = False) -> str:
    return build(body, CELL, *parts, recursive=recursive)


BAND = "CASE " + " ".join(f"WHEN slope >= {e} THEN {i}" for i, e in reversed(list(enumerate((0, 5, 10, 15, 20, 25, 30, 35, 40, 50, 60))))) + " END"

SQL: dict[str, str] = {
    "stream_seeds": "SELECT * FROM (VALUES " + ", ".join(f"({n}, {zlib.crc32(f'terrain/{n + 4242}'.encode())}::BIGINT)" for n in range(25)) + ") v(n_nationkey, seed)",
    "tile_coverage": cell(
        "SELECT map, t, n, n / sum(n) OVER (PARTITION BY map) AS of_valid, CASE WHEN t > 0 THEN n / sum(n) FILTER (t > 0) OVER (PARTITION BY map) END AS of_painted FROM c",
        "c AS (SELECT map, t, count(*) AS n FROM cell GROUP BY ALL)",
    ),
    "attr_flag_coverage": cell(
        "SELECT map, bit::INTEGER AS bit, count(*) FILTER ((attr >> bit) & 1 = 1) AS n, count(*) FILTER ((attr >> bit) & 1 = 1) / count(*) AS share FROM cell, (SELECT unnest(range(8))::INTEGER AS bit) GROUP BY map, bit"
    ),
    "attr_bytes": cell("SELECT map, attr, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY map) AS share FROM cell GROUP BY map, attr"),
    "slope_histogram": cell("SELECT map, greatest(0, least(floor((slope - 0) / 5.0), 17))::INTEGER AS bin, count(*) AS n FROM slope GROUP BY ALL", SLOPE),
    "hist_percentiles": cell(
        "SELECT map, min(bin) FILTER (upto >= 0.05::DOUBLE * total) * 10.0::DOUBLE + 5.0 AS p5, min(bin) FILTER (upto >= 0.5::DOUBLE * total) * 10.0::DOUBLE + 5.0 AS p50, min(bin) FILTER (upto >= 0.95::DOUBLE * total) * 10.0::DOUBLE + 5.0 AS p95 FROM c GROUP BY map",
        "b AS (SELECT map, greatest(0, least(h // 10, 59))::INTEGER AS bin, count(*) AS n FROM cell GROUP BY ALL)",
        "c AS (SELECT *, sum(n) OVER (PARTITION BY map ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY map) AS total FROM b)",
    ),
    "exact_percentiles": cell(
        "SELECT map, " + ", ".join(f"quantile_cont(h, {q}) AS {n}" for q, n in ((0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"))) + " FROM cell GROUP BY map"
    ),
    "weighted_quantiles": cell(
        "SELECT map, " + ", ".join(
            f"coalesce(max(CASE WHEN pc IS NULL THEN v::DOUBLE ELSE pv + (v - pv) * (total * {q}::DOUBLE - pc) / (c - pc) END) FILTER (c >= total * {q}::DOUBLE AND (pc < total * {q}::DOUBLE OR pc IS NULL)), max(v)::DOUBLE) AS q{round(q * 100)}"
            for q in (0.1, 0.5, 0.9)
        ) + " FROM m GROUP BY map",
        "s AS (SELECT map, h AS v, sum(t + 1) AS w FROM cell GROUP BY ALL)",
        "k AS (SELECT *, sum(w) OVER (PARTITION BY map ORDER BY v) - w / 2 AS c, (sum(w) OVER (PARTITION BY map))::DOUBLE AS total FROM s)",
        "m AS (SELECT *, lag(c) OVER (PARTITION BY map ORDER BY v) AS pc, lag(v) OVER (PARTITION BY map ORDER BY v) AS pv FROM k)",
    ),
    "quantisation_stats": cell(
        """SELECT map, count(*) AS distinct_h, (SELECT h FROM b x WHERE x.map = g.map ORDER BY n DESC, h LIMIT 1) AS modal_h, max(n) / sum(n) AS modal_share,
                  sum(CASE WHEN h % 5 = 0 THEN n ELSE 0 END) / sum(n) AS of_five,
                  (SELECT max(d) FROM (SELECT unnest(range(1, 2000)) AS d) WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.map = g.map AND (y.h - (SELECT min(h) FROM b z WHERE z.map = g.map)) % d <> 0))::BIGINT AS divisor,
                  min(gap) AS least_gap, quantile_cont(gap, 0.5) AS median_gap FROM g GROUP BY map""",
        "b AS (SELECT map, h, count(*) AS n FROM cell GROUP BY ALL)",
        "g AS (SELECT *, lead(h) OVER (PARTITION BY map ORDER BY h) - h AS gap FROM b)",
    ),
    "coverage_entropy": cell(
        "SELECT map, round(-sum(p * log2(p)), 6) AS bits, round(pow(2.0::DOUBLE, -sum(p * log2(p))), 6) AS effective FROM c GROUP BY map",
        "b AS (SELECT map, t, count(*) AS n FROM cell WHERE t > 0 GROUP BY ALL)", "c AS (SELECT map, n / sum(n) OVER (PARTITION BY map) AS p FROM b)",
    ),
    "block_by_slope_band": cell(f"SELECT map, ({BAND})::INTEGER AS band, count(*) AS n, count(*) FILTER (block) AS blocked, count(*) FILTER (block) / count(*) AS share FROM slope GROUP BY map, band", SLOPE),
    "roc_sweep_youden": cell(
        "SELECT *, row_number() OVER (PARTITION BY map ORDER BY j DESC, cut) = 1 AS best FROM (SELECT map, cut, tp, fp, tpr, fpr, tpr - fpr AS j FROM r)",
        SLOPE,
        "cuts AS (SELECT DISTINCT map, i::INTEGER AS cut FROM slope, (SELECT unnest(range(81)) AS i))",
        "a AS (SELECT c.map, c.cut, count(*) FILTER (block AND least(floor(slope), 80) >= cut) AS tp, count(*) FILTER (NOT block AND least(floor(slope), 80) >= cut) AS fp, count(*) FILTER (block) AS p, count(*) FILTER (NOT block) AS f FROM cuts c JOIN slope s ON c.map = s.map GROUP BY c.map, c.cut)",
        "r AS (SELECT map, cut, tp, fp, CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS tpr, CASE WHEN f > 0 THEN fp / f ELSE 0.0 END AS fpr FROM a)",
    ),
    "p50_crossing": cell(
        "SELECT map, min(degree) FILTER (n >= 20 AND 2 * b >= n) AS degree FROM d GROUP BY map",
        SLOPE, "d AS (SELECT map, floor(slope)::INTEGER AS degree, count(*) AS n, count(*) FILTER (block) AS b FROM slope GROUP BY ALL)",
    ),
    "block_budget": cell(
        "SELECT map, cause, n, n / sum(n) OVER (PARTITION BY map) AS share FROM c",
        "seed AS (SELECT map, gx, gy FROM cell WHERE t = 7)",
        """k AS (SELECT c.map, CASE WHEN h > 80 THEN 'slope' WHEN water THEN 'water'
             WHEN EXISTS (SELECT 1 FROM seed s WHERE s.map = c.map AND abs(s.gx - c.gx) <= 1 AND abs(s.gy - c.gy) <= 1) THEN 'halo'
             WHEN gx < 4 OR gx > 59 OR gy < 4 OR gy > 59 THEN 'out_of_bounds' ELSE 'residual' END AS cause FROM cell c WHERE block)""",
        "c AS (SELECT map, cause, count(*) AS n FROM k GROUP BY ALL)",
    ),
    "mask_agreement": cell(
        "SELECT *, coalesce(\"both\" / nullif(\"both\" + only_block + only_water, 0), 0.0) AS jaccard, coalesce(\"both\" / nullif(\"both\" + only_block, 0), 0.0) AS precision, coalesce(\"both\" / nullif(\"both\" + only_water, 0), 0.0) AS recall FROM c",
        "c AS (SELECT map, count(*) FILTER (block AND water) AS \"both\", count(*) FILTER (block AND NOT water) AS only_block, count(*) FILTER (NOT block AND water) AS only_water FROM cell GROUP BY map)",
    ),
    "clark_evans": build(
        """SELECT label, n, round(r, 6) AS r, CASE WHEN r < 0.9 THEN 'clumped' WHEN r > 1.1 THEN 'spread' ELSE 'random' END AS verdict
           FROM (SELECT label, n, mean_nn * 2 * sqrt(n / area) AS r FROM (SELECT label, count(*) AS n, avg(sqrt(same)) AS mean_nn FROM nn GROUP BY label)
                 JOIN (SELECT label, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM point GROUP BY label) USING (label) WHERE n >= 8 AND area > 0)""",
        POINTS, NEAREST,
    ),
    "circular_stats": build(
        "SELECT map, n, round(((degrees(atan2(s, c)) % 360) + 360) % 360, 4) AS mean, round(sqrt(c * c + s * s), 6) AS resultant, round(exp(-n * sqrt(c * c + s * s) * sqrt(c * c + s * s)), 6) AS rayleigh_p FROM a",
        HEADING, "a AS (SELECT map, count(*) AS n, avg(cos(radians(heading))) AS c, avg(sin(radians(heading))) AS s FROM heading GROUP BY map)",
    ),
    "snap_shares": build(
        "SELECT map, " + ", ".join(f"count(*) FILTER (least(heading % {k}, {k} - heading % {k}) < 0.5) / count(*) AS on_{k}" for k in (15, 45, 90)) + ", count(*) FILTER (heading <> 0) / count(*) AS turned FROM heading GROUP BY map",
        HEADING,
    ),
    "heading_histogram": build("SELECT map, least(heading // 10, 35)::INTEGER AS bin, count(*) AS n FROM heading GROUP BY ALL", HEADING),
    "radius_pairs": build("SELECT a, b, round(d2, 12) AS d2 FROM pair", POINTS, PAIRS),
    "cooccurrence_lift": build(
        """SELECT la, lb, obs, round(e, 6) AS expected, round(obs / e, 6) AS lift FROM (
             SELECT la, lb, obs, CASE WHEN la = lb THEN x.n * (x.n - 1) / 2 ELSE x.n * y.n END * pi() * 0.05::DOUBLE * 0.05::DOUBLE / (SELECT (max(x) - min(x)) * (max(y) - min(y)) FROM point) AS e
             FROM o JOIN c x ON x.label = la JOIN c y ON y.label = lb)""",
        POINTS, PAIRS, "c AS (SELECT label, count(*) AS n FROM point GROUP BY label)",
        "o AS (SELECT least(a_label, b_label) AS la, greatest(a_label, b_label) AS lb, count(*) AS obs FROM pair GROUP BY ALL)",
    ),
    "affinity_lift": """
        WITH n AS (SELECT p_brand AS id, l_returnflag AS class, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
        s AS (SELECT id, class, n, n / sum(n) OVER (PARTITION BY id) AS share, sum(n) OVER (PARTITION BY class) / sum(n) OVER () AS baseline FROM n)
        SELECT *, round(share / baseline, 9) AS lift FROM s""",
    "density_by_group": cell("SELECT map, count(*) FILTER (t > 0) AS placed, count(*) AS area, count(*) FILTER (t > 0) * 10000 / count(*) AS per_hectare FROM cell GROUP BY map"),
    "vocabulary_coverage": """
        WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
        r AS (SELECT row_number() OVER o AS k, sum(n) OVER (o ROWS UNBOUNDED PRECEDING)::BIGINT AS covered FROM n WINDOW o AS (ORDER BY n DESC, l_partkey))
        SELECT k::INTEGER AS k, covered, covered / (SELECT sum(n) FROM n) AS share FROM r WHERE k IN (25, 50, 100, 250, 500, 1000)""",
    "sector_relief": cell(
        "SELECT map, gx // 16 AS sx, gy // 16 AS sy, max(h) - min(h) AS relief, round(quantile_cont(slope, 0.5), 6) AS p50, round(max(slope), 6) AS steepest, count(*) FILTER (slope < 5) / count(*) AS flat FROM slope GROUP BY map, sx, sy", SLOPE
    ),
    "seam_agreement": cell("SELECT map, axis, count(*) AS n, count(*) FILTER (d = 0) AS exact, count(*) FILTER (d <= 1) AS within_one, avg(d) AS mean, quantile_cont(d, 0.99) AS p99, max(d) AS most FROM border GROUP BY map, axis", BORDER),
    "torn_borders": cell("SELECT * FROM (SELECT map, axis, sx, sy, quantile_cont(d, 0.5) AS median FROM border GROUP BY ALL) WHERE median > 10", BORDER),
    "plane_fit": cell(
        "SELECT map, round(suh / suu * 63, 6) AS east, round(svh / suu * 63, 6) AS south, round(sh / n, 6) AS mean, round((shh - sh * sh / n - suh / suu * suh - svh / suu * svh) / (shh - sh * sh / n), 6) AS residual FROM s",
        "s AS (SELECT map, count(*)::DOUBLE AS n, sum(h)::DOUBLE AS sh, sum(h * h)::DOUBLE AS shh, sum((2 * gx - 63) * h)::DOUBLE AS suh, sum((2 * gy - 63) * h)::DOUBLE AS svh, sum((2 * gx - 63) * (2 * gx - 63))::DOUBLE AS suu FROM cell GROUP BY map)",
    ),
    "laplacian_roughness": cell("SELECT map, count(l) AS n, sum(l)::BIGINT AS total, max(l) AS most FROM (SELECT map, abs(w + e + n + s - 4 * h) AS l FROM near) GROUP BY map", NEAR4.format(c="h")),
    "box_std": cell(
        "SELECT map, count(*) AS windows, round(avg(sqrt((9 * q - s * s) / 81)), 6) AS mean_std FROM b WHERE n = 9 GROUP BY map",
        "b AS (SELECT c.map, c.gx, c.gy, count(*) AS n, sum(d.h) AS s, sum(d.h * d.h) AS q FROM cell c JOIN cell d ON c.map = d.map AND d.gx BETWEEN c.gx - 1 AND c.gx + 1 AND d.gy BETWEEN c.gy - 1 AND c.gy + 1 GROUP BY ALL)",
    ),
    "rollup_three_grains": """
        SELECT r_name, n_name, grouping(r_name, n_name)::INTEGER AS grain, count(*) AS n, sum(floor(c_acctbal)::BIGINT)::BIGINT AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())""",
    "run_lengths": cell(
        "SELECT map, count(*) AS runs, max(n) AS longest, avg(n) AS mean, quantile_cont(n, 0.5) AS median FROM (SELECT map, gy, t, k, count(*) AS n FROM i GROUP BY ALL) GROUP BY map",
        "i AS (SELECT map, gy, t, gx - row_number() OVER (PARTITION BY map, gy, t ORDER BY gx) AS k FROM cell)",
    ),
    "event_runs": """
        WITH i AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
        SELECT event_type, count(*) AS runs, max(n) AS longest, sum(n)::BIGINT AS events FROM (SELECT user_id, event_type, k, count(*) AS n FROM i GROUP BY ALL) GROUP BY event_type""",
    "top_n_per_group": """
        SELECT * FROM (SELECT l_returnflag, l_partkey, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_partkey)::INTEGER AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 10""",
    "adjacency_pairs": cell(
        "SELECT map, least(t, o) AS a, greatest(t, o) AS b, count(*) AS n FROM p WHERE o IS NOT NULL GROUP BY ALL", NEAR4.format(c="t"), "p AS (SELECT map, t, e AS o FROM near UNION ALL SELECT map, t, s FROM near)"
    ),
    "perimeter_compactness": cell(
        "SELECT map, t, area, perimeter::BIGINT AS perimeter, round(4 * sqrt(area::DOUBLE) / perimeter, 9) AS compactness FROM (SELECT map, t, count(*) AS area, sum((w IS DISTINCT FROM t)::INT + (e IS DISTINCT FROM t)::INT + (n IS DISTINCT FROM t)::INT + (s IS DISTINCT FROM t)::INT) AS perimeter FROM near GROUP BY map, t)",
        NEAR4.format(c="t"),
    ),
    "splat_edge_density": cell("SELECT map, avg((e <> t)::INT) AS edge_density, count(*) FILTER (w = t AND e = t AND n = t AND s = t) / count(*) AS interior FROM near GROUP BY map", NEAR4.format(c="t")),
    "erode_survival": cell(
        "SELECT map, count(*) FILTER (m) AS e0, count(*) FILTER (m1) AS e1, count(*) FILTER (m1 AND coalesce(lag1, true) AND coalesce(lead1, true) AND coalesce(up1, true) AND coalesce(down1, true)) AS e2 FROM c GROUP BY map",
        "a AS (SELECT map, gx, gy, h % 4 <> 0 AS m FROM cell)",
        "b AS (SELECT map, gx, gy, m, m AND coalesce(lag(m) OVER r, true) AND coalesce(lead(m) OVER r, true) AND coalesce(lag(m) OVER k, true) AND coalesce(lead(m) OVER k, true) AS m1 FROM a WINDOW r AS (PARTITION BY map, gy ORDER BY gx), k AS (PARTITION BY map, gx ORDER BY gy))",
        "c AS (SELECT *, lag(m1) OVER r AS lag1, lead(m1) OVER r AS lead1, lag(m1) OVER k AS up1, lead(m1) OVER k AS down1 FROM b WINDOW r AS (PARTITION BY map, gy ORDER BY gx), k AS (PARTITION BY map, gx ORDER BY gy))",
    ),
    "alpha_bleed": cell(
        "SELECT c.map, slot::INTEGER AS slot, count(*) FILTER (t = slot OR (t > slot AND EXISTS (SELECT 1 FROM cell o WHERE o.map = c.map AND o.t = slot AND abs(o.gx - c.gx) <= 1 AND abs(o.gy - c.gy) <= 1))) AS opaque FROM cell c, (SELECT unnest(range(1, 8)) AS slot) GROUP BY c.map, slot"
    ),
    "rim_specks": cell(
        "SELECT map, t, count(*) FILTER (coalesce((w = t)::INT, 0) + coalesce((e = t)::INT, 0) + coalesce((n = t)::INT, 0) + coalesce((s = t)::INT, 0) <= 1) AS specks, count(*) AS n FROM near GROUP BY map, t", NEAR4.format(c="t")
    ),
    "downsample_any": cell("SELECT map, count(*) FILTER (a) AS \"any\", count(*) FILTER (e) AS every FROM (SELECT map, gx // 2, gy // 2, bool_or(block) AS a, bool_and(block) AS e FROM cell GROUP BY 1, 2, 3) GROUP BY map"),
    "downsample_majority": cell("SELECT map, count(*) FILTER (k >= 2) AS half FROM (SELECT map, gx // 2, gy // 2, count(*) FILTER (block) AS k FROM cell GROUP BY 1, 2, 3) GROUP BY map"),
    "chebyshev_halo": cell("SELECT map, count(*) FILTER (EXISTS (SELECT 1 FROM cell s WHERE s.map = c.map AND s.h % 50 = 49 AND abs(s.gx - c.gx) <= 2 AND abs(s.gy - c.gy) <= 2)) AS near FROM cell c GROUP BY map"),
    "isolated_points": cell(
        "SELECT map, gx, gy FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.map = b.map AND abs(a.gx - b.gx) <= 2 AND abs(a.gy - b.gy) <= 2 AND (a.gx <> b.gx OR a.gy <> b.gy))", "s AS (SELECT * FROM cell WHERE h % 50 = 49)"
    ),
    "nearest_neighbours": build("SELECT id, label, round(same, 12) AS same, round(other, 12) AS other FROM nn", POINTS, NEAREST),
    "missing_registry": "SELECT l_partkey AS id, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5) GROUP BY 1",
    "registry_join": "SELECT coalesce(p_brand, '(unresolved)') AS brand, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey GROUP BY 1",
    "bag_difference": """
        WITH f AS (SELECT l_linenumber, l_quantity::BIGINT AS q FROM lineitem WHERE l_linestatus = 'F'), o AS (SELECT l_linenumber, l_quantity::BIGINT AS q FROM lineitem WHERE l_linestatus = 'O')
        SELECT l_linenumber, count(*) AS n, 'only_f' AS side FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM o) GROUP BY 1
        UNION ALL SELECT l_linenumber, count(*), 'only_o' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM f) GROUP BY 1""",
    "companions_topk": build(
        "SELECT * FROM (SELECT label, companion, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, companion)::INTEGER AS rank FROM c) WHERE rank <= 10",
        POINTS, PAIRS, "c AS (SELECT label, companion, count(*) AS n FROM (SELECT a_label AS label, b_label AS companion FROM pair UNION ALL SELECT b_label, a_label FROM pair WHERE a_label <> b_label) GROUP BY ALL)",
    ),
    "connected_components": cell("SELECT map, component::BIGINT AS component, sum(n)::BIGINT AS size FROM comp GROUP BY map, component", COMPONENTS, recursive=True),
    "largest_component": cell("SELECT map, max(size) AS largest, count(*) AS components, count(*) FILTER (size = 1) AS single, max(size) / sum(size) AS largest_share FROM (SELECT map, component, sum(n)::BIGINT AS size FROM comp GROUP BY map, component) GROUP BY map", COMPONENTS, recursive=True),
    "border_mass": cell(
        "SELECT map, sum(n * e)::BIGINT AS border, sum(n * (1 - e))::BIGINT AS inner FROM (SELECT map, component, sum(n) AS n, max((a = 0 OR gy = 0 OR b = 63 OR gy = 63)::INT) AS e FROM comp GROUP BY map, component) GROUP BY map".replace("AS inner", 'AS "inner"'), COMPONENTS, recursive=True
    ),
    "component_shapes": cell(
        "SELECT map, shape, count(*) AS n FROM (SELECT map, CASE WHEN n / (w * d) >= 0.97 THEN 'rect' WHEN n / (w * d) BETWEEN 0.72 AND 0.85 AND w / d BETWEEN 0.9 AND 1.111 THEN 'circle' ELSE 'irregular' END AS shape FROM (SELECT map, component, sum(n) AS n, max(b) - min(a) + 1 AS w, max(gy) - min(gy) + 1 AS d FROM comp GROUP BY map, component) WHERE n >= 4) GROUP BY map, shape",
        COMPONENTS, recursive=True,
    ),
    "graph_invariants": cell(
        "SELECT v.map, v.v, v.e::BIGINT AS e, c.c, (v.e - v.v + c.c)::BIGINT AS cycles FROM (SELECT map, count(*) FILTER (h % 3 <> 0) AS v, sum((h % 3 <> 0 AND coalesce(e % 3 <> 0, false))::INT + (h % 3 <> 0 AND coalesce(s % 3 <> 0, false))::INT) AS e FROM near GROUP BY map) v JOIN (SELECT map, count(DISTINCT component) AS c FROM comp GROUP BY map) c ON v.map = c.map",
        NEAR4.format(c="h"), COMPONENTS, recursive=True,
    ),
    "findings_union": cell(
        """SELECT 'ARD-002' AS rule, 'major' AS severity, l_orderkey::VARCHAR AS where_, 'count mismatch' AS symptom, count(*)::VARCHAR AS detail, 'recount' AS fix FROM lineitem WHERE l_discount > 0.09 AND l_quantity >= 50 GROUP BY l_orderkey
           UNION ALL SELECT 'SEC-001', 'blocker', o_orderkey::VARCHAR, 'no sectors', o_orderstatus, 'add sectors' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
           UNION ALL SELECT 'HGT-001', 'major', concat_ws('/', map, axis, sx, sy), 'torn border', floor(quantile_cont(d, 0.5))::BIGINT::VARCHAR, 'weld' FROM border GROUP BY map, axis, sx, sy HAVING quantile_cont(d, 0.5) > 10
           UNION ALL SELECT 'TIL-001', 'minor', concat_ws('/', map, gx, gy), 'tile index above count', t::VARCHAR, 'repaint' FROM cell WHERE t = 7 AND h > 150""",
        BORDER,
    ),
    "duration_parse": """
        WITH e AS (SELECT event_id, (event_id % 3)::VARCHAR || 'h' || (event_id % 60)::VARCHAR || 'm' || (user_id % 60)::VARCHAR || CASE WHEN event_id % 2 = 0 THEN 's' ELSE '' END AS text, (event_id % 3) * 3600 + (event_id % 60) * 60 + CASE WHEN event_id % 2 = 0 THEN user_id % 60 ELSE 0 END AS seconds FROM events)
        SELECT event_id, text, seconds::BIGINT AS seconds FROM e""",
}
SQL["findings_by_severity"] = f"SELECT severity, rule, count(*) AS n FROM ({SQL['findings_union']}) GROUP BY severity, rule"

SQL |= {
    "frac_below": cell("SELECT map, count(*) FILTER (h < 50) / count(*) AS below_50 FROM cell GROUP BY map"),
    "edge_list_histogram": cell(
        "SELECT map, (CASE WHEN h < 10 THEN 0 WHEN h < 25 THEN 1 WHEN h < 50 THEN 2 WHEN h < 100 THEN 3 ELSE 4 END)::INTEGER AS band, count(*) AS n FROM cell WHERE h BETWEEN 0 AND 400 GROUP BY ALL"
    ),
    "repeated_median": cell("SELECT map, quantile_cont(h, 0.5) AS median FROM (SELECT map, h, unnest(range(greatest(t, 1))) FROM cell WHERE t > 0) GROUP BY map"),
    "style_split": cell(
        "SELECT *, CASE WHEN rate < 0.25 THEN 'slope_driven' ELSE 'painted_box' END AS style FROM (SELECT map, count(*) FILTER (block) / count(*) AS rate FROM slope WHERE NOT water AND slope < 20 GROUP BY map)", SLOPE
    ),
    "control_lift": cell(
        "SELECT map, avg(block::INT) FILTER (k = 0) AS rate, avg(block::INT) FILTER (k = 1) AS control, round(avg(block::INT) FILTER (k = 0) / avg(block::INT) FILTER (k = 1), 9) AS lift FROM (SELECT p.map, c.block, k FROM cell p, (VALUES (0, 0, 0), (6, 0, 1), (-6, 0, 1), (0, 6, 1), (0, -6, 1)) v(dx, dy, k) JOIN cell c ON c.map = p.map AND c.gx = p.gx + dx AND c.gy = p.gy + dy WHERE p.t = 7) GROUP BY map"
    ),
    "footprint_check": """
        WITH i AS (SELECT l_partkey, count(*) AS n, quantile_cont(l_quantity, 0.5) AS q FROM lineitem GROUP BY 1 HAVING count(*) >= 3)
        SELECT p_brand, count(*) AS ids, quantile_cont(q / p_size, 0.5) AS ratio FROM i JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "server_compare": cell(
        "SELECT map, count(*) AS cells, count(*) FILTER (server <> client) AS differ, max(server) AS most FROM (SELECT map, attr & 7 AS client, CASE WHEN h % 97 = 5 AND ox = 1 THEN 0 ELSE attr & 7 END AS server FROM cell, (VALUES (0), (1)) a(ox), (VALUES (0), (1)) b(oy)) GROUP BY map"
    ),
    "patch_scan": cell(
        "SELECT map, px::INTEGER AS px, py::INTEGER AS py, n, relief, total::BIGINT AS total, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY map ORDER BY relief DESC, total DESC, px, py) AS rank FROM p) WHERE rank <= 2",
        "p AS (SELECT map, x.i AS px, y.i AS py, count(*) AS n, max(h) - min(h) AS relief, sum(h) AS total FROM cell, (SELECT unnest(range(7)) AS i) x, (SELECT unnest(range(7)) AS i) y WHERE gx BETWEEN x.i * 8 AND x.i * 8 + 15 AND gy BETWEEN y.i * 8 AND y.i * 8 + 15 GROUP BY map, x.i, y.i)",
    ),
    "even_samples": """
        WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
        SELECT p_brand, p_partkey FROM r WHERE i % greatest(1, n // 8) = 0 AND i // greatest(1, n // 8) < 8""",
    "palette_sets": cell(
        "SELECT map, (SELECT coalesce(string_agg(i::VARCHAR, ',' ORDER BY i), '') FROM d WHERE i NOT IN (SELECT t FROM cell c WHERE c.map = m.map)) AS unused, (SELECT coalesce(string_agg(t::VARCHAR, ',' ORDER BY t), '') FROM (SELECT DISTINCT t FROM cell c WHERE c.map = m.map AND t > 0 AND t NOT IN (SELECT i FROM d))) AS undeclared, (SELECT count(*) FROM d WHERE i IN (SELECT t FROM cell c WHERE c.map = m.map))::INTEGER AS \"both\" FROM (SELECT DISTINCT map FROM cell) m",
        "d AS (SELECT unnest([1, 2, 3, 5, 6, 9]) AS i)",
    ),
    "submerged_masks": cell("SELECT map, count(*) FILTER (least(h, e, s, se) < 40) AS lowest, count(*) FILTER (h < 40) AS corner FROM square WHERE se IS NOT NULL GROUP BY map", SLOPE),
    "exposed_shore": cell(
        "SELECT c.map, count(*) AS plane, count(*) FILTER (dry > 0) AS boundary, count(*) FILTER (bare > 0) AS exposed FROM (SELECT c.map, c.gx, c.gy, count(*) FILTER (NOT o.water) AS dry, count(*) FILTER (NOT o.water AND o.h < c.h) AS bare FROM cell c JOIN cell o ON c.map = o.map AND abs(c.gx - o.gx) + abs(c.gy - o.gy) = 1 WHERE c.water AND c.gx BETWEEN 1 AND 62 AND c.gy BETWEEN 1 AND 62 GROUP BY ALL) c GROUP BY c.map"
    ),
    "ring_profile": cell(
        "SELECT map, ring, count(*) AS n, sum(h)::BIGINT AS total FROM (SELECT c.map, c.gx, c.gy, c.h, min(greatest(abs(s.gx - c.gx), abs(s.gy - c.gy)))::INTEGER AS ring FROM cell c JOIN cell s ON s.map = c.map AND s.h % 50 = 49 AND abs(s.gx - c.gx) <= 4 AND abs(s.gy - c.gy) <= 4 GROUP BY ALL) GROUP BY map, ring"
    ),
    "out_of_range_tiles": cell("SELECT map, CASE WHEN t > 6 THEN 'above_count' ELSE 'empty_slot' END AS kind, count(*) AS n FROM cell WHERE t > 6 OR t = 4 GROUP BY ALL"),
    "region_filters": cell(
        "SELECT map, count(*) FILTER ((gx - 32) * (gx - 32) + (gy - 32) * (gy - 32) <= 400) AS disc, count(*) FILTER (gx BETWEEN 8 AND 20 AND gy BETWEEN 8 AND 20) AS box, count(*) FILTER ((SELECT count(*) FROM e WHERE (y1 > gy + 0.5) <> (y2 > gy + 0.5) AND gx + 0.5 < (x2 - x1) * (gy + 0.5 - y1) / (y2 - y1)::DOUBLE + x1) % 2 = 1) AS polygon FROM cell GROUP BY map",
        "e AS (SELECT * FROM (VALUES (5, 5, 50, 10), (50, 10, 40, 55), (40, 55, 10, 40), (10, 40, 5, 5)) v(x1, y1, x2, y2))",
    ),
    "deep_unflagged": cell("SELECT *, deep >= 100 AND 2 * flagged >= deep AND deep - flagged > 0.4 * deep AS finding FROM (SELECT map, count(*) AS deep, count(*) FILTER (water) AS flagged FROM cell WHERE h < 60 GROUP BY map)"),
    "walkable_rock": cell("SELECT map, count(*) AS n, count(*) FILTER (NOT block) / count(*) AS walkable FROM slope WHERE slope >= 25 AND t >= 5 GROUP BY map", SLOPE),
    "spawn_zone_audit": cell(
        "SELECT CASE WHEN inside < 25 THEN 'outside' WHEN free < 0.6 * inside THEN 'blocked' ELSE 'fine' END AS finding, count(*) AS zones FROM (SELECT s_suppkey, count(block) AS inside, count(*) FILTER (NOT block) AS free FROM supplier LEFT JOIN cell ON map = ['A', 'N', 'R'][s_suppkey % 3 + 1] AND abs(gx - (s_suppkey * 7) % 70) <= 2 AND abs(gy - (s_suppkey * 13) % 70) <= 2 GROUP BY s_suppkey) GROUP BY 1"
    ),
    "sector_blocks": cell(
        "SELECT map, (u % 4)::INTEGER AS sx, (u // 4)::INTEGER AS sy, min(v)::INTEGER AS block FROM reach WHERE map IN (SELECT map FROM tie) GROUP BY map, u",
        BORDER,
        "tie AS (SELECT map, sy * 4 + sx AS a, CASE axis WHEN 'x' THEN sy * 4 + sx + 1 ELSE sy * 4 + sx + 4 END AS b FROM (SELECT map, axis, sx, sy, quantile_cont(d, 0.5) AS median FROM border GROUP BY ALL) WHERE median <= 60)",
        "link AS (SELECT map, a, b FROM tie UNION SELECT map, b, a FROM tie)",
        "reach AS (SELECT m.map, i AS u, i AS v FROM (SELECT DISTINCT map FROM cell) m, (SELECT unnest(range(16))::BIGINT AS i) UNION SELECT r.map, r.u, l.b FROM reach r JOIN link l ON r.map = l.map AND r.v = l.a)",
        recursive=True,
    ),
    "filled_holes": cell(
        "SELECT map, count(*) AS holes, sum(n)::BIGINT AS filled FROM (SELECT map, component, sum(n) AS n, max((a = 0 OR gy = 0 OR b = 63 OR gy = 63)::INT) AS e FROM comp GROUP BY map, component) WHERE e = 0 GROUP BY map",
        COMPONENTS.replace("h % 3 <> 0", "h % 3 = 0"), recursive=True,
    ),
}
