"""Queries of the scalar functions and record predicates, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def spread(struct: str, *names: str) -> list:
    return [F.col(f"{struct}.{n}").alias(n) for n in names]


INT = r"coalesce(try_cast(regexp_extract({0}, '^\s*([+-]?\d+)', 1) AS BIGINT), 0)"
FLOAT = r"coalesce(try_cast(regexp_extract({0}, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) AS DOUBLE), 0.0::DOUBLE)"


# ---- numbers, rotations, ids, names


@query
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric prefixes of odd texts, and their unsigned 32 bits."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 7
    value = F.format_string("%.2f", F.col("value"))
    text = (
        F.when(n == 0, F.concat(F.lit("  "), value)).when(n == 1, F.concat(F.lit("-"), value, F.lit("xy"))).when(n == 2, F.lit("junk")).when(n == 3, F.concat(F.lit("+"), F.col("user_id")))
        .when(n == 4, F.concat(value, F.lit("e2"))).when(n == 5, F.lit("")).otherwise(F.concat(F.lit("."), F.col("user_id")))
    )
    whole = scalar.leading_int(F.col("text"))
    return e.select("event_id", text.alias("text")).select("event_id", whole.alias("whole"), scalar.leading_float(F.col("text")).alias("real"), scalar.unsigned32(whole).alias("unsigned"))


SQL["text_numbers"] = f"""
    WITH e AS (
        SELECT event_id, CASE event_id % 7 WHEN 0 THEN '  ' || printf('%.2f', value) WHEN 1 THEN '-' || printf('%.2f', value) || 'xy' WHEN 2 THEN 'junk' WHEN 3 THEN '+' || user_id
               WHEN 4 THEN printf('%.2f', value) || 'e2' WHEN 5 THEN '' ELSE '.' || user_id END AS text FROM events),
    n AS (SELECT event_id, {INT.format("text")} AS whole, {FLOAT.format("text")} AS real FROM e)
    SELECT event_id, whole, real, (whole & 4294967295)::BIGINT AS unsigned FROM n"""


def rotations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tenth = lambda c: F.concat((c % 360).cast("string"), F.lit("."), (c % 10).cast("string"))
    a, b, c = tenth(F.col("event_id") * 7), tenth(F.col("user_id")), tenth(F.col("event_id") + F.col("user_id"))
    n = F.col("event_id") % 3
    return e.select("event_id", F.when(n == 0, a).when(n == 1, F.concat_ws("#", a, b)).otherwise(F.concat_ws("#", a, b, c)).alias("token"))


TOKEN = """
    tenths AS (
        SELECT event_id, (event_id * 7 % 360) || '.' || (event_id * 7 % 10) AS a, (user_id % 360) || '.' || (user_id % 10) AS b,
               ((event_id + user_id) % 360) || '.' || ((event_id + user_id) % 10) AS c FROM events),
    tokens AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN a WHEN 1 THEN a || '#' || b ELSE a || '#' || b || '#' || c END AS token FROM tenths)"""


@query
def rotation_tokens(spark, sf_dir):
    """Honest and engine readings of rotation tokens."""
    r = rotations(spark, sf_dir).select("event_id", scalar.rotation(F.col("token")).alias("r"), scalar.engine_rotation(F.col("token")).alias("e"))
    return r.select("event_id", *spread("r", "yaw", "pitch", "roll"), *[F.col(f"e.{n}").alias(f"engine_{n}") for n in ("yaw", "pitch", "roll")])


SQL["rotation_tokens"] = f"""
    WITH {TOKEN},
    p AS (SELECT *, string_split(token, '#') AS s FROM tokens),
    q AS (SELECT event_id, token, s, len(s) AS n, coalesce(s[2], '') AS s2, coalesce(s[3], '') AS s3 FROM p)
    SELECT event_id,
           CASE WHEN n = 1 THEN 0.0 ELSE {FLOAT.format("s[1]")} END AS yaw, CASE WHEN n = 1 THEN 0.0 ELSE {FLOAT.format("s2")} END AS pitch,
           CASE WHEN n = 1 THEN {FLOAT.format("s[1]")} ELSE {FLOAT.format("s3")} END AS roll,
           CASE WHEN n = 1 THEN 0 ELSE {INT.format("s[1][1:len(s[1]) - 1]")} END AS engine_yaw,
           CASE WHEN n = 1 THEN 0 ELSE {INT.format("s2")} END AS engine_pitch,
           CASE WHEN n = 1 THEN {INT.format("s[1]")} WHEN n = 2 THEN 0 ELSE {INT.format("s3")} END AS engine_roll
    FROM q"""


@query
def scale_suffixes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter("l_orderkey % 10 = 0")
    scale = lambda c: F.concat((F.col(c) % 3).cast("string"), F.lit("."), (F.col(c) % 7).cast("string"))
    count = F.col("l_linenumber") % 4
    token = F.concat((F.col("l_partkey") * 4_000_037).cast("string"), F.when(count > 0, F.concat(F.lit("#"), scale("l_suppkey"))).otherwise(F.lit("")), F.when(count > 1, F.concat(F.lit("#"), scale("l_partkey"))).otherwise(F.lit("")))
    read = items.select(scalar.scaled_id(token).alias("t"))
    return read.groupBy("t.id", "t.sx", "t.sy", "t.sz").agg(F.count(F.lit(1)).alias("n"))


SQL["scale_suffixes"] = f"""
    WITH i AS (
        SELECT (l_partkey * 4000037) || CASE WHEN l_linenumber % 4 > 0 THEN '#' || (l_suppkey % 3) || '.' || (l_suppkey % 7) ELSE '' END
               || CASE WHEN l_linenumber % 4 > 1 THEN '#' || (l_partkey % 3) || '.' || (l_partkey % 7) ELSE '' END AS token FROM lineitem WHERE l_orderkey % 10 = 0),
    s AS (SELECT string_split(token, '#') AS s FROM i),
    r AS (
        SELECT ({INT.format("s[1]")} & 4294967295)::BIGINT AS id, CASE WHEN len(s) > 1 THEN {FLOAT.format("s[2]")} ELSE 1.0 END AS sx, CASE WHEN len(s) > 2 THEN {FLOAT.format("s[3]")} ELSE 1.0 END AS sy, 1.0::DOUBLE AS sz FROM s)
    SELECT id, sx, sy, sz, count(*) AS n FROM r GROUP BY ALL"""


@query
def sector_names(spark, sf_dir):
    """Names of sectors and back."""
    n = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 12).alias("x"), (F.col("s_suppkey") % 17).alias("y")).distinct()
    named = n.withColumn("name", scalar.sector_name(F.col("x"), F.col("y")))
    return named.select("x", "y", "name", F.expr("cast(name as int) div 1000").alias("x_back"), (F.col("name").cast("int") % 1000).alias("y_back"))


SQL["sector_names"] = """
    SELECT DISTINCT s_suppkey % 12 AS x, s_suppkey % 17 AS y, lpad((s_suppkey % 12 * 1000 + s_suppkey % 17)::VARCHAR, 6, '0') AS name,
           s_suppkey % 12 AS x_back, (s_suppkey % 17)::INTEGER AS y_back FROM supplier"""


# ---- paths, families, classes


def art(spark, sf_dir):
    """art(id, kind, path): made-up model and texture paths."""
    words = ["tile", "Field 01", "beach sand", "Grass", "stone_cliff", "snow", "lava", "river", "black", "ice_wall", "water"]
    folders = ["d:\\work\\world art\\zone\\a\\", "World Art/tree/", "world art/n/snow.m/", "", '"world art/b/obj/']
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % len(words) + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(f) for f in folders]), (F.col("p_size") % len(folders) + 1).cast("int"))
    base = F.concat(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("b"), F.col("p_size") % 4, F.lit("_"))).otherwise(F.lit("")), word, F.col("p_partkey") % 5, F.lit(".dds"))
    kind = F.when(F.col("p_partkey") % 6 == 0, F.lit("Tree")).otherwise(F.lit("Building"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), F.when(F.col("p_partkey") % 97 == 0, F.lit(None)).otherwise(F.concat(folder, base)).alias("path"))


ART = r"""
    art AS (
        SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'Tree' ELSE 'Building' END AS kind,
               CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE
                   ['d:\work\world art\zone\a\', 'World Art/tree/', 'world art/n/snow.m/', '', '"world art/b/obj/'][p_size % 5 + 1]
                   || CASE WHEN p_partkey % 4 = 0 THEN 'b' || (p_size % 4) || '_' ELSE '' END
                   || ['tile', 'Field 01', 'beach sand', 'Grass', 'stone_cliff', 'snow', 'lava', 'river', 'black', 'ice_wall', 'water'][p_partkey % 11 + 1] || (p_partkey % 5) || '.dds' END AS path
        FROM part),
    low AS (SELECT *, regexp_replace(trim(replace(lower(coalesce(path, '')), '\', '/')), '^"+|"+$', '', 'g') AS p0 FROM art),
    plain AS (SELECT *, CASE WHEN instr(p0, 'world art/') > 0 THEN substr(p0, instr(p0, 'world art/') + 10) ELSE p0 END AS p FROM low),
    named AS (SELECT *, string_split(p, '/')[-1] AS base FROM plain)""".replace("\\\\", "\\")


@query
def path_names(spark, sf_dir):
    p = art(spark, sf_dir).withColumn("plain", scalar.plain_path(F.col("path"), "world art/"))
    return p.select("id", "plain", scalar.base_name(F.col("plain")).alias("short"), F.substring_index(scalar.base_name(F.col("plain")), ".", 1).alias("species"))


SQL["path_names"] = f"WITH {ART} SELECT id, p AS plain, base AS short, string_split(base, '.')[1] AS species FROM named"


@query
def model_families(spark, sf_dir):
    p = art(spark, sf_dir).withColumn("plain", scalar.plain_path(F.col("path"), "world art/"))
    return p.groupBy(scalar.model_family(F.col("plain"), F.col("kind")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


SQL["model_families"] = f"""
    WITH {ART},
    f AS (
        SELECT CASE WHEN p = '' THEN '(no model)' WHEN kind = 'Tree' OR (instr(p, '/') > 0 AND substr(p, 1, len(p) - len(base) - 1) = 'tree')
                    THEN 'tree/' || CASE WHEN regexp_extract(base, '^([a-z]+[0-9]*)_', 1) <> '' THEN regexp_extract(base, '^([a-z]+[0-9]*)_', 1) ELSE 'other' END
                    WHEN instr(p, '/') = 0 THEN '(root)' ELSE substr(p, 1, len(p) - len(base) - 1) END AS family FROM named)
    SELECT family, count(*) AS n FROM f GROUP BY family"""


def rules_sql(rules: list[tuple[str, str]], other: str) -> str:
    cases = [f"WHEN regexp_matches({probe}, '{pattern}') THEN '{name}'" for probe in ("base", "p") for pattern, name in rules]
    return f"CASE {' '.join(cases)} ELSE '{other}' END"


@query
def ground_classes(spark, sf_dir):
    """Class and role of texture paths: file name first, then the whole path."""
    p = art(spark, sf_dir).withColumn("p", scalar.plain_path(F.col("path"), "world art/"))
    base = scalar.base_name(F.col("p"))
    kind = F.when(F.col("p") == "", F.lit("(none)")).otherwise(scalar.first_match(scalar.GROUND_CLASSES, base, F.col("p")))
    return p.groupBy(kind.alias("class"), scalar.first_match(scalar.GROUND_ROLES, base, F.col("p")).alias("role"), scalar.motif(F.col("p")).alias("motif")).agg(F.count(F.lit(1)).alias("n"))


MOTIF_SQL = " ".join([f"WHEN starts_with(base, '{m}') THEN '{m.split(' ')[-1]}'" for m in scalar.MOTIFS] + [f"WHEN contains(base, '{m}') THEN '{m.split(' ')[-1]}'" for m in scalar.MOTIFS])
SQL["ground_classes"] = f"""
    WITH {ART},
    c AS (SELECT CASE WHEN p = '' THEN '(none)' ELSE {rules_sql(scalar.GROUND_CLASSES, "other")} END AS class, {rules_sql(scalar.GROUND_ROLES, "other")} AS role, CASE {MOTIF_SQL} ELSE '' END AS motif FROM named)
    SELECT class, role, motif, count(*) AS n FROM c GROUP BY ALL"""


@query
def excluded_names(spark, sf_dir):
    """Without ids of a list and names that hold one of some words."""
    p = art(spark, sf_dir).withColumn("plain", scalar.plain_path(F.col("path"), "world art/"))
    words = F.array(*[F.lit(w) for w in ("lava", "ice", "b2_")])
    gone = F.col("id").isin(3, 5, 8, 13, 21, 34) | F.exists(words, lambda w: F.contains(F.col("plain"), w))
    return p.filter(~gone).select("id", "plain")


SQL["excluded_names"] = f"WITH {ART} SELECT id, p AS plain FROM named WHERE id NOT IN (3, 5, 8, 13, 21, 34) AND NOT (contains(p, 'lava') OR contains(p, 'ice') OR contains(p, 'b2_'))"


# ---- spawns and predicates


def spawns(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    kinds = ["m", "ga", "g", "e", "r", "ma", "x", "S"]
    at = lambda a, b: (F.col("s_suppkey") * a % b).cast("int")
    return s.select(
        F.col("s_suppkey").alias("id"), F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("s_suppkey") % 8 + 1).cast("int")).alias("kind"),
        at(7, 70).alias("cx"), at(13, 70).alias("cy"), (at(3, 9) - 2).alias("sx"), (at(5, 7) - 2).alias("sy"), at(1, 11).alias("dir"),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit("90")).otherwise(F.concat(F.col("s_suppkey") % 4, F.lit("m"), F.col("s_suppkey") % 60, F.lit("s"))).alias("time"),
    )


SPAWN = """
    spawn AS (
        SELECT s_suppkey AS id, ['m', 'ga', 'g', 'e', 'r', 'ma', 'x', 'S'][s_suppkey % 8 + 1] AS kind, (s_suppkey * 7 % 70)::INTEGER AS cx, (s_suppkey * 13 % 70)::INTEGER AS cy,
               (s_suppkey * 3 % 9 - 2)::INTEGER AS sx, (s_suppkey * 5 % 7 - 2)::INTEGER AS sy, (s_suppkey % 11)::INTEGER AS dir,
               CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey % 4 * 60 + s_suppkey % 60 END AS seconds FROM supplier),
    typed AS (SELECT *, CASE lower(kind[1]) WHEN 'm' THEN 'MOB' WHEN 'g' THEN 'GROUP' WHEN 'e' THEN 'EXCEPTION' WHEN 'r' THEN 'GROUP_GROUP' WHEN 's' THEN 'ANYWHERE' ELSE 'INVALID' END AS type FROM spawn)"""


@query
def spawn_fields(spark, sf_dir):
    s = spawns(spark, sf_dir)
    aggressive = F.lower(F.substr("kind", F.lit(1), F.lit(2))) == "ga"
    rect = scalar.spawn_rect(*[F.col(c) for c in ("kind", "cx", "cy", "sx", "sy")], F.lit(25600), F.lit(51200))
    r = s.select("id", scalar.spawn_kind(F.col("kind")).alias("type"), aggressive.alias("aggressive"), ((F.col("sx") == 0) & (F.col("sy") == 0)).alias("point"), rect.alias("r"))
    return r.select("id", "type", "aggressive", "point", *spread("r", "x0", "y0", "x1", "y1"))


SQL["spawn_fields"] = f"""
    WITH {SPAWN},
    b AS (SELECT *, CASE WHEN type = 'EXCEPTION' THEN 0 ELSE 25600 END AS bx, CASE WHEN type = 'EXCEPTION' THEN 0 ELSE 51200 END AS oy FROM typed)
    SELECT id, type, lower(kind[1:2]) = 'ga' AS aggressive, sx = 0 AND sy = 0 AS point,
           least((cx - sx) * 100 + bx, (cx + sx) * 100 + bx)::INTEGER AS x0, least((cy - sy) * 100 + oy, (cy + sy) * 100 + oy)::INTEGER AS y0,
           greatest((cx - sx) * 100 + bx, (cx + sx) * 100 + bx)::INTEGER AS x1, greatest((cy - sy) * 100 + oy, (cy + sy) * 100 + oy)::INTEGER AS y1 FROM b"""


@query
def spawn_problems(spark, sf_dir):
    """What is wrong with spawn rows, one row a problem."""
    s = spawns(spark, sf_dir).withColumn("type", scalar.spawn_kind(F.col("kind")))
    real, point = F.col("type") != "EXCEPTION", (F.col("sx") == 0) & (F.col("sy") == 0)
    found = scalar.problems(
        (F.col("type") == "INVALID", "unknown type"),
        (real & (scalar.duration_seconds(F.col("time")) == 0), "time is zero"),
        (real & F.col("type").isin("GROUP", "GROUP_GROUP") & point, "group without extent"),
        (real & ~F.col("dir").between(0, 8), F.concat(F.lit("direction "), F.col("dir"))),
    )
    return s.select("id", F.posexplode(found).alias("at", "problem"))


SQL["spawn_problems"] = f"""
    WITH {SPAWN},
    f AS (
        SELECT id, list_filter([
            CASE WHEN type = 'INVALID' THEN 'unknown type' END, CASE WHEN type <> 'EXCEPTION' AND seconds = 0 THEN 'time is zero' END,
            CASE WHEN type IN ('GROUP', 'GROUP_GROUP') AND sx = 0 AND sy = 0 THEN 'group without extent' END,
            CASE WHEN type <> 'EXCEPTION' AND NOT dir BETWEEN 0 AND 8 THEN 'direction ' || dir END], lambda x: x IS NOT NULL) AS p FROM typed)
    SELECT id, (i - 1)::INTEGER AS at, p[i] AS problem FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM f)"""


@query
def setting_problems(spark, sf_dir):
    """Map settings against their rules: script type, cell scale, sizes, aligned origin."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 31 == 0, F.lit("Other")).otherwise(F.lit("MapSetting")).alias("script"), F.when(F.col("c_custkey") % 17 == 0, 100).otherwise(200).alias("scale"),
        (F.col("c_custkey") % 300).cast("int").alias("sx"), (F.col("c_custkey") % 7).cast("int").alias("sy"), (F.col("c_custkey") * 12800).alias("bx"), (F.col("c_custkey") * 51200).alias("by"),
    )
    checks = [(F.col("script") != "MapSetting", F.concat(F.lit("script type "), F.col("script"))), (F.col("scale") != 200, F.concat(F.lit("cell scale "), F.col("scale")))]
    checks += [(~F.col(c_).between(1, 256), F.concat(F.lit(f"size {c_[1]} "), F.col(c_))) for c_ in ("sx", "sy")]
    checks += [(F.col(c_) % 25600 != 0, F.lit(f"origin {c_[1]} not aligned")) for c_ in ("bx", "by")]
    return c.select("id", F.explode(scalar.problems(*checks)).alias("problem"))


SQL["setting_problems"] = """
    WITH c AS (
        SELECT c_custkey AS id, CASE WHEN c_custkey % 31 = 0 THEN 'Other' ELSE 'MapSetting' END AS script, CASE WHEN c_custkey % 17 = 0 THEN 100 ELSE 200 END AS scale,
               c_custkey % 300 AS sx, c_custkey % 7 AS sy, c_custkey * 12800 AS bx, c_custkey * 51200 AS oy FROM customer),
    p AS (
        SELECT id, unnest([CASE WHEN script <> 'MapSetting' THEN 'script type ' || script END, CASE WHEN scale <> 200 THEN 'cell scale ' || scale END,
            CASE WHEN NOT sx BETWEEN 1 AND 256 THEN 'size x ' || sx END, CASE WHEN NOT sy BETWEEN 1 AND 256 THEN 'size y ' || sy END,
            CASE WHEN bx % 25600 <> 0 THEN 'origin x not aligned' END, CASE WHEN oy % 25600 <> 0 THEN 'origin y not aligned' END]) AS problem FROM c)
    SELECT * FROM p WHERE problem IS NOT NULL"""


@query
def registry_last_wins(spark, sf_dir):
    """Of records with one id the one on the last path; of keys the first value."""
    from pyspark.sql import Window

    items = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("id"), F.concat(F.lit("p/"), F.col("l_suppkey"), F.lit("/"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("path"), F.col("l_quantity").cast("int").alias("value"))
    last = Window.partitionBy("id").orderBy(F.col("path").desc(), F.col("value").desc())
    first = Window.partitionBy("id").orderBy("path", "value")
    ranked = items.select("id", "path", "value", F.row_number().over(last).alias("back"), F.row_number().over(first).alias("front"))
    return ranked.groupBy("id").agg(F.max(F.when(F.col("back") == 1, F.col("path"))).alias("path"), F.max(F.when(F.col("back") == 1, F.col("value"))).alias("last_value"), F.max(F.when(F.col("front") == 1, F.col("value"))).alias("first_value"))


SQL["registry_last_wins"] = """
    WITH i AS (SELECT l_partkey % 50 AS id, 'p/' || l_suppkey || '/' || l_orderkey || '-' || l_linenumber AS path, l_quantity::INTEGER AS value FROM lineitem)
    SELECT id, max(path) AS path, arg_max(value, path || lpad(value::VARCHAR, 9, '0')) AS last_value, arg_min(value, path || lpad(value::VARCHAR, 9, '0')) AS first_value FROM i GROUP BY id"""


# ---- colours and frames


@query
def packed_colours(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[(F.col("p_partkey") * k % 256).cast("int").alias(c) for c, k in (("r", 7), ("g", 13), ("b", 29))])
    packed = p.withColumn("packed", scalar.rgb555(F.col("r"), F.col("g"), F.col("b"))).withColumn("back", scalar.channels555(F.col("packed")))
    return packed.select("id", "packed", F.col("back.r").alias("r"), F.col("back.g").alias("g"), F.col("back.b").alias("b"), F.round(scalar.luminance(F.col("r"), F.col("g"), F.col("b")), 6).alias("luminance"))


SQL["packed_colours"] = """
    WITH p AS (SELECT p_partkey AS id, (p_partkey * 7 % 256)::INTEGER AS r, (p_partkey * 13 % 256)::INTEGER AS g, (p_partkey * 29 % 256)::INTEGER AS b FROM part),
    q AS (SELECT *, r // 8 AS r5, g // 8 AS g5, b // 8 AS b5 FROM p)
    SELECT id, (r5 * 1024 + g5 * 32 + b5)::INTEGER AS packed, (r5 * 8 + r5 // 4)::INTEGER AS r, (g5 * 8 + g5 // 4)::INTEGER AS g, (b5 * 8 + b5 // 4)::INTEGER AS b,
           round(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 6) AS luminance FROM q"""


@query
def turned_frames(spark, sf_dir):
    """Offsets turned by their roll, and a smoothed share of the way."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (F.col("vec_id") % 360).cast("double").alias("roll"))
    t = p.select("id", scalar.rotated(F.col("x"), F.col("y"), F.col("roll")).alias("t"), scalar.smoothstep(F.col("x") * 4).alias("s"))
    return t.select("id", F.round("t.x", 7).alias("x"), F.round("t.y", 7).alias("y"), F.round("s", 7).alias("share"))


SQL["turned_frames"] = """
    WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, radians((vec_id % 360)::DOUBLE) AS a, greatest(0.0::DOUBLE, least(1.0::DOUBLE, embedding[1]::DOUBLE * 4)) AS u FROM embeddings)
    SELECT id, round(x * cos(a) + y * sin(a), 7) AS x, round(y * cos(a) - x * sin(a), 7) AS y, round(u * u * (3 - 2 * u), 7) AS share FROM p"""


@query
def layer_problems(spark, sf_dir):
    """Placement files, palettes, water layers and property records against their rules, a row a problem."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("declared"), (F.col("o_custkey") % 4).alias("blocks"), (F.col("o_orderkey") % 50 != 0).alias("headed"))
    area = scalar.problems((~F.col("headed"), "missing header key"), (F.col("declared") != F.col("blocks"), F.concat_ws(" ", F.lit("count"), "declared", F.lit("but"), "blocks")), (F.col("blocks") > F.col("declared"), F.concat_ws(" ", F.col("blocks") - F.col("declared"), F.lit("never loaded"))))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 300).alias("slots"), F.array_compact(F.array(*[F.when((F.col("c_custkey") + i) % 3 != 0, F.lit(i)) for i in range(1, 5)])).alias("filled"))
    empty = F.array_except(F.array(*[F.lit(i) for i in range(1, 5)]), F.col("filled"))
    palette = scalar.problems((F.size(empty) > 0, F.concat(F.lit("empty slots "), F.array_join(empty, ","))), (F.col("slots") > 254, F.concat_ws(" ", "slots", F.lit("above the usable slots"))))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).alias("layers"), F.array_distinct(F.array(F.col("s_suppkey") % 7, F.col("s_suppkey") % 3, F.lit(255))).alias("used"))
    dangling = F.filter("used", lambda v: (v != 255) & (v >= F.col("layers")))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(F.lit("Tree"), F.lit("Building"), F.lit("Effect"), F.lit("Odd")), (F.col("p_size") % 4 + 1).cast("int")).alias("kind"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("treefile"), F.lit("name"))).otherwise(F.array(F.lit("buildingfile"), F.lit("name"))).alias("keys"))
    needs = F.when(F.col("kind") == "Tree", "treefile").when(F.col("kind") == "Building", "buildingfile").otherwise("effectfile")
    lacks = (F.col("kind") != "Odd") & ~F.array_contains(F.col("keys"), needs)
    extra = F.array_except(F.col("keys"), F.array(F.lit("name"), needs))
    record = scalar.problems((F.col("kind") == "Odd", "unknown type Odd"), (lacks, F.concat(F.lit("missing key "), needs)), ((F.col("kind") != "Odd") & (F.size(extra) > 0), F.concat(F.lit("unexpected key "), F.array_join(extra, ","))))
    rows = lambda d, layer, found: d.select(F.lit(layer).alias("layer"), "id", F.explode(found).alias("problem"))
    return rows(o, "area", area).unionAll(rows(c, "palette", palette)).unionAll(rows(s, "water", F.transform(dangling, lambda v: F.concat_ws(" ", F.lit("value"), v, F.lit("of"), F.col("layers"))))).unionAll(rows(p, "property", record))


SQL["layer_problems"] = """
    WITH o AS (SELECT o_orderkey AS id, o_orderkey % 4 AS d, o_custkey % 4 AS b, o_orderkey % 50 <> 0 AS headed FROM orders),
    c AS (SELECT c_custkey AS id, c_custkey % 300 AS slots, list_filter([1, 2, 3, 4], lambda i: (c_custkey + i) % 3 = 0) AS empty FROM customer),
    s AS (SELECT s_suppkey AS id, s_suppkey % 5 AS layers, unnest(list_distinct([s_suppkey % 7, s_suppkey % 3])) AS v FROM supplier),
    p AS (SELECT p_partkey AS id, ['Tree', 'Building', 'Effect', 'Odd'][p_size % 4 + 1] AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'treefile' ELSE 'buildingfile' END AS has FROM part),
    q AS (SELECT *, CASE kind WHEN 'Tree' THEN 'treefile' WHEN 'Building' THEN 'buildingfile' ELSE 'effectfile' END AS needs FROM p)
    SELECT 'area' AS layer, id, 'missing header key' AS problem FROM o WHERE NOT headed
    UNION ALL SELECT 'area', id, 'count ' || d || ' but ' || b FROM o WHERE d <> b
    UNION ALL SELECT 'area', id, (b - d) || ' never loaded' FROM o WHERE b > d
    UNION ALL SELECT 'palette', id, 'empty slots ' || array_to_string(empty, ',') FROM c WHERE len(empty) > 0
    UNION ALL SELECT 'palette', id, slots || ' above the usable slots' FROM c WHERE slots > 254
    UNION ALL SELECT 'water', id, 'value ' || v || ' of ' || layers FROM s WHERE v >= layers
    UNION ALL SELECT 'property', id, 'unknown type Odd' FROM q WHERE kind = 'Odd'
    UNION ALL SELECT 'property', id, 'missing key ' || needs FROM q WHERE kind <> 'Odd' AND has <> needs
    UNION ALL SELECT 'property', id, 'unexpected key ' || has FROM q WHERE kind <> 'Odd' AND has <> needs"""
