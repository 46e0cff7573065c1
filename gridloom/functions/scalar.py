"""Scalar expressions of the domain, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_int(c: Column) -> Column:
    """C-style atoi: leading space, sign and digits; anything else is 0."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))


def leading_float(c: Column) -> Column:
    """C-style atof: the longest numeric prefix, else 0."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def unsigned32(c: Column) -> Column:
    return c.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))


def duration_seconds(c: Column) -> Column:
    """'1h30m' -> 5400; digits without a unit do not count."""
    number = lambda unit: F.aggregate(
        F.regexp_extract_all(c, F.lit(rf"(\d+){unit}"), F.lit(1)), F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint")
    )
    return number("h") * 3600 + number("m") * 60 + number("s")


def duration_text(seconds: Column) -> Column:
    """5400 -> '1h30m'; zero parts are left out, zero itself is '0s'."""
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(seconds > 0, F.concat_ws("", part(h, "h"), part(m, "m"), part(s, "s"))).otherwise(F.lit("0s"))


def has_flag(attr: Column, mask: int) -> Column:
    return attr.bitwiseAND(mask) != 0


def set_flag(attr: Column, mask: int) -> Column:
    return attr.bitwiseOR(mask)


def clear_flag(attr: Column, mask: int) -> Column:
    return attr.bitwiseAND(255 - mask)


def share(n: Column, d: Column) -> Column:
    """n / d, and 0 where there is nothing to divide by."""
    return F.coalesce(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), F.lit(0.0))


def snap_residual(heading: Column, step: float) -> Column:
    """Distance of a heading to the nearest multiple of ``step``."""
    rest = F.pmod(heading, F.lit(step))
    return F.least(rest, F.lit(step) - rest)


def rotation(token: Column) -> Column:
    """'yaw#pitch#roll'; a bare number is the roll."""
    parts = F.split(token, "#")
    bare = F.size(parts) == 1
    at = lambda i: leading_float(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    return F.struct(
        F.when(bare, F.lit(0.0)).otherwise(at(0)).alias("yaw"),
        F.when(bare, F.lit(0.0)).otherwise(at(1)).alias("pitch"),
        F.when(bare, at(0)).otherwise(at(2)).alias("roll"),
    )


def sector_name(x: Column, y: Column) -> Column:
    return F.lpad((x * 1000 + y).cast("string"), 6, "0")


def first_match(rules: list[tuple[str, str]], *texts: Column, other: str = "other") -> Column:
    """The class of the first rule that fits; all rules on the first text, then the next."""
    out = F.lit(other)
    for text in reversed(texts):
        for pattern, name in reversed(rules):
            out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def stream_seed(salt: str, seed: Column) -> Column:
    """A stable seed of a named stream."""
    return F.crc32(F.concat(F.lit(f"{salt}/"), seed.cast("string")).cast("binary"))


def engine_rotation(token: Column) -> Column:
    """The rotation as the engine reads it: whole numbers, and yaw loses its last character."""
    cut = F.instr(token, "#")
    rest = F.substr(token, cut + F.lit(1))
    second = F.instr(rest, "#")
    yaw = leading_int(F.substr(token, F.lit(1), F.greatest(cut - 2, F.lit(0))))
    pitch = leading_int(F.when(second > 0, F.substr(rest, F.lit(1), second - F.lit(1))).otherwise(rest))
    roll = F.when(second > 0, leading_int(F.substr(rest, second + F.lit(1)))).otherwise(F.lit(0))
    bare, none = cut == 0, F.lit(0).cast("bigint")
    return F.struct(
        F.when(bare, none).otherwise(yaw).alias("yaw"), F.when(bare, none).otherwise(pitch).alias("pitch"), F.when(bare, leading_int(token)).otherwise(roll.cast("bigint")).alias("roll")
    )


def scaled_id(token: Column) -> Column:
    """'id#sx#sy#sz': the id as unsigned 32 bits and three scales, 1 where missing."""
    parts = F.split(token, "#")
    scale = lambda i: F.when(F.size(parts) > i, leading_float(F.get(parts, F.lit(i)))).otherwise(F.lit(1.0))
    return F.struct(unsigned32(leading_int(F.get(parts, F.lit(0)))).alias("id"), scale(1).alias("sx"), scale(2).alias("sy"), scale(3).alias("sz"))


def plain_path(path: Column, root: str) -> Column:
    """Lower case, forward slashes, no quotes or outer blanks, without what leads up to ``root``."""
    p = F.regexp_replace(F.trim(F.replace(F.lower(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))), '^"+|"+$', "")
    at = F.instr(p, root)
    return F.when(at > 0, F.substr(p, at + F.lit(len(root)))).otherwise(p)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def model_family(path: Column, kind: Column) -> Column:
    """The folder of a plain path; trees fall to their species prefix."""
    base = base_name(path)
    folder = F.when(F.instr(path, "/") > 0, F.substr(path, F.lit(1), F.length(path) - F.length(base) - 1)).otherwise(F.lit(""))
    prefix = F.regexp_extract(base, "^([a-z]+[0-9]*)_", 1)
    tree = F.concat(F.lit("tree/"), F.when(prefix != "", prefix).otherwise(F.lit("other")))
    return F.when(path == "", F.lit("(no model)")).when((kind == "Tree") | (folder == "tree"), tree).otherwise(F.when(folder == "", F.lit("(root)")).otherwise(folder))


# Rules of ground textures in their order of precedence.
GROUND_CLASSES = [
    ("beach ?water|river|/water", "water"),
    ("lava|magma", "lava"),
    ("tile|grasstile", "tile"),
    ("snow|ice_|/ice", "snow"),
    ("sand|beach|blacksand", "sand"),
    ("stone|rock|cliff|crack|valcano|volcano", "rock"),
    ("grass|seagrass", "grass"),
    ("field|feild", "field"),
]
GROUND_ROLES = [
    ("tile|stone_tile|12t_stone_tile|temple_stone", "paved"),
    ("field|feild", "dirt"),
    ("sand|beach|blacksand", "sand"),
    ("grass|seagrass", "grass"),
    ("stone|rock|cliff", "rock"),
    ("snow|ice", "snow"),
    ("valcano|volcano|lava|magma|crack", "lava"),
    ("water|river", "water"),
    ("black", "void"),
]
MOTIFS = ("beach sand", "sand", "field", "grass", "stone", "cliff", "rock", "tile", "snow", "valcano", "lava", "ice", "water", "dirt")


def motif(path: Column) -> Column:
    """The art word that a file name begins with, else the first one it contains, else ''."""
    base = base_name(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))
    out = F.lit("")
    for word in reversed(MOTIFS):
        out = F.when(F.contains(base, F.lit(word)), F.lit(word.split(" ")[-1])).otherwise(out)
    for word in reversed(MOTIFS):
        out = F.when(base.startswith(word), F.lit(word.split(" ")[-1])).otherwise(out)
    return out


# Spawn row types by their first letter.
SPAWN_KINDS = {"m": "MOB", "g": "GROUP", "e": "EXCEPTION", "r": "GROUP_GROUP", "s": "ANYWHERE"}


def spawn_kind(kind: Column) -> Column:
    first = F.lower(F.substr(kind, F.lit(1), F.lit(1)))
    out = F.lit("INVALID")
    for letter, name in SPAWN_KINDS.items():
        out = F.when(first == letter, F.lit(name)).otherwise(out)
    return out


def spawn_rect(kind: Column, cx: Column, cy: Column, sx: Column, sy: Column, base_x: Column, base_y: Column) -> Column:
    """Corners in world centimetres, low before high; exception rows ignore the base."""
    free = spawn_kind(kind) == "EXCEPTION"
    bx, by = F.when(free, F.lit(0)).otherwise(base_x), F.when(free, F.lit(0)).otherwise(base_y)
    a, b, c, d = (cx - sx) * 100 + bx, (cy - sy) * 100 + by, (cx + sx) * 100 + bx, (cy + sy) * 100 + by
    return F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))


def problems(*checks: tuple[Column, Column | str]) -> Column:
    """The texts of the checks that hold, in order."""
    return F.filter(F.array(*[F.when(test, F.lit(text) if isinstance(text, str) else text) for test, text in checks]), lambda x: x.isNotNull())


def rgb555(r: Column, g: Column, b: Column) -> Column:
    """Eight-bit channels packed into 15 bits, red highest."""
    five = lambda c: F.shiftright(c, 3)
    return F.shiftleft(five(r), 10).bitwiseOR(F.shiftleft(five(g), 5)).bitwiseOR(five(b))


def channels555(packed: Column) -> Column:
    """15 bits back to eight-bit channels; the top bits fill the low ones."""
    wide = lambda c: F.shiftleft(c, 3).bitwiseOR(F.shiftright(c, 2))
    at = lambda n: wide(F.shiftright(packed, n).bitwiseAND(31))
    return F.struct(at(10).alias("r"), at(5).alias("g"), at(0).alias("b"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def rotated(x: Column, y: Column, roll: Column) -> Column:
    """(x, y) turned by ``roll`` degrees, with y growing south."""
    a = F.radians(roll)
    return F.struct((x * F.cos(a) + y * F.sin(a)).alias("x"), (y * F.cos(a) - x * F.sin(a)).alias("y"))


def smoothstep(t: Column) -> Column:
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return u * u * (3 - 2 * u)
