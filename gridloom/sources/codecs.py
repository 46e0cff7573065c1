"""Decoders and encoders of the binary and text layers of a world folder.

Every layer is a pair of functions bytes -> value and value -> bytes; grids are numpy
arrays. Encoding what was decoded gives the same bytes. Sizes, magic numbers and field
orders are fixed by the file formats.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the formats.
HEIGHT_SIDE = 131
TILE_SIDE = 258
ATTR_MAGIC, ATTR_SIDE = 2634, 256
WATER_MAGIC, WATER_SIDE, DRY = 5426, 128, 0xFF
SHADOW_SIDE = 256
SERVER_SIDE = 128


@dataclass
class Grid:
    """A raster layer; ``tail`` is what follows the grid in the file, kept as it is."""

    values: np.ndarray
    tail: bytes = b""


@dataclass
class Water:
    cells: np.ndarray
    heights: list[int]
    short: bool = False


def plain(data: bytes, side: int, dtype: str, what: str) -> Grid:
    size = side * side * np.dtype(dtype).itemsize
    if len(data) < size:
        raise ValueError(f"{what}: {len(data)} bytes, {size} needed")
    return Grid(np.frombuffer(data[:size], dtype).reshape(side, side).copy(), data[size:])


def read_height(data: bytes) -> Grid:
    return plain(data, HEIGHT_SIDE, "<u2", "height")


def read_tile(data: bytes) -> Grid:
    return plain(data, TILE_SIDE, "u1", "tile")


def read_shadow(data: bytes) -> Grid:
    return plain(data, SHADOW_SIDE, "<u2", "shadow")


def write_plain(grid: Grid) -> bytes:
    return grid.values.tobytes() + grid.tail


def read_attr(data: bytes) -> Grid:
    if struct.unpack_from("<3H", data) != (ATTR_MAGIC, ATTR_SIDE, ATTR_SIDE):
        raise ValueError("attribute header")
    return plain(data[6:], ATTR_SIDE, "u1", "attribute")


def write_attr(grid: Grid) -> bytes:
    return struct.pack("<3H", ATTR_MAGIC, ATTR_SIDE, ATTR_SIDE) + write_plain(grid)


def read_water(data: bytes) -> Water:
    magic, w, h, layers = struct.unpack_from("<3HB", data)
    if (magic, w, h) != (WATER_MAGIC, WATER_SIDE, WATER_SIDE):
        raise ValueError("water header")
    body = 7 + WATER_SIDE * WATER_SIDE
    kinds = {4 * layers: "<i4", 2 * layers: "<u2"}
    if (dtype := kinds.get(len(data) - body)) is None:
        raise ValueError(f"water: {len(data) - body} bytes for {layers} layers")
    cells = np.frombuffer(data[7:body], "u1").reshape(WATER_SIDE, WATER_SIDE).copy()
    return Water(cells, np.frombuffer(data[body:], dtype).astype(int).tolist(), dtype == "<u2" and layers > 0)


def write_water(water: Water) -> bytes:
    head = struct.pack("<3HB", WATER_MAGIC, WATER_SIDE, WATER_SIDE, len(water.heights))
    return head + water.cells.astype("u1").tobytes() + np.array(water.heights, "<u2" if water.short else "<i4").tobytes()


class Lzo:
    """The LZO1X stream: literals and four kinds of back references."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.out = data, 0, bytearray()

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise ValueError("LZO stream ends early")
        self.at += 1
        return self.data[self.at - 1]

    def count(self, low: int, bits: int) -> int:
        """A length whose low bits are 0 goes on in further bytes."""
        if low:
            return low
        total = (1 << bits) - 1
        while not (b := self.byte()):
            total += 255
        return total + b

    def literal(self, n: int) -> None:
        if self.at + n > len(self.data):
            raise ValueError("LZO literals end early")
        self.out += self.data[self.at : self.at + n]
        self.at += n

    def match(self, distance: int, n: int) -> None:
        start = len(self.out) - distance
        if start < 0:
            raise ValueError("LZO distance before the start")
        chunk = bytes(self.out[start : start + min(n, distance)])
        self.out += (chunk * (n // len(chunk) + 1))[:n]

    def run(self) -> bytes:
        trailing = 0  # literals after the last operation: 0..3, 4 stands for a long run
        if self.data and self.data[0] > 17:
            n = self.byte() - 17
            self.literal(n)
            trailing = min(n, 4)
        while True:
            op = self.byte()
            if op < 16 and trailing == 0:
                self.literal(3 + self.count(op, 4))
                trailing = 4
                continue
            if op < 16:
                high = self.byte() << 2
                if trailing == 4:
                    self.match(2049 + (op >> 2) + high, 3)
                else:
                    self.match(1 + (op >> 2) + high, 2)
                trailing = op & 3
            elif op >= 64:
                self.match(1 + (op >> 2 & 7) + (self.byte() << 3), (op >> 5) + 1)
                trailing = op & 3
            else:
                near = op >= 32
                n = 2 + (self.count(op & 31, 5) if near else self.count(op & 7, 3))
                low = self.byte()
                far = (low >> 2) + (self.byte() << 6) + (0 if near else (op & 8) << 11)
                if not near and far == 0:
                    return bytes(self.out)
                self.match(far + (1 if near else 16384), n)
                trailing = low & 3
            self.literal(trailing)


def lzo_decompress(data: bytes, size: int | None = None) -> bytes:
    out = Lzo(data).run()
    if size is not None and len(out) != size:
        raise ValueError(f"LZO gave {len(out)} bytes, {size} expected")
    return out


def long_count(n: int, bits: int) -> tuple[int, bytes]:
    """(low bits, further bytes) of a length."""
    most = (1 << bits) - 1
    if n <= most:
        return n, b""
    full, rest = divmod(n - most - 1, 255)
    return 0, b"\0" * full + bytes([rest + 1])


def lzo_compress(data: bytes) -> bytes:
    """A valid stream of literal runs and references of up to 49,151 bytes back."""
    out, seen, at, pending = bytearray(), {}, 0, 0

    def literals(end: int) -> None:
        n = end - pending
        if not n:
            return
        if not out:
            if n < 239:
                out.append(17 + n)
            else:
                low, more = long_count(n - 3, 4)
                out.append(low)
                out.extend(more)
        elif n < 4:
            out[-2] |= n
        else:
            low, more = long_count(n - 3, 4)
            out.append(low)
            out.extend(more)
        out.extend(data[pending:end])

    while at + 4 <= len(data):
        key = data[at : at + 4]
        back = seen.get(key)
        seen[key] = at
        if back is None or not 0 < at - back <= 49_151 or at == 0:
            at += 1
            continue
        n = 4
        while at + n < len(data) and data[back + n] == data[at + n]:
            n += 1
        literals(at)
        distance = at - back
        if distance <= 16_384:
            low, more = long_count(n - 2, 5)
            out.append(32 | low)
            distance -= 1
        else:
            distance -= 16_384
            low, more = long_count(n - 2, 3)
            out.append(16 | (distance >> 11 & 8) | low)
        out.extend(more)
        out.extend([(distance & 63) << 2, distance >> 6 & 255])
        at += n
        pending = at
    literals(len(data))
    return bytes(out) + b"\x11\0\0"


def read_server_attr(data: bytes) -> tuple[int, int, list[np.ndarray]]:
    """(columns, rows, blocks): 128 x 128 unsigned cells a block, row-major."""
    w, h = struct.unpack_from("<2i", data)
    at, blocks = 8, []
    for _ in range(w * h):
        (size,) = struct.unpack_from("<I", data, at)
        cells = lzo_decompress(data[at + 4 : at + 4 + size], SERVER_SIDE * SERVER_SIDE * 4)
        blocks.append(np.frombuffer(cells, "<u4").reshape(SERVER_SIDE, SERVER_SIDE))
        at += 4 + size
    return w, h, blocks


def write_server_attr(w: int, h: int, blocks: list[np.ndarray]) -> bytes:
    packed = [lzo_compress(np.asarray(b, "<u4").tobytes()) for b in blocks]
    return struct.pack("<2i", w, h) + b"".join(struct.pack("<I", len(p)) + p for p in packed)


def dxt_colours(pair: np.ndarray, three: np.ndarray) -> np.ndarray:
    """(blocks, 4, 4) palettes of two 565 colours; ``three``: third is the middle, last clear."""
    v = pair.astype(np.int32)
    rgb = np.stack([(v >> 11 & 31) * 255 // 31, (v >> 5 & 63) * 255 // 63, (v & 31) * 255 // 31], -1)
    a, b = rgb[:, 0], rgb[:, 1]
    two = np.where(three[:, None], (a + b) // 2, (2 * a + b) // 3)
    last = np.where(three[:, None], 0, (a + 2 * b) // 3)
    palette = np.stack([a, b, two, last], 1)
    alpha = np.full(palette.shape[:2], 255)
    alpha[three, 3] = 0
    return np.concatenate([palette, alpha[..., None]], -1).astype(np.uint8)


def read_dxt(data: bytes, width: int, height: int, kind: str) -> np.ndarray:
    """DXT1 to DXT5 blocks as (height, width, 4) pixels."""
    across, down = -(-width // 4), -(-height // 4)
    step = 8 if kind == "DXT1" else 16
    raw = np.frombuffer(data[: across * down * step], np.uint8).reshape(-1, step)
    colour = raw[:, -8:]
    pair = colour[:, :4].copy().view("<u2")
    three = (pair[:, 0] <= pair[:, 1]) & (kind == "DXT1")
    bits = colour[:, 4:].copy().view("<u4")
    index = (bits >> (2 * np.arange(16, dtype=np.uint32))) & 3
    pixels = np.take_along_axis(dxt_colours(pair, three), index[..., None].astype(np.int64), 1)
    if kind in ("DXT2", "DXT3"):
        four = raw[:, :8].copy().view("<u8")
        pixels[..., 3] = ((four >> (4 * np.arange(16, dtype=np.uint64))) & 15) * 17
    elif kind in ("DXT4", "DXT5"):
        a, b = raw[:, 0].astype(int), raw[:, 1].astype(int)
        steps = np.arange(1, 7)
        eight = (a[:, None] * (7 - steps) + b[:, None] * steps) // 7
        six = np.concatenate([(a[:, None] * (5 - steps[:4]) + b[:, None] * steps[:4]) // 5, np.zeros((len(a), 1), int), np.full((len(a), 1), 255)], 1)
        table = np.concatenate([a[:, None], b[:, None], np.where((a > b)[:, None], eight, six)], 1)
        packed = np.concatenate([raw[:, 2:8], np.zeros((len(raw), 2), np.uint8)], 1).copy().view("<u8")
        at = (packed >> (3 * np.arange(16, dtype=np.uint64))) & 7
        pixels[..., 3] = np.take_along_axis(table, at.astype(np.int64), 1)
    image = pixels.reshape(down, across, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(down * 4, across * 4, 4)
    return image[:height, :width]


def read_dds(data: bytes) -> np.ndarray:
    """The first image of a DDS container as (height, width, 4) RGBA pixels."""
    if data[:4] != b"DDS ":
        raise ValueError("DDS magic")
    height, width = struct.unpack_from("<2I", data, 12)
    flags, code, bits, *masks = struct.unpack_from("<I4sI4I", data, 80)
    if flags & 4:
        return read_dxt(data[128:], width, height, code.decode())
    size = bits // 8
    raw = np.zeros((height * width, 4), np.uint8)
    raw[:, :size] = np.frombuffer(data[128 : 128 + height * width * size], np.uint8).reshape(-1, size)
    value = raw.view("<u4")[:, 0]
    planes = []
    for mask in masks:
        if not mask:
            planes.append(np.full(len(value), 255, np.uint8))
            continue
        shift = (mask & -mask).bit_length() - 1
        most = mask >> shift
        planes.append((((value & mask) >> shift).astype(np.int64) * 255 // most).astype(np.uint8))
    return np.stack(planes, -1).reshape(height, width, 4)


def rgb555(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int32)
    return np.stack([(v >> s & 31) * 255 // 31 for s in (10, 5, 0)], -1).astype(np.uint8)


# Text layers.

TOKEN = re.compile(r'"([^"]*)"|(\S+)')


def tokens(line: str) -> list[str]:
    """White-space separated words; a quoted one may hold white space."""
    return [quoted or word for quoted, word in TOKEN.findall(line)]


def decoded(data: bytes) -> str:
    return data.decode("cp949", "replace")


@dataclass
class Script:
    """A flat text: keys (first one wins) and Start ... End blocks of flattened tokens."""

    keys: dict[str, list[str]] = field(default_factory=dict)
    blocks: dict[str, list[str]] = field(default_factory=dict)


def read_script(data: bytes) -> Script:
    out, block = Script(), None
    for line in decoded(data).splitlines():
        words = tokens(line)
        if not words or words[0].startswith("//"):
            continue
        key = words[0].lower()
        if block is None and key == "start" and len(words) > 1:
            block, held = words[1].lower(), []
        elif block is not None and key == "end":
            out.blocks.setdefault(block, held)
            block = None
        elif block is not None:
            held += words
        else:
            out.keys.setdefault(key, words[1:])
    return out


def leading(text: str, kind: type = float):
    """The longest numeric prefix, else 0."""
    m = re.match(r"\s*[+-]?\d+" if kind is int else r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", text)
    return kind(m[0]) if m else kind(0)


def read_placements(data: bytes) -> list[dict]:
    """Object records: 4 tokens are place and id; rotation, bias and portals may follow."""
    script, out = read_script(data), []
    for i in range(leading((script.keys.get("objectcount") or ["0"])[0], int)):
        t = script.blocks.get(f"object{i:03d}")
        if t is None:
            continue
        if len(t) < 4:
            raise ValueError(f"object {i}: {len(t)} tokens")
        crc, *scale = t[3].split("#")
        turn = t[4].split("#") if len(t) > 4 else []
        yaw, pitch, roll = ("0", "0", turn[0]) if len(turn) == 1 else (*turn, "0", "0", "0")[:3]
        out.append({
            "ordinal": i, "x": leading(t[0]), "y": leading(t[1]), "z": leading(t[2]), "crc": leading(crc, int) & 0xFFFFFFFF,
            "yaw": leading(yaw), "pitch": leading(pitch), "roll": leading(roll), "bias": leading(t[5]) if len(t) > 5 else 0.0,
            "portals": [leading(p, int) for p in t[6:]], "scale": ([leading(s) for s in scale] + [1.0] * 3)[:3],
        })
    return out


def write_placements(records: list[dict]) -> bytes:
    lines = ["AreaDataFile", ""]
    for i, r in enumerate(records):
        scaled = any(s != 1.0 for s in r["scale"])
        lines += [
            f"Start Object{i:03d}", f"    {r['x']:f} {r['y']:f} {r['z']:f}",
            f"    {r['crc']}" + "".join(f"#{s:f}" for s in r["scale"]) * scaled,
            f"    {r['yaw']:f}#{r['pitch']:f}#{r['roll']:f}", f"    {r['bias']:f}", *(f"    {p}" for p in r["portals"]), "End Object",
        ]
    return "\r\n".join([*lines, "", f"ObjectCount {len(records)}", ""]).encode("cp949")


def read_palette(data: bytes) -> list[dict]:
    """Texture slots from 1; slot 0 is the eraser, gaps are left out."""
    script, out = read_script(data), []
    for slot in range(1, leading((script.keys.get("texturecount") or ["0"])[0], int) + 1):
        t = script.blocks.get(f"texture{slot:03d}")
        if t is not None and len(t) >= 8:
            out.append({"slot": slot, "path": t[0], "u": leading(t[1]), "v": leading(t[2])})
    return out


def read_setting(data: bytes) -> dict:
    keys = read_script(data).keys
    number = lambda k, i, d: leading((keys.get(k) or [])[i], int) if len(keys.get(k) or []) > i else d
    known = {"scripttype", "cellscale", "heightscale", "viewradius", "mapsize", "baseposition", "textureset", "environment", "terrainvisible"}
    return {
        "cell_scale": number("cellscale", 0, 200), "height_scale": leading((keys.get("heightscale") or ["0.5"])[0]), "size": [number("mapsize", i, 1) for i in (0, 1)],
        "base": [number("baseposition", i, 0) for i in (0, 1)], "texture_set": (keys.get("textureset") or [""])[0], "environment": (keys.get("environment") or [""])[0],
        "extras": {k: v for k, v in keys.items() if k not in known},
    }


def read_property(data: bytes) -> dict:
    """A property file: its id on the first line, then key and values, first one wins."""
    if data[:6] != b"YPRT\r\n":
        raise ValueError("property magic")
    first, *lines = decoded(data[6:]).splitlines()
    rows: dict[str, list[str]] = {}
    for words in map(tokens, lines):
        if len(words) > 1:
            rows.setdefault(words[0].lower(), words[1:])
    return {"crc": leading(first, int) & 0xFFFFFFFF, "values": rows}


def read_spawns(data: bytes) -> list[dict]:
    """Spawn rows of eleven words wherever lines break; type e ends after six."""
    words = []
    for line in decoded(data).splitlines():
        for quoted, word in TOKEN.findall(line):
            if word.startswith("//"):
                break
            words.append(quoted or word)
    out, at = [], 0
    while at < len(words):
        n = 6 if words[at].startswith("e") else 11
        row = words[at : at + n]
        if len(row) < n:
            break
        numbers = [leading(w, int) for w in row[1:6]]
        out.append({
            "type": row[0], **dict(zip(("cx", "cy", "sx", "sy", "z"), numbers, strict=True)),
            "dir": leading(row[6], int) if n > 6 else None, "time": row[7] if n > 6 else None, "percent": leading(row[8], int) if n > 6 else None,
            "count": leading(row[9], int) if n > 6 else None, "vnum": leading(row[10], int) if n > 6 else None,
        })
        at += n
    return out
