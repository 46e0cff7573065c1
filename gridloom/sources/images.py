"""Image layers: block-compressed encoding with mip levels, and overview tiles with their ground."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from gridloom.sources.codecs import dxt_colours, read_dds, read_dxt

SECTOR_CM = 25_600


def write_dxt1(pixels: np.ndarray) -> bytes:
    """(height, width, 4) pixels as four-colour blocks; edges are repeated to whole blocks.

    The two end colours of a block are its darkest and brightest pixels, every pixel takes
    the nearest of the four; blocks with a clear pixel use the three-colour form.
    """
    h, w = pixels.shape[:2]
    full = np.pad(pixels, ((0, -h % 4), (0, -w % 4), (0, 0)), mode="edge").astype(np.int64)
    blocks = full.reshape(full.shape[0] // 4, 4, full.shape[1] // 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(-1, 16, 4)
    light = blocks[..., :3] @ np.array([299, 587, 114])
    ends = np.stack([np.take_along_axis(blocks[..., :3], f(light, 1)[:, None, None], 1)[:, 0] for f in (np.argmax, np.argmin)], 1)
    scale = np.array([31, 63, 31])
    packed = ((ends * scale + 127) // 255) @ np.array([1 << 11, 1 << 5, 1])
    clear = (blocks[..., 3] < 128).any(1)
    high, low = packed.max(1), packed.min(1)
    pair = np.where(clear[:, None], np.stack([low, high], 1), np.stack([high, low], 1)).astype("<u2")
    table = dxt_colours(pair, pair[:, 0] <= pair[:, 1]).astype(np.int64)
    far = ((blocks[:, :, None, :3] - table[:, None, :, :3]) ** 2).sum(-1)
    far[np.broadcast_to((table[:, None, :, 3] == 0), far.shape)] = 1 << 40  # the clear entry is for clear pixels
    index = np.where(blocks[..., 3] < 128, 3, far.argmin(-1)).astype(np.uint32)
    bits = (index << (2 * np.arange(16, dtype=np.uint32))).sum(1, dtype=np.uint32).astype("<u4")
    return np.concatenate([pair.view(np.uint8).reshape(-1, 4), bits.view(np.uint8).reshape(-1, 4)], 1).tobytes()


def halved(pixels: np.ndarray) -> np.ndarray:
    """The next mip level: means of 2 x 2, one pixel at least."""
    h, w = max(1, pixels.shape[0] // 2), max(1, pixels.shape[1] // 2)
    part = pixels[: max(1, 2 * h if pixels.shape[0] > 1 else 1), : max(1, 2 * w if pixels.shape[1] > 1 else 1)].astype(np.int64)
    return part.reshape(h, part.shape[0] // h, w, part.shape[1] // w, 4).mean((1, 3)).round().astype(np.uint8)


def levels(pixels: np.ndarray) -> list[np.ndarray]:
    """The image and all its mip levels down to one pixel."""
    out = [pixels]
    while max(out[-1].shape[:2]) > 1:
        out.append(halved(out[-1]))
    return out


def write_dds(pixels: np.ndarray, mips: bool = False) -> bytes:
    """A DXT1 container of an image, with its mip levels if wanted."""
    images = levels(pixels) if mips else [pixels]
    body = [write_dxt1(i) for i in images]
    flags = 0x1007 | 0x80000 | (0x20000 if mips else 0)
    head = struct.pack("<4s7I44x", b"DDS ", 124, flags, pixels.shape[0], pixels.shape[1], len(body[0]), 0, len(images) if mips else 0)
    form = struct.pack("<2I4s5I", 32, 4, b"DXT1", 0, 0, 0, 0, 0)
    caps = struct.pack("<5I", 0x1000 | (0x400008 if mips else 0), 0, 0, 0, 0)
    return head + form + caps + b"".join(body)


def read_levels(data: bytes) -> list[np.ndarray]:
    """All stored levels of a DXT1 container."""
    height, width = struct.unpack_from("<2I", data, 12)
    (count,) = struct.unpack_from("<I", data, 28)
    out, at = [], 128
    for _ in range(max(1, count)):
        out.append(read_dxt(data[at:], width, height, "DXT1"))
        at += -(-width // 4) * -(-height // 4) * 8
        width, height = max(1, width // 2), max(1, height // 2)
    return out


@dataclass
class Overview:
    """A sector's overview image and the ground it shows."""

    pixels: np.ndarray
    raw: bytes

    @classmethod
    def read(cls, data: bytes) -> Overview:
        return cls(read_dds(data), data)

    @staticmethod
    def bounds(sx: int, sy: int) -> tuple[int, int, int, int]:
        return sx * SECTOR_CM, sy * SECTOR_CM, (sx + 1) * SECTOR_CM, (sy + 1) * SECTOR_CM
