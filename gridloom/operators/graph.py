"""Per-map grid kernels for what is iterative by nature, one group per map.

A map's dense grid fits in one task (about 3 MB a byte layer for the largest world), so
these run as grouped pandas functions; relational operators never come here.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def dense(group: pd.DataFrame, name: str) -> np.ndarray:
    """The grid [gy, gx] of one column."""
    out = np.zeros((group["gy"].max() + 1, group["gx"].max() + 1), group[name].dtype)
    out[group["gy"], group["gx"]] = group[name]
    return out


def per_map(cell: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return cell.groupBy("map").applyInPandas(kernel, schema)


def labels(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Components of a mask, numbered by their smallest position + 1; runs and union-find."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    y, a = np.nonzero(change == 1)
    _, b = np.nonzero(change == -1)
    up = np.arange(len(y))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    reach = 1 if diagonal else 0
    starts = np.searchsorted(y, np.arange(h + 1))
    for row in range(1, h):
        i, j = starts[row - 1], starts[row]
        while i < starts[row] and j < starts[row + 1]:
            if a[i] < b[j] + reach and a[j] < b[i] + reach:
                r, s = root(i), root(j)
                up[max(r, s)] = min(r, s)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), np.int64)
    for i in range(len(y)):
        out[y[i], a[i] : b[i]] = root(i) + 1
    return out


def component_table(group: pd.DataFrame, flag: str, diagonal: bool = False) -> pd.DataFrame:
    """(map, gx, gy, component): the component's number is its first position gy * w + gx."""
    grid = labels(dense(group, flag), diagonal)
    y, x = np.nonzero(grid)
    table = pd.DataFrame({"map": group["map"].iloc[0], "gx": x, "gy": y, "label": grid[y, x]})
    table["component"] = (table["gy"] * grid.shape[1] + table["gx"]).groupby(table["label"]).transform("min")
    return table[["map", "gx", "gy", "component"]].astype({"gx": "int32", "gy": "int32", "component": "int64"})


def components(cell: DataFrame, flag: str, diagonal: bool = False) -> DataFrame:
    return per_map(cell, lambda g: component_table(g, flag, diagonal), "map string, gx int, gy int, component long")


def chamfer(mask: np.ndarray) -> np.ndarray:
    """5 x 5 chamfer distance (1, sqrt 2, sqrt 5) to the nearest set position."""
    h, w = mask.shape
    d = np.full((h + 4, w + 4), np.inf)
    d[2:-2, 2:-2] = np.where(mask, 0.0, np.inf)
    at = np.arange(w + 4, dtype=float)
    above = [(1, 0, 1.0), (1, -1, 2**0.5), (1, 1, 2**0.5), (2, -1, 5**0.5), (2, 1, 5**0.5), (1, -2, 5**0.5), (1, 2, 5**0.5)]
    for turned in (d, d[::-1, ::-1]):  # a pass down and to the east, one up and to the west
        for y in range(2, h + 2):
            row = turned[y]
            for dy, dx, cost in above:
                row[2:-2] = np.minimum(row[2:-2], turned[y - dy, 2 + dx : w + 2 + dx] + cost)
            run = np.minimum.accumulate(row - at) + at  # steps along the row
            row[2:-2] = np.minimum(row[2:-2], run[2:-2])
    return d[2:-2, 2:-2]


def thinned(mask: np.ndarray) -> np.ndarray:
    """A one-position wide skeleton by two alternating sub-iterations to a fixed point."""
    m = np.pad(mask.astype(np.uint8), 1)
    ring = [(0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0), (0, 0)]
    while True:
        before = m.copy()
        for first in (True, False):
            h, w = m.shape
            p = [m[dy : h - 2 + dy, dx : w - 2 + dx] for dy, dx in ring]
            n = sum(p)
            turns = sum((p[i] == 0) & (p[(i + 1) % 8] == 1) for i in range(8))
            north, east, south, west = p[0], p[2], p[4], p[6]
            sides = (north * east * south == 0) & (east * south * west == 0) if first else (north * east * west == 0) & (north * south * west == 0)
            m[1:-1, 1:-1][(m[1:-1, 1:-1] == 1) & (n >= 2) & (n <= 6) & (turns == 1) & sides] = 0
        if (m == before).all():
            return m[1:-1, 1:-1].astype(bool)


def quadratic_form(z: np.ndarray) -> dict:
    """Least-squares quadratic over [-1, 1]^2 and the class of its Hessian."""
    y, x = np.meshgrid(*(np.linspace(-1, 1, n) for n in z.shape), indexing="ij")
    basis = np.stack([np.ones_like(x), x, y, x * x, x * y, y * y], -1).reshape(-1, 6)
    c = np.linalg.lstsq(basis, z.reshape(-1).astype(float), rcond=None)[0]
    low, high = np.linalg.eigvalsh([[2 * c[3], c[4]], [c[4], 2 * c[5]]])
    flat = 1e-3 * max(1.0, float(z.std()))
    kind = (
        "planar" if max(abs(low), abs(high)) < flat
        else "basin" if low > flat else "dome" if high < -flat
        else "saddle" if low < -flat and high > flat else "trough" if high > flat else "ridge"
    )
    return {"low": float(low), "high": float(high), "form": kind}


def radial_power(z: np.ndarray, bands: int = 4) -> np.ndarray:
    """Shares of spectral power in equal bands of radial frequency, plane removed."""
    h, w = z.shape
    y, x = np.meshgrid(np.linspace(-1, 1, h), np.linspace(-1, 1, w), indexing="ij")
    basis = np.stack([np.ones_like(x), x, y], -1).reshape(-1, 3)
    flat = z.reshape(-1) - basis @ np.linalg.lstsq(basis, z.reshape(-1).astype(float), rcond=None)[0]
    power = np.abs(np.fft.fft2(flat.reshape(h, w))) ** 2
    r = np.hypot(*np.meshgrid(np.fft.fftfreq(h), np.fft.fftfreq(w), indexing="ij"))
    band = np.minimum((r / 0.5 * bands).astype(int), bands - 1)
    power[0, 0] = 0
    return np.bincount(band.ravel(), power.ravel(), bands) / max(power.sum(), 1e-12)


def route(cost: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> tuple[float, list[tuple[int, int]]]:
    """Cheapest 8-connected path; a step costs the entered position's cost times its length."""
    best, came, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        d, at = heapq.heappop(heap)
        if at == goal:
            break
        if d > best[at]:
            continue
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                y, x = at[0] + dy, at[1] + dx
                if (dy or dx) and 0 <= y < cost.shape[0] and 0 <= x < cost.shape[1]:
                    new = d + float(cost[y, x]) * (2**0.5 if dy and dx else 1.0)
                    if new < best.get((y, x), np.inf):
                        best[y, x], came[y, x] = new, at
                        heapq.heappush(heap, (new, (y, x)))
    path = [goal]
    while path[-1] in came:
        path.append(came[path[-1]])
    return best.get(goal, np.inf), path[::-1]


def value_noise(shape: tuple[int, int], seed: int, octaves: int = 4, ridged: bool = False) -> np.ndarray:
    """Fractal value noise in 0..1; the same for a seed wherever it runs."""
    rng, total, out, weight = np.random.default_rng(seed), 0.0, np.zeros(shape), 1.0
    for o in range(octaves):
        n = 2 ** (o + 2)
        lattice = rng.random((n + 2, n + 2))
        ys, xs = np.linspace(0, n, shape[0]), np.linspace(0, n, shape[1])
        y0, x0 = ys.astype(int), xs.astype(int)
        fy, fx = (f * f * (3 - 2 * f) for f in (ys - y0, xs - x0))
        top = lattice[y0][:, x0] * (1 - fx) + lattice[y0][:, x0 + 1] * fx
        low = lattice[y0 + 1][:, x0] * (1 - fx) + lattice[y0 + 1][:, x0 + 1] * fx
        layer = top * (1 - fy)[:, None] + low * fy[:, None]
        out += weight * (1 - np.abs(2 * layer - 1) if ridged else layer)
        total, weight = total + weight, weight / 2
    return out / total


def scatter(mask: np.ndarray, spacing: float, seed: int) -> np.ndarray:
    """Positions (y, x) on the mask no closer than ``spacing``, in a seeded order."""
    free = np.argwhere(mask)
    order = np.random.default_rng(seed).permutation(len(free))
    taken: dict[tuple[int, int], list] = {}
    out = []
    for y, x in free[order]:
        by, bx = int(y // spacing), int(x // spacing)
        near = (p for dy in (-1, 0, 1) for dx in (-1, 0, 1) for p in taken.get((by + dy, bx + dx), ()))
        if all((p[0] - y) ** 2 + (p[1] - x) ** 2 >= spacing * spacing for p in near):
            taken.setdefault((by, bx), []).append((y, x))
            out.append((int(y), int(x)))
    return np.array(out, int).reshape(-1, 2)
