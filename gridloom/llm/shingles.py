"""Word shingles of whole texts as 64-bit hashes, vectorised over batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers of the polynomial word hash, its inverse modulo 2^64, and the places.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def byte_values(fold: bool) -> np.ndarray:
    """Byte values spread over 64 bits; ``fold`` reads A-Z as a-z."""
    return np.array([pow(0xD1342543DE82EF95, 3 + (b + 32 if fold and 65 <= b <= 90 else b), (1 << 64) - 59) | 1 for b in range(256)], np.uint64)


VALUES = byte_values(fold=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, n.bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of the bytes; the first byte must be white space."""
    space = IS_SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not space[-1]:
        ends = np.append(ends, len(data))
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(VALUES[data] * up[: len(data)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None], width: int = 5, most_bytes: int = 1_000_000) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; empty without words.

    Texts with fewer than ``width`` words have one shingle, the whole sequence.
    """
    at = 0
    while at < len(texts):
        raw: list[bytes] = []
        held = 0
        while at < len(texts) and (not raw or held < most_bytes):
            raw.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            held += len(raw[-1]) + 1
            at += 1
        data = np.frombuffer(b" " + b" ".join(raw), np.uint8)
        starts, words = word_hashes(data)
        begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
        cuts = np.searchsorted(starts, begins)
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
            for j in range(width):
                rolled += words[j : j + len(rolled)] * PLACES[j % len(PLACES)] * np.uint64(1 + 2 * (j // len(PLACES)))
            rolled = mix(rolled)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a >= width:
                    yield np.unique(rolled[a : b - width + 1])
                elif b > a:
                    few = words[a:b] * PLACES[: b - a]
                    yield mix(few.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
                else:
                    yield np.empty(0, np.uint64)
