"""Hashes of spans of token arrays, in time that does not depend on their length."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import zstandard

CHUNK = 1 << 19  # tokens hashed at once
BASE = 0x9E3779B97F4A7C15

Hashes = np.ndarray


def mix(x: Hashes) -> Hashes:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(1)
def powers(room: int) -> tuple[Hashes, Hashes]:
    """The powers of BASE and of its inverse; room: how many."""
    out = []
    for b in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(room, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Rolling:
    """Hashes of any spans of a token array: sums of token times power, taken back to the span's start."""

    def __init__(self, tokens: Hashes):
        power, self.back = powers(max(CHUNK + 4096, 1 << len(tokens).bit_length()))
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * power[: len(tokens)], out=self.sums[1:])

    def span(self, start, end) -> Hashes:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


@lru_cache(1)
def _byte_values() -> Hashes:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words of UTF-8 bytes."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def tokens_of(text: bytes, unit: str) -> Hashes:
    """One hash per byte or word."""
    raw = np.frombuffer(text, np.uint8)
    values = _byte_values()[raw]
    if unit == "bytes":
        return values
    start, end = word_bounds(raw)
    return Rolling(values).span(start, end)


def decompress(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""
