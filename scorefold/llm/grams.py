"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from scorefold.llm.common import ship

#: Code points handled at once: memory stays bounded for texts of any length.
PIECE = 1 << 20

ship(__name__)


def code_points(text: str | None) -> np.ndarray:
    """The lower-cased text with single spaces between and around its words; empty for wordless texts."""
    words = (text or "").lower().split()
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32) if words else np.zeros(0, np.uint32)


def buckets(text: str | None, sizes: range, bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers below 2^bits of all n-grams of the given sizes, repeats included, in pieces."""
    points = code_points(text)
    for at in range(0, len(points), PIECE):
        part = points[at : at + PIECE + sizes.stop - 2]
        h = np.zeros(len(part) + 1, np.uint32)
        for n in range(1, sizes.stop):
            if len(part) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + part[n - 1 :]
            if n in sizes:
                yield ((h[:PIECE] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
