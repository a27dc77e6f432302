"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

#: Texts are worked on in runs of about this many characters, which bounds a task's memory; no text is cut.
RUN_CHARS = 400_000
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to a word (as \\w in Python's re), and a random value."""
    word = np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)
    return word, mix((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * _GOLD)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def runs(texts: Sequence[str], size: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts that together hold about `size` characters."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and bounds: text i has words bounds[i] to bounds[i + 1]."""
    lowered = [t.lower() for t in texts]
    points = code_points("\n".join(lowered) + "\n")
    word, values = _tables()
    inside = word[points]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    size = 1 << max(len(points), 2).bit_length()
    up, down = _powers(size)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(values[points] * up[: len(points)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lowered])))
    return hashes, np.searchsorted(starts, edges)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order with their bounds by text.

    A text of 1 to k - 1 words has one shingle of all of them; a text without words has none.
    """
    lengths = np.diff(bounds)
    whole = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        whole = whole * _M2 + words[j : j + len(whole)]
    whole = mix(whole + np.uint64(k))
    counts = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    out_bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(out_bounds[-1], np.uint64)
    if (lengths >= k).all():
        at = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(len(out))
        return whole[at], out_bounds
    for i, n in enumerate(lengths):
        a, b = bounds[i], out_bounds[i]
        if n >= k:
            out[b : b + n - k + 1] = whole[a : a + n - k + 1]
        elif n:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a : a + n]:
                    h = h * _M2 + w
            out[b] = mix(np.array([h + np.uint64(n)]))[0]
    return out, out_bounds
