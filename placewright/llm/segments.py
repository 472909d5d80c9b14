"""Cutting bytes into segments such that equal strings of a given length fall into segments of equal key."""

from __future__ import annotations

import numpy as np
import xxhash

GRAM = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows in a segment at most; a longer run of one key, as in periodic text, is cut.
MOST_WINDOWS = 512
_STEP = 1 << 20


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of each ``GRAM`` consecutive bytes, by doubling."""
    h, base, n = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    while n < GRAM:
        h = h[:-n] * base + h[n:]
        with np.errstate(over="ignore"):
            base, n = base * base, 2 * n
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    out, n = values, 1
    while 2 * n <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - n :]) if n < width else out


def _least_twice(keys: np.ndarray, grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are the least of some window and whose value the next such gram shares."""
    edge = np.zeros(width - 1, np.uint64)
    most = ~_sliding_min(~np.concatenate((edge, keys, edge)), width)
    least = np.flatnonzero(most == grams)
    return least[:-1][grams[least[1:]] == grams[least[:-1]]]


def cut(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(key, content hash, first window, windows, periodic) of each segment of ``data``.

    A window is a string of ``length`` bytes; its key is the least hash of the grams in it. A segment is a run of consecutive
    windows with one key, so equal windows anywhere have equal keys, and every window is in one segment. A segment may hold
    equal windows itself only if its key's gram is in it twice: ``periodic``.
    """
    n, width = len(data) - length + 1, length - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    raw = np.frombuffer(data, np.uint8)
    parts, twice = [], []
    for at in range(0, n, _STEP):  # bounded memory for very long texts; the steps overlap where periods are looked for
        stop = min(n, at + _STEP)
        grams = _gram_hashes(raw[at : stop + length - 1])
        parts.append(_sliding_min(grams, width))
        twice.append(_least_twice(parts[-1], grams, width) + at)
    keys, pairs = np.concatenate(parts), np.concatenate(twice)
    first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    size = np.diff(np.concatenate((first, [n])))
    # the runs that reach over a step's border count as periodic for safety
    periodic = np.zeros(len(first), bool)
    periodic[np.searchsorted(first, np.minimum(pairs, n - 1), side="right") - 1] = True
    periodic[np.searchsorted(first, np.maximum(pairs - width + 1, 0), side="right") - 1] = True
    periodic[np.searchsorted(first, np.arange(_STEP, n, _STEP), side="right") - 1] = True
    if (size > MOST_WINDOWS).any():
        many = -(-size // MOST_WINDOWS)
        run = np.repeat(np.arange(len(first)), many)
        k = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        start = first[run] + k * MOST_WINDOWS
        size = np.minimum(MOST_WINDOWS, first[run] + size[run] - start)
        first, periodic = start, periodic[run]
    view = memoryview(data)
    hashes = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (first + size + length - 1).tolist(), strict=True)], dtype=np.uint64)
    return keys[first], hashes, first, size, periodic
