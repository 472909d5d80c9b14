"""Repeated strings of a given length by threshold-bounded interval expansion on a Burrows-Wheeler transform.

``repeated_windows`` answers, for a block of byte strings, which windows of the given length occur twice or more in the block.
The suffixes are sorted to a depth beyond that length. Intervals of suffixes with a common prefix are then extended backwards,
breadth first: an extension that ends at a place whose common prefix with the next suffix is unknown sets it to the present
depth. Values come in increasing order, and the expansion stops at the length asked for: what is unknown then is at least
that long.
"""

from __future__ import annotations

import numpy as np

from .segments import GRAM, _gram_hashes

_PACK, _BITS = 7, 9


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] numbers, then the same for the next."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, boundary) by at least ``depth`` symbols; 0 marks an end, ends differ by place, and suffixes stop there.

    ``boundary`` is set where the first ``_PACK`` symbols of a suffix differ from those of the one before.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    until = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the end
    key = np.zeros(n, np.int64)
    padded = np.concatenate((symbols, np.zeros(_PACK, symbols.dtype))).astype(np.int64)
    for j in range(_PACK):
        key = key << _BITS | np.where(until > j, padded[j : j + n], 0)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (until[order[1:]] < _PACK)
    boundary = fresh.copy()
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    h = _PACK
    while h < depth:
        last = np.concatenate((fresh[1:], [True]))
        at = np.flatnonzero(~(fresh & last))  # places in groups of two and more
        if not len(at):
            break
        suffix = order[at]
        group = rank[suffix]
        follow = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)], -1)
        sort = np.argsort(group * np.int64(n + 1) + follow + 1, kind="stable")
        suffix, group, follow = suffix[sort], group[sort], follow[sort]
        order[at] = suffix
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        fresh[at] = new
        rank[suffix] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        h *= 2
    rank[order] = np.arange(n)
    return order, rank, boundary


def repeated_positions(symbols: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` symbols at each position also start elsewhere. Symbol 0 ends a string."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, bool)
    order, rank, boundary = _suffix_order(symbols, length + 1)
    known = np.concatenate((boundary, [True]))  # known[i]: the common prefix of suffixes i - 1 and i is below the present depth
    before = order - 1
    step = rank[before]  # the last-to-first mapping; the first suffix wraps around
    char = symbols[before]
    starts = np.flatnonzero(boundary)
    sizes = np.diff(np.concatenate((starts, [n])))
    depth = _PACK
    while depth < length and len(starts):
        member = _ranges(starts, sizes)
        of = np.repeat(np.arange(len(starts)), sizes)
        inner = char[member] != 0  # no extension over an end
        member, of = member[inner], of[inner]
        to = step[member]
        sort = np.argsort(to)
        to, of, c = to[sort], of[sort], char[member][sort]
        head = np.ones(len(to), bool)
        head[1:] = (to[1:] != to[:-1] + 1) | (of[1:] != of[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(head)
        size = np.diff(np.concatenate((first, [len(to)])))
        end = to[first] + size  # the place behind the extended interval
        unset = ~known[end]
        known[end[unset]] = True
        starts, sizes = to[first][unset], size[unset]
        depth += 1
    out = np.zeros(n, bool)
    out[order] = ~known[:-1] | ~known[1:]
    return out


def repeated_windows(strings: list[bytes], groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, whether each of its windows of ``length`` bytes occurs again in a string of the same group or in itself.

    Strings must be at least ``length`` long. Windows with a gram that occurs once in their group cannot be repeated; what is left
    are runs of windows, of which equal ones are taken once. The rest is decided by the transform.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    flags = [np.zeros(n - length + 1, bool) for n in sizes.tolist()]
    if not strings:
        return flags
    data = np.frombuffer(b"".join(strings), np.uint8)
    first = np.cumsum(sizes) - sizes
    grams = _gram_hashes(data) if len(data) >= GRAM else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(strings)), sizes)[: len(grams)]
    inside = np.arange(len(grams)) + GRAM <= (first + sizes)[owner]
    with np.errstate(over="ignore"):
        mixed = grams ^ (groups.astype(np.uint64)[owner] * np.uint64(0x9E3779B97F4A7C15))
    values = np.sort(mixed[inside])
    twice = values[1:][values[1:] == values[:-1]]
    place = np.minimum(np.searchsorted(twice, mixed), max(0, len(twice) - 1))
    single = (twice[place] != mixed) if len(twice) else np.ones(len(mixed), bool)
    singles = np.concatenate(([0], np.cumsum(single & inside)))
    windows = _ranges(first, sizes - length + 1)
    candidate = singles[windows + length - GRAM + 1] == singles[windows]
    owner = np.repeat(np.arange(len(strings)), sizes - length + 1)
    windows, owner = windows[candidate], owner[candidate]
    if not len(windows):
        return flags
    head = np.ones(len(windows), bool)
    head[1:] = (windows[1:] != windows[:-1] + 1) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(head)
    many = np.diff(np.concatenate((start, [len(windows)])))
    at, whose = windows[start], owner[start]
    runs: dict[tuple[int, bytes], list[int]] = {}
    whole = data.tobytes()
    for r, (a, m, w) in enumerate(zip(at.tolist(), many.tolist(), whose.tolist(), strict=True)):
        runs.setdefault((int(groups[w]), whole[a : a + m + length - 1]), []).append(r)
    distinct = list(runs)
    alone: dict[int, int] = {}
    for g, _ in distinct:
        alone[g] = alone.get(g, 0) + 1
    # a run that is there twice is repeated as a whole; it is needed only to be met by others of its group
    asked = [k for k in distinct if not (alone[k[0]] == 1 and len(runs[k]) > 1)]
    symbols = np.zeros(sum(len(s) for _, s in asked) + len(asked), np.int16)
    pos, places = 0, {}
    for k in asked:
        places[k] = pos
        symbols[pos : pos + len(k[1])] = np.frombuffer(k[1], np.uint8)
        symbols[pos : pos + len(k[1])] += 1
        pos += len(k[1]) + 1
    found = repeated_positions(symbols, length)
    for k, rs in runs.items():
        n = len(k[1]) - length + 1
        flag = np.ones(n, bool) if len(rs) > 1 else found[places[k] : places[k] + n]
        for r in rs:
            w = int(whose[r])
            offset = int(at[r] - first[w])
            flags[w][offset : offset + n] = flag
    return flags
