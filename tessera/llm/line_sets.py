"""Shingle sets and minima of lines, read plainly in numpy.

The tests hold ``line_dedup`` and its expressions against these; no query runs them.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.tokens import mix

WIDTH = 8
#: Minima in a band, and bands.
ROWS, BANDS = 4, 10
_BASE = 0x9E3779B97F4A7C15


def _runs(points: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` code points that start at each place, as far as there are so many."""
    runs, length, rest = points.astype(np.uint64), 1, len(points)
    with np.errstate(over="ignore"):
        while length < width:
            step = min(length, width - length)
            runs = runs[: max(0, rest - length - step + 1)] * np.uint64(pow(_BASE, step, 1 << 64)) + (runs[length:] if step == length else runs[width - length :])[: max(0, rest - length - step + 1)]
            length += step
        return mix(runs)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique builds a hash table first, which takes several times as long."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def shingles(line: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` characters at every place of a line."""
    points = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32)
    return _distinct(_runs(points, min(width, len(points))) ^ np.uint64(min(width, len(points))))


def _hashed(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the line, hash) of each place of each line's shingles."""
    points = np.frombuffer("\n".join(lines).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(x) for x in lines])
    starts = np.r_[0, np.cumsum(sizes[:-1] + 1)]
    places = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(lines)), places)
    at = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(places[:-1])], places) + np.repeat(starts, places)
    hashes = _runs(points, width)[at] ^ np.uint64(width) if len(owner) else np.zeros(0, np.uint64)
    short = np.flatnonzero(places == 0)
    if len(short):
        owner, hashes = np.r_[owner, short], np.r_[hashes, np.concatenate([shingles(lines[k], width) for k in short])]
    return owner, hashes


def reached(left: list[str], right: list[str], width: int, percent: int) -> np.ndarray:
    """Which of the pairs of lines reach the similarity, by their whole sets.

    The sets of all lines are one sorted array of line * codes + code, in which
    the members of the left sets are looked up in the place of the right ones.
    """
    known = {line: k for k, line in enumerate(dict.fromkeys([*left, *right]))}
    owner, hashes = _hashed(list(known), width)
    values = _distinct(hashes)
    members = _distinct(owner * len(values) + np.searchsorted(values, hashes))
    owners, codes = np.divmod(members, len(values))
    sizes = np.bincount(owners, minlength=len(known))
    starts = np.r_[0, np.cumsum(sizes[:-1])]
    x, y = np.array([known[t] for t in left]), np.array([known[t] for t in right])
    able = np.flatnonzero(100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y]))
    counts = sizes[x[able]]
    pair = np.repeat(np.arange(len(able)), counts)
    own = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[x[able]], counts)
    asked = np.repeat(y[able], counts) * len(values) + codes[own]
    met = members[np.minimum(np.searchsorted(members, asked), len(members) - 1)] == asked
    overlap = np.bincount(pair[met], minlength=len(able))
    return able[100 * overlap >= percent * (counts + sizes[y[able]] - overlap)]


def signatures(lines: list[str], width: int, minima: int) -> np.ndarray:
    """A row of minima for each line."""
    owner, hashes = _hashed(lines, width)
    out = np.full(len(lines) * minima, np.uint64(0xFFFFFFFFFFFFFFFF))
    place = ((hashes >> np.uint64(40)) * np.uint64(minima) >> np.uint64(24)).astype(np.int64)
    with np.errstate(over="ignore"):
        np.minimum.at(out, owner * minima + place, mix(hashes + np.uint64(_BASE)))
    out = out.reshape(len(lines), minima)
    empty = out == np.uint64(0xFFFFFFFFFFFFFFFF)
    filled, again = out.copy(), 0
    while empty.any():  # every line has a shingle, so that each search ends
        again += 1
        rows, columns = np.nonzero(empty)
        other = (mix(columns.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(again)) % np.uint64(minima)).astype(np.int64)
        filled[rows, columns] = out[rows, other]
        empty[rows, columns] = out[rows, other] == np.uint64(0xFFFFFFFFFFFFFFFF)
    return filled
