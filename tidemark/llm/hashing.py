"""Vectorised hashing of words, word shingles and substrings over byte buffers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
WORD_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at once; a longer text is hashed alone.
SLICE_BYTES = 1 << 18

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers = {BASE: np.ones(1, np.uint64), BASE_INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Spans:
    """Hashes of any byte spans of one buffer, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(BASE_INVERSE, self.size + 1)[start] + (end - start).astype(np.uint64))


def slices(texts: Sequence[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """``texts`` in UTF-8, in runs of about ``most`` bytes, each with its first index; null is empty."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        if run and size + len(raw) > most:
            yield first, run
            first, run, size = i, [], 0
        run.append(raw)
        size += len(raw)
    if run:
        yield first, run


def words(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the run's texts, A-Z lowered, and the offsets of each text's words."""
    data = _lower[np.frombuffer(b"\n".join(run) + b"\n", np.uint8)]
    space = _space[data]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & ~np.concatenate(([True], space[:-1])))
    bounds = np.concatenate(([0], np.cumsum([len(x) + 1 for x in run])))
    return Spans(data).of(start, end), np.searchsorted(start, bounds)


def shingle_sets(run: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle."""
    hashes, at = words(run)
    if len(hashes) >= width:
        rolled = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            rolled = rolled * WORD_STEP + hashes[k : len(hashes) - width + 1 + k]
        rolled = mix(rolled)
    sets = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= width:
            sets.append(np.unique(rolled[s : e - width + 1]))
        elif e > s:
            short = np.uint64(e - s)
            with np.errstate(over="ignore"):
                for h in hashes[s:e]:
                    short = short * WORD_STEP + h
            sets.append(mix(np.array([short + np.uint64(1)])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
