"""Word shingles of texts as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0xD6E8FEB86659FD93
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
BASE = np.uint64(0x9FB21C651E98DF25)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WINDOW = 1 << 20
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < size:
        size = max(size, WINDOW + 1)
        for name, base in (("up", MULTIPLIER), ("down", INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``data``, a window at a time cut at white space."""
    hashes, places, start = [], [], 0
    raw = np.frombuffer(data, dtype=np.uint8)
    while start < len(raw):
        stop = min(len(raw), start + WINDOW)
        while stop < len(raw) and not SPACES[raw[stop]]:
            stop += 1
        part = raw[start:stop]
        word = ~SPACES[part]
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=total[1:])
        hashes.append(mixed((total[end] - total[first]) * down[first]))
        places.append(first + start)
        start = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles.

    A-Z count as a-z; words are runs without ASCII white space. A text of fewer words has its whole
    sequence as its only shingle, one without words has none.
    """
    blocks = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    words, at = word_hashes(b"\n".join(blocks))
    ends = np.cumsum([len(b) + 1 for b in blocks])
    bounds = np.searchsorted(at, ends)
    runs = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64) + np.uint64(n)
    for i in range(n):
        runs = runs * BASE + words[i:i + len(runs)]
    runs = mixed(runs)
    out, low = [], 0
    for high in bounds:
        if high - low >= n:
            out.append(np.unique(runs[low:high - n + 1]))
        elif high > low:
            h = np.full(1, high - low, dtype=np.uint64)
            for w in words[low:high]:
                h = h * BASE + w
            out.append(mixed(h))
        else:
            out.append(np.zeros(0, np.uint64))
        low = high
    return out
