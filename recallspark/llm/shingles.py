"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTES = np.random.default_rng(90_210).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(90_211).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a text that are hashed together, and powers of an odd number modulo 2^64, and of its inverse, for each place in them.
RUN = 1 << 16
_POWER, _INVERSE = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(RUN - 1, x, np.uint64))]) for x in (_ODD, pow(_ODD, -1, 1 << 64)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word [^\\x20\\x09-\\x0D]+ of a text, A-Z in lower case, in order.

    A word's hash follows from its bytes and their places in it.  Texts of any length are read in runs of RUN bytes; a word that goes on over runs is carried.
    """
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    found: list[np.ndarray] = []
    carried = size = 0  # of a word that has not ended yet
    for k in range(0, len(data), RUN):
        part = data[k : k + RUN]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[part], [True]])))
        starts, ends = edges[::2], edges[1::2]
        summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * _POWER[: len(part)])])
        sums, sizes = (summed[ends] - summed[starts]) * _INVERSE[starts], (ends - starts).astype(np.uint64)
        if size and _SPACE[part[0]]:
            found.append(np.array([(carried + size) & _MASK], np.uint64))
        elif size:
            sums[0] = (carried + int(sums[0]) * pow(_ODD, size, 1 << 64)) & _MASK
            sizes[0] += np.uint64(size)
        carried = size = 0
        if not _SPACE[part[-1]]:
            carried, size = int(sums[-1]), int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        found.append(sums + sizes)
    if size:
        found.append(np.array([(carried + size) & _MASK], np.uint64))
    return _mix(np.concatenate(found))


def shingles_of(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashed shingles of a text, rising; with fewer words, the whole sequence; with none, nothing."""
    words = words_of(text)
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out += words[j : n - k + 1 + j] * _PLACE[j]
    return np.unique(_mix(out))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    a = _mix(shingles + _PLACE[62]).sum(dtype=np.uint64)
    b = _mix(shingles ^ _PLACE[63]).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")
