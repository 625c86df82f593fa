"""Hashes of words and shingles for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are taken together until they have so many bytes; a longer text is taken alone.
GROUP_BYTES = 2 << 20
_MASK = (1 << 20) - 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _power(n: int) -> np.ndarray:
    """At least n powers of an odd number."""
    global _powers
    n = min(n, _MASK + 1)
    if len(_powers) < n:
        step = np.full(max(n, 1024), 0xD6E8FEB86659FD93, np.uint64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and how many words each text has. Words are runs of other bytes than
    ASCII white space."""
    data = np.frombuffer(b" ".join([*texts, b" "]), np.uint8)
    solid = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(solid, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    upto = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    counts = np.diff(np.searchsorted(starts, upto), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    letters = data[solid]
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    value = _BYTE[letters] * _power(int(lengths.max()))[place & _MASK]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64)), counts


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes."""
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i])
    return out


def grouped(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts in groups of about GROUP_BYTES."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > GROUP_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held
