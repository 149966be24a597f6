"""Words of many texts as arrays: where they are, and a 64-bit hash of each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed value: the characters between words, as [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_random = np.random.Generator(np.random.PCG64(20240607))
_OF_BYTE = _random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(int(_random.integers(1, 1 << 62)) * 2 + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole 64-bit number (the finaliser of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 64), _BASE, np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers[:n]


@dataclass(frozen=True)
class Words:
    data: bytes  # all texts, one white-space byte behind each
    starts: np.ndarray  # of every word in data
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    """Words of each text in order; equal words have equal hashes."""
    data = b"\n".join(texts) + b"\n"
    if lower:
        data = data.translate(_LOWER)
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    change = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, borders)
    lengths = ends - starts
    if not len(starts):
        return Words(data, starts, ends, first, np.zeros(0, np.uint64))
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    hashes = np.add.reduceat(_OF_BYTE[raw[inside]] * powers(int(lengths.max()))[place], at)
    return Words(data, starts, ends, first, mixed(hashes + lengths.astype(np.uint64)))


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each place; needs at least n words."""
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + words[k:len(words) - n + 1 + k]
    return mixed(out + np.uint64(n))
