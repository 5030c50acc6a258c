"""64-bit hashes of words and word shingles of one text, by numpy, in bounded memory."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_POW_BITS = 12
_POW = np.cumprod(np.full(1 << _POW_BITS, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
_ORDER = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER_LOWER = _LETTER[_LOWER]
_CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit hangs on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(b: np.ndarray) -> np.ndarray:
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    at = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    pos = np.arange(len(at)) - np.repeat(first, lens)
    v = _LETTER_LOWER[b[at]] * _POW[pos & ((1 << _POW_BITS) - 1)]
    if lens.max() >= 1 << _POW_BITS:
        v = mix(v + (pos >> _POW_BITS).astype(np.uint64))
    return mix(np.add.reduceat(v, first) + lens.astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word: words lie between ASCII white space, A-Z count as a-z.  Long texts go piece by piece."""
    b = np.frombuffer(text, dtype=np.uint8)
    if len(b) <= _CHUNK:
        return _words(b)
    out, start = [], 0
    while start < len(b):
        stop = start + _CHUNK
        while stop < len(b) and not _SPACE[b[stop]]:
            cut = np.flatnonzero(_SPACE[b[stop : stop + _CHUNK]])
            stop = stop + int(cut[0]) if len(cut) else min(len(b), stop + _CHUNK)
        out.append(_words(b[start:stop]))
        start = stop
    return np.concatenate(out)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter; empty without words."""
    w = word_hashes(text)
    n = min(k, len(w))
    if not n:
        return w
    m = len(w) - n + 1
    h = w[:m] * _ORDER[0]
    for j in range(1, n):
        h = mix(h) + w[j : j + m] * _ORDER[j]
    return np.unique(mix(h + np.uint64(n)))
