"""Hashes of words, shingles and sliding minima over whole batches of texts, without a Python loop per word.

A word is a longest run of bytes other than space and \\t..\\r. Hashes are polynomials modulo 2**64 over
random tables, mixed at the end. They depend on the word alone, so they agree between tasks and jobs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z only
_SEEDED = np.random.default_rng(20240607)
_BYTE = _SEEDED.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * _U(2) + _U(1)
_BASE = (_U(0xD1342543DE82EF95), _U(0xAF251AF3B0F025B5))
_CHUNK = 1 << 20


class Words(NamedTuple):
    """h: (2, words) hashes; bounds: the n + 1 word numbers at which documents begin; start, end: byte places."""

    h: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte places where words start and end, and the documents' bounds in word numbers."""
    word = ~_SPACE[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = offs[1:-1] - offs[0]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] = word[cut]  # a document begins a word even right after the last one's end
    last[cut - 1] = word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs - offs[0])


def hashed(raw: np.ndarray, offs: np.ndarray, fold: bool = False) -> Words:
    """Words of the documents raw[offs[i]:offs[i+1]]; fold lower-cases A-Z. raw begins at offs[0]."""
    start, end, bounds = word_spans(raw, offs)
    size = end - start
    h = np.empty((2, len(start)), np.uint64)
    total = np.concatenate(([0], np.cumsum(size)))
    power = [_powers(b, int(size.max(initial=1))) for b in _BASE]
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(total, total[a] + _CHUNK, "right")) - 1)
        at = total[a:b] - total[a]
        rel = np.arange(total[b] - total[a]) - np.repeat(at, size[a:b])
        byte = raw[rel + np.repeat(start[a:b], size[a:b])]
        if fold:
            byte = _FOLD[byte]
        for k in (0, 1):
            h[k, a:b] = np.add.reduceat(_BYTE[k][byte] * power[k][rel], at)
        a = b
    for k in (0, 1):
        h[k] = mix(h[k] + size.astype(np.uint64) * _BASE[k])
    return Words(h, bounds, start, end)


def stretches(h: np.ndarray, start: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
    """Hash of the word hashes from each start to before its end; for equal lengths the same as that of runs()."""
    base = _BASE[k]
    back = _powers(_U(pow(int(base), -1, 1 << 64)), len(h))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(base, len(h)), dtype=np.uint64)))
    return mix((total[end] - total[start]) * back[start])


def runs(h: np.ndarray, n: int, k: int = 0) -> np.ndarray:
    """Hash of each n neighbouring word hashes; runs over a document's end are there too, and mean nothing."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    base = _BASE[k]
    back = _U(pow(int(base), -1, 1 << 64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(base, len(h)), dtype=np.uint64)))
    return mix((total[n:] - total[:-n]) * _powers(back, len(h) - n + 1))


def sliding(x: np.ndarray, n: int, best=np.minimum) -> np.ndarray:
    """The best (least, or greatest) of each n neighbours."""
    if len(x) < n:
        return x[:0]
    size, y = 1, x
    while 2 * size <= n:
        y = best(y[:-size], y[size:])
        size *= 2
    return best(y[: len(x) - n + 1], y[n - size : n - size + len(x) - n + 1])


def begins(bounds: np.ndarray, n: int, words: int) -> np.ndarray:
    """Mask over the words: true where n words of one document begin."""
    doc_end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(words) + n <= doc_end
