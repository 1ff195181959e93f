"""Vectorised word hashing over whole texts.

A word is a longest run of ASCII letters and digits and of bytes from 0x80 of the lower-cased
UTF-8 text, so that letters of any script belong to words and ASCII punctuation parts them.
Hashes have 64 bits and depend on nothing but the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library than glibc
    _TRIM = None

_U = np.uint64
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[0x80:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, dtype=_U)
_COEF = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=_U) | _U(1)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(n, 2 * len(_POW), 256)
        p = np.empty(size, dtype=_U)
        p[0] = 1
        p[1:] = _U(_BASE)
        _POW = np.cumprod(p, dtype=_U)
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(texts: list[str | None], segment: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and offsets: the words of text i are ``h[off[i]:off[i+1]]``. None has no words.

    Work goes on in segments of about ``segment`` bytes cut between words, so that a very long
    text needs little more than its own words' hashes.
    """
    parts = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    doc_start = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=doc_start[1:])
    a = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    hashes, starts = [], []
    s, n = 0, len(a)
    while s < n:
        e = min(n, s + segment)
        while e < n and _WORD[a[e - 1]] and _WORD[a[e]]:
            gaps = np.flatnonzero(~_WORD[a[s:e]])
            if len(gaps) and gaps[-1]:
                e = s + int(gaps[-1])
            else:
                e = min(n, e + segment)
        m = _WORD[a[s:e]]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], m, [False])).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        if len(first):
            size = last - first
            chars = a[s:e][m].astype(_U)
            at = np.cumsum(size) - size
            pos = np.arange(len(chars)) - np.repeat(at, size)
            chars += _U(1)
            chars *= _powers(int(size.max()))[pos]
            hashes.append(mix(np.add.reduceat(chars, at) + size.astype(_U)))
            starts.append(first + s)
        s = e
    if not hashes:
        return np.empty(0, dtype=_U), np.zeros(len(parts) + 1, dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), doc_start)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, 8 at most; element i begins at word i. Runs over text boundaries are for the caller to leave out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    out = np.full(n, _U(width), dtype=_U)
    for k in range(width):
        out += words[k : k + n] * _COEF[k]
    return mix(out)


def shingle_sets(texts: list[str | None], width: int):
    """Yields for each text its sorted distinct shingle hashes; a text of fewer than ``width`` words has the one run of all its words."""
    words, off = word_hashes(texts)
    runs = shingles(words, width)
    for i in range(len(texts)):
        a, b = off[i], off[i + 1]
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield shingles(words[a:b], int(b - a))
        else:
            yield np.empty(0, dtype=_U)


def give_back() -> None:
    """Hand freed memory to the system: workers live on between stages, and what their heaps hold counts."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(part: pa.Array, limit: int = 1 << 19) -> Iterator[list[str | None]]:
    """The texts of an Arrow array, about ``limit`` bytes at a time, so that a worker never holds a whole batch twice; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(part):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield part.slice(at, end - at).to_pylist()
        at = end
    give_back()


def batches(texts: list, limit: int = 8 << 20):
    """Slices of a list of texts of about ``limit`` characters each; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > at and size + n > limit:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))
