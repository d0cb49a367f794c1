"""Vectorised words, word hashes and word shingles of whole texts.

A word is a longest run of characters other than U+0020 and U+0009..U+000D.  A
word's 64-bit hash is a polynomial over its UTF-8 bytes, read off a prefix sum
of the text, so no word is ever a Python object.
"""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 22
_rng = np.random.default_rng(0xA11CE)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers[0], _powers[1] = _geometric(_BASE, size), _geometric(_INV, size)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _block_words(raw: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(edge):
        return np.empty(0, dtype=np.uint64), start, end
    power, inverse = _power(len(raw) + 1)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(table[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end


def word_places(raw: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text's UTF-8 bytes in order, and the words' first and past bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    table = _BYTE_LOWER if lower else _BYTE
    if len(data) <= _BLOCK:
        return _block_words(data, table)
    out, at = [], 0
    while at < len(data):  # blocks end at white space; a longer word makes a longer block
        end = min(at + _BLOCK, len(data))
        if end < len(data):
            cut = np.flatnonzero(_SPACE[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                rest = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else len(data)
        hashes, first, past = _block_words(data[at:end], table)
        out.append((hashes, first + at, past + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words of ``text`` in order; ``lower`` lower-cases A-Z first."""
    return word_places(utf8(text), lower)[0]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-word windows of a sequence of word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:count].copy()
    for i in range(1, n):
        out *= _U(0xD6E8FEB86659FD93)
        out += words[i : i + count]
    return mix(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of the A-Z-lower-cased text; with fewer
    words the whole sequence is one shingle; without words the set is empty."""
    words = word_hashes(text, lower=True)
    if not len(words):
        return words
    if len(words) < n:
        return mix(ngram_hashes(words, len(words)) + _U(len(words)))
    return np.unique(ngram_hashes(words, n))
