"""Vectorised text kernels: a whole Arrow batch is one array of code points.

Nothing here loops over characters in Python. A batch is folded text by text
(``unicodedata`` is C), joined, viewed as uint32 code points and tokenised with
array operations, so the cost per character is a few nanoseconds and a single
very long text costs the same as many short ones.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from ..functions.kernels import _M1, _M2, _M3, codes, mix, tokens  # noqa: F401  used by the operators as kernels of this module

#: Width of a gram id. The row number of a batch takes the bits above it in the
#: sort key, so a batch may hold 2**20 rows.
GRAM_BITS = 44
_GRAM_MASK = np.uint64((1 << GRAM_BITS) - 1)


def fold(text: str | None) -> str:
    """NFKC, then lower case; null gives the empty text."""
    return unicodedata.normalize("NFKC", text).lower() if text else ""


def _grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(44-bit id of the gram at each token, whether the n tokens lie in one row)."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g = mix(g * _M3 + h[k : len(h) - n + 1 + k])
    return g & _GRAM_MASK, row[: len(g)] == row[n - 1 :]


def gram_sets(texts: list[str], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(gram ids, offsets): row i holds its distinct n-token grams, ascending, at offsets[i]:offsets[i+1].

    Ids are 44-bit hashes: two given texts of a hundred grams differ in their
    overlap from the true one with a chance of about 1e-9.
    """
    h, row = tokens(texts)
    g, ok = _grams(h, row, n)
    key = (row[: len(g)][ok].astype(np.uint64) << np.uint64(GRAM_BITS)) | g[ok]
    key.sort()
    key = key[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])]
    size = np.bincount((key >> np.uint64(GRAM_BITS)).astype(np.int64), minlength=len(texts))
    return (key & _GRAM_MASK).astype(np.int64), np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])


def suffixes(texts: list[str], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row) of every suffix of at least n tokens, in text order: suffixes sorted by gram are a suffix array to n tokens."""
    h, row = tokens(texts)
    g, ok = _grams(h, row, n)
    return g[ok], row[: len(g)][ok]


def set_ids(grams: np.ndarray, offsets: np.ndarray, bins: int = 96) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 128-bit id of each row's gram set, as two int64, and further parities; equal sets have equal ids.

    Bit k of ``bins`` parities tells whether an odd number of the set's grams hash to
    k. Where two sets differ in more of these bits than they may differ in grams, they
    differ in too many grams, so most false candidates fall without a look at the
    sets. The id holds 96 parities and 32 bits of a plain hash; parities beyond 96
    (at most 224) are in the third and fourth array.
    """
    size = np.diff(offsets)
    out = [np.zeros(len(size), np.uint64) for _ in range(4)]
    full = size > 0
    if full.any():
        start = offsets[:-1][full]
        h = mix(grams.astype(np.uint64) ^ _M2)
        bit = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        one = np.uint64(1) << (bit & np.uint64(63))
        word = bit >> np.uint64(6)
        parity = [np.bitwise_xor.reduceat(np.where(word == w, one, np.uint64(0)), start) if 64 * w < bins else np.zeros(len(start), np.uint64) for w in range(4)]
        plain = mix(np.add.reduceat(h, start) ^ size[full].astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        low = np.uint64(0xFFFFFFFF)
        out[0][full] = parity[0]
        out[1][full] = (parity[1] & low) << np.uint64(32) | plain
        out[2][full] = (parity[1] >> np.uint64(32)) | (parity[2] << np.uint64(32))
        out[3][full] = (parity[2] >> np.uint64(32)) | (parity[3] << np.uint64(32))
    return tuple(x.view(np.int64) for x in out)


def differing_bits(h1: np.ndarray, l1: np.ndarray, h2: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """A lower bound of the number of grams in one set but not the other."""
    return np.bitwise_count((h1 ^ h2).view(np.uint64)).astype(np.int64) + np.bitwise_count((l1 ^ l2).view(np.uint64) >> np.uint64(32))
