"""Vectorised text kernels: a whole Arrow batch is one array of code points, with no loop over characters in Python."""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts with one separator 0 after each, start of each text and the end)."""
    flat = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return flat, np.concatenate([np.zeros(1, np.int64), ends])


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, its row): runs of ``[a-z0-9]`` and single characters U+4E00-U+9FFF, in text order."""
    c, at = codes(texts)
    cjk = (c >= 0x4E00) & (c <= 0x9FFF)
    word = ((c >= 97) & (c <= 122)) | ((c >= 48) & (c <= 57))
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(cjk | first)
    h = c[starts].astype(np.uint64)
    in_run = np.flatnonzero(word)
    if len(in_run):
        begin = np.flatnonzero(first)
        offset = in_run - begin[np.cumsum(first[in_run]) - 1]
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(offset.max()), _M3 | np.uint64(1))]))
        h[first[starts]] = np.add.reduceat(mix(c[in_run].astype(np.uint64)) * power[offset], np.flatnonzero(first[in_run]))
    return mix(h), np.repeat(np.arange(len(texts)), np.diff(at))[starts]


def _sets(h: np.ndarray, row: np.ndarray, n: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each row, as 64-bit ids ascending within the row, and each row's offset."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g = mix(g * _M3 + h[k : len(h) - n + 1 + k])
    ok = row[: len(g)] == row[n - 1 :]
    g, row = g[ok].view(np.int64), row[: len(ok)][ok]
    by = np.lexsort((g, row))
    g, row = g[by], row[by]
    new = np.concatenate([np.ones(min(1, len(g)), bool), (g[1:] != g[:-1]) | (row[1:] != row[:-1])])
    return g[new], np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(row[new], minlength=texts))])


def token_gram_sets(texts: list[str], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the distinct n-token grams of each text."""
    return _sets(*tokens(texts), n, len(texts))


def char_gram_sets(texts: list[str], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the distinct n-character grams of each text; a shorter text is its own gram, padded at its end."""
    padded = [t + "\x01" * (n - len(t)) if len(t) < n else t for t in texts]
    c, at = codes(padded)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    keep = np.ones(len(c), bool)
    keep[at[1:] - 1] = False
    return _sets(mix(c[keep].astype(np.uint64)), row[keep], n, len(texts))
