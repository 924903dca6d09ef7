"""Anchors of fixed-length windows: where two windows can be equal, found without shipping texts.

Every window of ``width`` tokens is represented by its least ``k``-gram by hash (the leftmost
of equal ones).  Equal windows have the same least k-gram at the same offset, so only windows
whose least k-grams agree can be equal.  Consecutive windows with one and the same
anchor are a *run*; runs are all that is shuffled, about ``2 / (width - k + 2)`` a token.
"""

from __future__ import annotations

import numpy as np

from . import _text as T

#: Positions take the low half of a packed value: no text has 2**32 tokens.
_POS_MASK = np.uint64((1 << 32) - 1)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by minima within blocks of ``w``."""
    n = len(x)
    if w == 1 or n < w:
        return x[: max(0, n - w + 1)].copy()
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(grams: np.ndarray, first: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, count, anchor) of the runs of windows of ``width`` tokens.

    ``grams[i]`` is the hash of the k tokens from token i on (whatever follows a text's end is not looked at),
    ``first[t]:first[t+1]`` the tokens of text t.  ``start`` is the first window's first token, ``count`` the
    number of windows, ``anchor`` the first token of their least k-gram, all counted over the whole piece.
    """
    w = width - k + 1
    if len(grams) < w:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    packed = (grams & ~_POS_MASK) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(packed, w) & _POS_MASK).astype(np.int64)
    lengths = np.diff(first)
    windows = np.maximum(lengths - width + 1, 0)
    text = np.repeat(np.arange(len(lengths)), windows)
    offset = np.cumsum(windows) - windows
    start = np.arange(len(text)) - offset[text] + first[text]
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], start[at], np.diff(np.append(at, len(start))), anchor[at]


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens from each one on."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + n]
    return T.mix64(out)
