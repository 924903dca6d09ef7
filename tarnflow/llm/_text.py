"""Vectorised tokenising and hashing of UTF-8 text batches (numpy, no per-word Python).

Texts arrive as Arrow string columns.  A *piece* is a run of whole texts of at
most ``PIECE`` bytes (a longer text is a piece of its own), so temporary arrays
stay bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U64 = np.uint64
#: An odd base, its inverse modulo 2**64, and the mixing constants of a 64-bit finaliser.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_BYTE_VALUE_LOWER = _BYTE_VALUE[_LOWER]
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x *= _M1
    x ^= x >> U64(33)
    x *= _M2
    x ^= x >> U64(33)
    return x


def powers(n: int, kind: str = "up") -> np.ndarray:
    """Powers of the base (``up``) or of its inverse (``down``), at least ``n`` of them."""
    have = _powers[kind]
    if len(have) < n:
        full = np.full(max(n, PIECE + 2), _BASE if kind == "up" else _INV, U64)
        full[0] = 1
        _powers[kind] = have = np.multiply.accumulate(full)
    return have


@dataclass
class Piece:
    """Consecutive texts: ``data`` bytes, ``offs[i]:offs[i+1]`` the i-th text, rows ``lo:hi`` of the batch."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, raw_offs, raw = column.buffers()
    offs = np.frombuffer(raw_offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if column.null_count:
        # a null text is an empty one: Arrow gives nulls no bytes, but only by convention
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offs), 0)
        if lengths.sum() != offs[-1] - offs[0]:
            column = column.fill_null("")
            yield from pieces(column, limit)
            return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Piece(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Tokens:
    """Tokens of a piece in order: byte range, hash, and ``first[i]:first[i+1]`` those of text i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[data] * powers(len(data) + 1)[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes ``starts:ends``, the same wherever these bytes stand."""
    x = sums[ends] - sums[starts]
    x *= powers(len(sums), "down")[starts]
    x += (ends - starts).astype(U64) * _M2
    return mix64(x)


def tokens(piece: Piece, lower: bool = False, alnum: bool = False) -> Tokens:
    """Words ``[^\\x20\\x09-\\x0D]+``, or with ``alnum`` runs of ASCII letters, digits and non-ASCII bytes."""
    data, offs = piece.data, piece.offs
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none.astype(U64), np.zeros(len(offs), np.int64))
    inside = _ALNUM[data] if alnum else ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offs[:-1][offs[:-1] < n]
    begins[edges] = inside[edges]
    ends_at = inside.copy()
    ends_at[:-1] &= ~inside[1:]
    last = offs[1:][offs[1:] > 0] - 1
    ends_at[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends_at) + 1
    hashes = range_hash(prefix_sums(data, lower), starts, ends)
    return Tokens(starts, ends, hashes, np.searchsorted(starts, offs))


def shingles(tok: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-token windows of each text (the whole sequence where it is shorter), and their ``first``.

    Equal sequences have equal hashes; windows never cross texts.
    """
    h, first = tok.hashes, tok.first
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(sizes, out=out_first[1:])
    out = np.zeros(int(out_first[-1]), U64)
    full = len(h) - k + 1
    if full > 0:
        rolled = np.zeros(full, U64)
        for j in range(k):
            rolled *= U64(_BASE)
            rolled += h[j : j + full]
        text_of = np.repeat(np.arange(len(counts)), np.where(counts >= k, sizes, 0))
        ordinal = np.arange(len(text_of)) - np.repeat(np.cumsum(np.where(counts >= k, sizes, 0)) - np.where(counts >= k, sizes, 0), np.where(counts >= k, sizes, 0))
        out[out_first[text_of] + ordinal] = mix64(rolled[first[text_of] + ordinal])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        x = U64(counts[i])
        with np.errstate(over="ignore"):
            for v in h[first[i] : first[i + 1]]:
                x = x * U64(_BASE) + v
        out[out_first[i]] = mix64(np.array([x], U64))[0]
    return out, out_first


def segment_ids(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their ``first``."""
    ids = segment_ids(first)
    order = np.lexsort((values, ids))
    v, ids = values[order], ids[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (ids[1:] != ids[:-1])
    v, ids = v[keep], ids[keep]
    return v, np.searchsorted(ids, np.arange(len(first)))


def sets_of(texts: pa.Array, k: int, limit: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingle hashes (A-Z lower-cased) of a few texts, and their ``first``."""
    for piece in pieces(texts, limit):
        return distinct_per_text(*shingles(tokens(piece, lower=True), k))
    return np.zeros(0, U64), np.zeros(1, np.int64)
