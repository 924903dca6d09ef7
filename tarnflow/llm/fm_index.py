"""Substring dedup by a compressed FM-index per shard: backward search over wavelet trees.

A word goes if it is covered by a window of 20 consecutive words whose sequence also starts earlier.
:mod:`._repeats` finds the runs of windows that can be equal and shards their contents by anchor.  Here the first
occurrences of a shard are indexed, and the other ones (and first ones that have others under their anchor) are
streamed against the index, from their ends on: backward search extends a document's matching interval by the next word, and where
that leaves no occurrence (of an indexed segment: none but its own) the match is shortened from its right end.
So each word costs a few steps, whatever the window.  Intervals that reach the
window's length are reported; a window is marked if the first occurrence in its interval, in order of (doc_id, start), is ahead of it.
Every word that goes is marked by the index, copies of whole documents included.

The index holds the Burrows-Wheeler transform as a wavelet matrix, bounds of the matching intervals by depth
(bit vectors packed in 64-bit words with block counts), and one text position in ``SAMPLE``; other ones are located by
steps through the transform.  Neither the text nor its suffix array is kept.

Edge cases: a null text has no words; texts under 20 words have no windows; rows that repeat a doc_id are judged
apart (two equal ones: neither is earlier); a null doc_id is the smallest; very long texts are whole; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from ._repeats import Shard, Unit, covered, cut, keyed, repeated_windows

WINDOW = 20
UNIT = Unit(words=True, width=WINDOW, ks=(6, 15, WINDOW))


#: Every so many text positions one is kept in the sampled suffix array.
SAMPLE = 8


class Bits:
    """A bit vector with rank and select: 64 bits a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        whole = np.zeros(-(-(n + 1) // 64) * 64, bool)
        whole[:n] = bits
        self.words = np.packbits(whole, bitorder="little").view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words))[:-1]).astype(np.int32)
        self.zeros = n - int(np.count_nonzero(bits))

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones ahead of position i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def select1(self, r: np.ndarray) -> np.ndarray:
        """Position of the one with r ones ahead of it."""
        word = np.searchsorted(self.before, r, "right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = (np.cumsum(bits, axis=1) == (r - self.before[word] + 1)[:, None]).argmax(axis=1)
        return word * 64 + inside

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """Index of segments, each of which ends with the symbol 0: wavelet matrix of the BWT, interval bounds by depth, sampled positions.

    The text itself and its suffix array are not kept.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        """``text``: symbols 1.. and the ends; ``depth``: the longest match that is told apart."""
        n = len(text)
        self.size, self.depth = n, depth
        ends = np.flatnonzero(text == 0)
        # ends are ordered by their place: no comparison runs on beyond a segment
        level = text.astype(np.int64) + len(ends)
        level[ends] = np.arange(len(ends))
        longest = int(np.diff(np.append(-1, ends)).max(initial=1))
        step = 1
        order = np.argsort(level, kind="stable")
        level = self._numbered(level[order], order)
        while step < longest:
            after = np.zeros(n, np.int64)
            after[: n - step] = level[step:] + 1
            key = level * (n + 1) + after
            order = np.argsort(key, kind="stable")
            level = self._numbered(key[order], order)
            step *= 2
        # symbols common to neighbours in order, up to ``depth``: bounds of the intervals of each depth
        bound = np.ones(n, bool)
        a, b = order[:-1], order[1:]
        padded = np.append(text, np.zeros(depth, text.dtype))
        alike = np.ones(max(0, n - 1), bool)
        self.bounds = []
        for d in range(depth - 1):
            x = padded[a + d]
            alike &= (x == padded[b + d]) & (x != 0)
            bound[1:] = ~alike
            self.bounds.append(Bits(bound))
        self.counts = np.searchsorted(text[order], np.arange(int(text.max(initial=0)) + 2))
        bwt = text[order - 1].astype(np.int64)
        self.width = max(1, int(bwt.max(initial=0)).bit_length())
        self.levels = []
        for bit in range(self.width - 1, -1, -1):
            ones = (bwt >> bit & 1).astype(bool)
            self.levels.append(Bits(ones))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        every = np.arange(len(self.counts) - 1)
        self.start = self._down(every, np.zeros(len(every), np.int64))
        # a segment's first position is always kept: what stands ahead of it is an end, which has no row to go to
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.kept, self.places = Bits(kept), order[kept].astype(np.int32)

    @staticmethod
    def _numbered(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        new = np.zeros(len(order), np.int64)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.levels):
            one = (symbol >> (self.width - 1 - level) & 1).astype(bool)
            r = bits.rank1(i)
            i = np.where(one, bits.zeros + r, i - r)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of the backward search: the intervals of symbol + match."""
        base = self.counts[symbol] - self.start[symbol]
        return self._down(symbol, lo) + base, self._down(symbol, hi) + base

    def shorten(self, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``depth`` symbols of the suffixes in these rows (all rows for depth 0)."""
        lo, hi = np.zeros(len(row), np.int64), np.full(len(row), self.size, np.int64)
        for d in np.unique(depth[depth > 0]):
            here = np.flatnonzero(depth == d)
            bits = self.bounds[d - 1]
            r = bits.rank1(row[here] + 1)
            lo[here] = bits.select1(r - 1)
            more = r < self.size - bits.zeros
            hi[here[more]] = bits.select1(r[more])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the BWT until a kept one is met."""
        out = np.empty(len(row), np.int64)
        left = np.arange(len(row))
        for step in range(SAMPLE):
            found = self.kept.at(row)
            out[left[found]] = self.places[self.kept.rank1(row[found])] + step
            left, row = left[~found], row[~found]
            if not len(left):
                break
            symbol = np.zeros(len(row), np.int64)
            at = row
            for level, bits in enumerate(self.levels):
                one = bits.at(at)
                symbol |= one.astype(np.int64) << (self.width - 1 - level)
                r = bits.rank1(at)
                at = np.where(one, bits.zeros + r, at - r)
            row = at + self.counts[symbol] - self.start[symbol]
        return out


def matches(index: FMIndex, symbols: np.ndarray, first: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching statistics of documents streamed from their ends: (position, lo, hi) of each match of the index's depth.

    Every document has one interval, which is extended by its next symbol; where fewer than ``need`` (of the document) occurrences would be left, it is first shortened
    at its right end, a symbol at a time.  All documents of the call take their steps together.
    """
    lane = np.arange(len(first) - 1)
    at, stop = first[1:] - 1, first[:-1]
    live = lane[at >= stop]
    lo, hi, depth = np.zeros(len(lane), np.int64), np.full(len(lane), index.size, np.int64), np.zeros(len(lane), np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    while len(live):
        symbol = symbols[at[live]]
        known = symbol >= 0
        a, b = index.extend(np.where(known, symbol, 0), lo[live], hi[live])
        fits = known & (b - a >= need[live])
        on, off = live[fits], live[~fits]
        lo[on], hi[on] = a[fits], b[fits]
        depth[on] += 1
        full = on[depth[on] == index.depth]
        if len(full):
            found.append((at[full], lo[full], hi[full]))
        # nothing matches the symbol, or it has been taken
        unmatched = depth[off] == 0
        at[on] -= 1
        at[off[unmatched]] -= 1
        # a match that cannot be extended, or is as long as it can be, gets shorter
        short = np.concatenate([off[~unmatched], full])
        if len(short):
            depth[short] -= 1
            lo[short], hi[short] = index.shorten(lo[short], depth[short])
        live = live[at[live] >= stop[live]]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def earlier_windows(shard: Shard) -> np.ndarray:
    """Which windows (in order of the segments) also start earlier.

    The first occurrence of each class is indexed.  Last occurrences, and first ones that share their anchor, are streamed.
    """
    size = shard.width - shard.k + 1
    # an anchor is one symbol
    length = np.diff(shard.first)
    short = length - shard.k + 1
    begin = np.cumsum(short) - short
    own = np.repeat(np.arange(len(short)), short)
    k = np.arange(len(own)) - begin[own]
    text = shard.symbols[shard.first[own] + k + np.where(k > shard.left[own], shard.k - 1, 0)]
    is_anchor = k == shard.left[own]
    dense = np.unique(text, return_inverse=True)[1] + 1
    text = np.where(is_anchor, int(dense.max(initial=0)) + 1 + shard.anchor[own], dense)

    indexed = shard.role == 0
    held = indexed[own]
    known = np.unique(text[held])
    number = np.searchsorted(known, text)
    number[number == len(known)] = 0
    number = np.where(known[number] == text, number + 1, -1) if len(known) else np.full(len(text), -1)
    place = np.cumsum(np.where(indexed, short + 1, 0)) - np.where(indexed, short + 1, 0)
    whole = np.zeros(int(np.where(indexed, short + 1, 0).sum()), np.int64)
    whole[place[own[held]] + k[held]] = number[held]
    index = FMIndex(whole, size)

    asked = np.flatnonzero(~indexed | shard.crowded)
    lengths = short[asked]
    first = np.append(0, np.cumsum(lengths))
    lane = np.repeat(np.arange(len(asked)), lengths)
    offset = np.arange(len(lane)) - first[lane]
    at, lo, hi = matches(index, number[begin[asked][lane] + offset], first, np.where(indexed[asked], 2, 1))
    out = np.zeros(int(shard.windows.sum()), bool)
    if not len(at):
        return out
    # the first occurrence of each interval: intervals of one depth are apart, and the text is in order of places
    spans, which = np.unique(lo, return_inverse=True)
    ends = np.zeros(len(spans), np.int64)
    ends[which] = hi
    count = ends - spans
    rows = np.repeat(spans, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    least = np.minimum.reduceat(index.locate(rows), np.cumsum(count) - count)
    segment = asked[lane[at]]
    # a segment that is not indexed comes after the indexed ones ahead of it
    mine = place[segment] + np.where(indexed[segment], offset[at], 0)
    hit = least[which] < mine
    base = np.cumsum(shard.windows) - shard.windows
    out[base[segment[hit]] + offset[at[hit]]] = True
    return out


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _keep(text: bytes, spans: list[dict] | None) -> tuple:
    words = _WORD.findall(text)
    gone = covered(spans, WINDOW, len(words))
    kept = [w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    rows = keyed(docs)
    return cut(rows, repeated_windows(rows, UNIT, earlier_windows, first=True), _keep, "n_words long, n_removed long, kept_sha256 string")


def op3_fm_index_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Windows as strings; words hold no blank, so joined words are equal only if the sequences are.
OP3_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 0) + 1)) i, ws FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) key FROM s),
f AS (SELECT *, first_value((doc_id, i)) OVER (PARTITION BY key ORDER BY doc_id, i) f FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) i FROM f WHERE f < (doc_id, i)),
p AS (SELECT doc_id, unnest(ws) word, generate_subscripts(ws, 1) i FROM w),
r AS (SELECT p.*, g.i IS NOT NULL gone FROM p LEFT JOIN g USING (doc_id, i)),
a AS (SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) kept FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256
FROM w LEFT JOIN a USING (doc_id)
"""
