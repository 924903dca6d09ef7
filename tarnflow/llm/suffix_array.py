"""Substring dedup by suffix arrays, built by grouping suffixes on their Lyndon prefixes.

A byte goes if a 200-byte string that covers it also starts anywhere else, same document included.
:mod:`._repeats` finds the runs of windows that can be equal and shards their contents by anchor.  A shard's suffix array
orders its segments by the bytes from their anchors on, ``STRIDE`` bytes a symbol, so that no byte is left out and each
segment is a few symbols.  Windows are repeated where neighbours in the array have enough bytes in common from
the anchor on, and the same bytes ahead of it.  Every window that goes is marked by the array, copies of whole documents included.

The array (:func:`suffix_array`) is built in two linear passes.  First, suffixes are grouped by their Lyndon prefix (the
longest prefix that is smaller than all its proper suffixes): groups are taken in descending order, and each
hands itself to the parents of its members, the nearest positions before them that start a smaller group (found by
pointers that skip what is done); parents that got it, and got it more often, rise above the rest of
their group.  Second, groups being in order, the suffixes are emitted: an emitted suffix i fixes the next place of
the group of each suffix whose Lyndon prefix ends right before i, which are i - 1 and the chain of its parents.  Nothing
is renamed or sorted recursively.

Edge cases: a null text is an empty one; texts under 200 bytes have no windows; rows that repeat a doc_id are
judged apart (two equal ones each repeat the other); very long texts are whole; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from ._repeats import Shard, Unit, covered, cut, keyed, repeated_windows

WINDOW = 200
UNIT = Unit(words=False, width=WINDOW, ks=(64, 179, WINDOW))


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """(group of each suffix, counted up from the smallest Lyndon prefix; parent of each suffix, or -1)."""
    n = len(text)
    values = sorted(set(text))
    number = {v: g for g, v in enumerate(values)}
    group = [number[v] for v in text]
    members: list[list[int]] = [[] for _ in values]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = [g - 1 for g in range(len(values))]
    above = [g + 1 for g in range(len(values))]
    above[-1] = -1
    #: skip[i]: where to look for the nearest position at or before i that is not done
    skip = list(range(n))
    parent = [-1] * n
    g = len(values) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            skip[i] = i - 1
        got: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and skip[p] != p:
                p = skip[p]
            # shorten the path just walked
            q = i
            while q > p and q >= 0:
                q, skip[q] = skip[q], p
            parent[i] = p
            if p >= 0:
                got[p] = got.get(p, 0) + 1
        rising: dict[int, dict[int, list[int]]] = {}
        for p, times in got.items():
            rising.setdefault(group[p], {}).setdefault(times, []).append(p)
        for old, by_times in rising.items():
            if len(by_times) == 1 and sum(map(len, by_times.values())) == size[old]:
                continue  # all of the group rise alike
            under, over = old, above[old]
            for times in sorted(by_times):
                new, moved = len(size), by_times[times]
                size[old] -= len(moved)
                size.append(len(moved))
                members.append(moved)
                for p in moved:
                    group[p] = new
                below.append(under)
                above.append(over)
                above[under] = new
                if over >= 0:
                    below[over] = new
                under = new
        g = below[g]
    # number the groups upwards
    low = 0
    while below[low] >= 0:
        low = below[low]
    final = [-1] * len(size)
    k, g = 0, low
    while g >= 0:
        if size[g]:
            final[g] = k
            k += 1
        g = above[g]
    return [final[x] for x in group], parent


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if not n:
        return []
    # an end smaller than all symbols
    group, parent = lyndon_groups([*text, min(text) - 1])
    place = [0] * (max(group) + 2)
    for g in group:
        place[g + 1] += 1
    for g in range(1, len(place)):
        place[g] += place[g - 1]
    out = [-1] * (n + 1)
    done = [False] * (n + 1)
    out[0], done[n] = n, True
    for k in range(n + 1):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            done[j] = True
            j = parent[j]
    return out[1:]


#: Bytes that one symbol of the array holds.
STRIDE = 40


def ranked(segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The order of byte strings (rows of a padded matrix, and their lengths), by a suffix array over ``STRIDE`` bytes a symbol."""
    n, width = segments.shape
    blocks = -(-width // STRIDE)
    # a symbol: the bytes, then how many of them there are, so that padding differs from zeros
    table = np.zeros((n, blocks, STRIDE + 1), np.uint8)
    for j in range(blocks):
        part = segments[:, j * STRIDE : (j + 1) * STRIDE]
        table[:, j, : part.shape[1]] = part
        table[:, j, STRIDE] = np.clip(lengths - j * STRIDE, 0, STRIDE) + 1
    there = (np.arange(blocks) * STRIDE < lengths[:, None]) | (np.arange(blocks) == 0)
    symbols = np.unique(table[there].view(f"S{STRIDE + 1}").ravel(), return_inverse=True)[1] + 1
    size = there.sum(axis=1)
    begin = np.cumsum(size + 1) - (size + 1)
    # each string is followed by a 0
    text = np.zeros(int((size + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = symbols
    which = np.full(len(text), -1, np.int64)
    which[begin] = np.arange(n)
    order = which[np.array(suffix_array(text.tolist()), np.int64)]
    return order[order >= 0]


def repeated_anywhere(shard: Shard) -> np.ndarray:
    """Which windows (in order of the segments) also start elsewhere in the shard.

    Segments are put in the order that the suffix array gives to what follows from their anchors on.  A window that starts l
    bytes ahead of its anchor is repeated if its ``width - l`` bytes from the anchor on are those of a neighbour in
    the array, and its l bytes ahead of the anchor are that neighbour's too: intervals of the array by common prefix, divided by what stands ahead.
    """
    begin, end = shard.first[:-1] + shard.left, shard.first[1:]
    length = end - begin
    width, n = shard.width, len(begin)
    flat = np.append(shard.symbols, np.zeros(width, np.uint8))
    after = np.lib.stride_tricks.sliding_window_view(flat, width)[begin].copy()
    after[np.arange(width) >= length[:, None]] = 0
    order = ranked(after, length)
    # bytes that neighbours in the array have in common
    common = np.zeros(n, np.int64)
    for lo in range(1, n, 4096):
        a, b = order[lo - 1 : lo + 4095][: min(4096, n - lo)], order[lo : lo + 4096]
        differ = after[a] != after[b]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[lo : lo + len(b)] = np.minimum(same, np.minimum(length[a], length[b]))
    del after
    left, begin, windows = shard.left[order], begin[order], shard.windows[order]
    base = (np.cumsum(shard.windows) - shard.windows)[order]
    out = np.zeros(int(shard.windows.sum()), bool)
    deepest = int(left.max(initial=0))
    # windows ahead of which nothing differs yet: ``code`` numbers the widest intervals, divided by the bytes ahead
    live = np.arange(n)
    code = np.cumsum(common < width - deepest)
    for l in range(deepest + 1):
        if l:
            there = left[live] >= l
            live, code = live[there], code[there]
            code = code * 256 + shard.symbols[begin[live] - l]
        _, code, times = np.unique(code, return_inverse=True, return_counts=True)
        both = times[code] > 1
        live, code = live[both], code[both]
        if not len(live):
            break
        interval = np.cumsum(common < width - l)[live]
        _, group, times = np.unique(code * (n + 1) + interval, return_inverse=True, return_counts=True)
        hit = live[times[group] > 1]
        out[base[hit] + left[hit] - l] = True
    return out


def _keep(text: bytes, spans: list[dict] | None) -> tuple:
    gone = covered(spans, WINDOW, len(text)) if spans else np.zeros(len(text), bool)
    n_spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if n_spans else text
    return len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = keyed(docs)
    return cut(rows, repeated_windows(rows, UNIT, repeated_anywhere, first=False), _keep, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Bytes as pairs of hexadecimal digits.
OP2_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * WINDOW})) key FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - {WINDOW - 1}, 0))) i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY key) n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i + {WINDOW}) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END new FROM r),
h AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) span FROM g),
s AS (SELECT doc_id, span, min(i) a, max(i) + {WINDOW} b FROM h GROUP BY doc_id, span),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) before FROM s),
k AS (SELECT doc_id, count(*) n_spans, CAST(sum(b - a) AS BIGINT) n_removed, max(b) last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) kept FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
