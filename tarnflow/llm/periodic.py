"""Runs of periodic words: Main-Lorentz divide and conquer over interned word ids.

A run is a stretch of words with smallest period q, at least ``least`` words and ``times`` periods long, that no neighbouring
word extends.  The words of a text are interned.  Blocks are halved; at each midpoint four Z-functions tell, for every
period, how far the repetition reaches to the left and to the right: those long enough are the crossing ones.  One that could be
extended over the border of its block is a piece of a run that crosses the midpoint of a larger block, and is found there
whole.  Intervals are deduplicated, the smallest period stays.

What keeps this linear in practice, all of it exact: in a run every window of ``least * (times - 2) // times`` words (8 of 24) occurs again, one period
further on or back, so only stretches of windows that recur in the text are divided; and inside a run of period q, runs of
another period are shorter than 2q, so that blocks within it look at 2q words on either side of their midpoint.

A text is divided by the one task that has its row, with memory linear in its length; texts are spread over tasks by Spark, and nothing is shuffled.

Edge cases: a null text is an empty one; texts without runs keep all their words; words are compared as bytes; a very long text is whole; repeated
rows and null ids are answered one by one; equal ones give equal answers (ties); an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _runs
from . import _text as T

#: A run has so many words, and so many periods.
LEAST, TIMES = 24, 3
#: Bytes of text after which a batch of results is handed on.
FLUSH = 4 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def z_function(s: list) -> list[int]:
    """For each position the length of the longest common prefix of ``s`` and what starts there."""
    n = len(s)
    z = [0] * n
    if n == 0:
        return z
    z[0], first = n, s[0]
    i, left, right = 1, 0, 1
    while i < n:
        if i >= right:
            try:
                i = s.index(first, i)
            except ValueError:
                break
            k = 1
        else:
            k = min(z[i - left], right - i)
            if i + k < right:
                z[i] = k
                i += 1
                continue
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
        i += 1
    return z


def crossing(s: list, lo: int, mid: int, hi: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the repetitions in ``s[lo:hi]`` that cross ``mid``, as far as they reach there."""
    u, v = s[lo:mid], s[mid:hi]
    most = (hi - lo) // times
    if not u or not v or not most:
        return
    back, wall = u[::-1], [-1]
    near = v[:most]
    # agreement of what starts at mid with what starts p later, and of what ends before mid with what ends p later
    ahead = z_function(v)
    behind = z_function(back + wall + near[::-1] + back)
    at = len(u) + 1 + len(near)
    for p in range(1, len(near) + 1):
        f, b = (ahead[p] if p < len(v) else 0), behind[at - p]
        if f + b >= (times - 1) * p and f + b + p >= least:
            yield mid - b, mid + p + f, p
    # the same for what starts p before mid, and for what ends p before it
    near = u[-most:]
    ahead = z_function(v + wall + near + v)
    behind = z_function(back)
    at = len(v) + 1 + len(near)
    for p in range(1, len(near) + 1):
        f, b = ahead[at - p], (behind[p] if p < len(back) else 0)
        if f + b >= (times - 1) * p and f + b + p >= least:
            yield mid - p - b, mid + f, p


def divide(s: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a list, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    blocks = [(0, len(s), None)]
    while blocks:
        lo, hi, around = blocks.pop()
        if hi - lo < least:
            continue
        mid = (lo + hi) // 2
        left, right = (lo, hi) if around is None else (max(lo, mid - 2 * around[2]), min(hi, mid + 2 * around[2]))
        covers = [around] if around else []
        for start, end, p in crossing(s, left, mid, right, least, times):
            if (start > 0 and s[start - 1] == s[start - 1 + p]) or (end < len(s) and s[end] == s[end - p]):
                continue
            found[start, end] = min(p, found.get((start, end), p))
            covers.append((start, end, p))
        for a, b in ((lo, mid), (mid, hi)):
            blocks.append((a, b, min((c for c in covers if c[0] <= a and c[1] >= b), key=lambda c: c[2], default=None)))
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def recurring(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches of ids outside of which no run can lie: all their windows of ``k`` ids occur elsewhere too.

    A window that did not recur within its run would leave less than q words on one side and less than q + k on the other: a run shorter than ``least``.
    """
    k = max(1, least * (times - 2) // times)
    grams = _runs.rolled(T.mix64(ids.astype(np.uint64) + np.uint64(1)), k)
    if len(grams) < least - k + 1:
        return []
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    again = np.concatenate([[False], counts[inverse] > 1, [False]])
    edges = np.flatnonzero(again[1:] != again[:-1])
    return [(int(a), int(b) + k - 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a + k - 1 >= least]


def runs_of(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    out = []
    for a, b in recurring(ids, least, times):
        out += [(a + s, e - s, p) for s, e, p in divide(ids[a:b].tolist(), least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run only its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
    return b" ".join(words)


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period), collapsed (the text, each run cut to its first period)."""

    def batch(rows: list) -> pa.RecordBatch:
        ids, counts, runs, texts = zip(*rows, strict=True)
        spans = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], RUNS)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), spans, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for key, text in zip(b.column(0), b.column(1), strict=True):
                # bytes are split at exactly the six blanks that separate words
                words = (text.as_py() or b"").split()
                found = runs_of(words, least, times)
                rows.append((key.as_py(), len(words), found, collapsed(words, found)))
                held += len(rows[-1][3])
                if held > FLUSH:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    least, times = int(least), int(times)
    if times < 3 or least < times:
        raise ValueError("a run has three periods or more, of a word or more")
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def greatest_exponent(runs: Column) -> Column:
    """The run with the greatest exact length / period; the first of equal ones; null without runs."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the documents (by crc32 of doc_id) with their tail made periodic."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = chosen.select("doc_id", "text", "g", F.when(F.col("chosen"), split).alias("words"))
    a = F.col("g") % F.size("words")
    rows = rows.select("doc_id", "text", "words", F.when(F.size("words") > 0, a).alias("a"), F.when(F.size("words") > 0, F.floor((F.size("words") - a) / (3 + F.col("g") % 8)) + 1).alias("p"))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(F.transform("words", word), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    runs, best = F.col("runs"), F.col("best")
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    found = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), greatest_exponent(runs).alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    return found.select(
        "doc_id", "n_runs", best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
