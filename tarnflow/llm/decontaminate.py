"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits (A-Z lower-cased).  A document holds an item if one
of its windows of the item's length in words (or the whole document, where it is shorter) has a
weighted Jaccard similarity of at least 0.8 with it: over 5-word shingles, weighted by how often
they occur in the window and in the item.

1. One pass over the documents.  Similarity 0.8 needs a known share of a window's shingles to be
   shingles of some item; windows short of that share cannot match and are passed over
   exactly.  Each window left gets a 64-bit SimHash of its weighted shingles.
2. Multi-index Hamming search: fingerprints are cut into 5 blocks of 13 bits (the last has 12).  Two
   fingerprints at most 19 bits apart have a block at most 3 bits apart (pigeonhole), so items are listed
   under every block value within 3 bits of their own, and windows look up their blocks: every pair
   of a window and an item of its length within the radius is found, by an equi-join.
3. Candidates are verified on the full shingle multisets.

The benchmark is a stated query set, taken ``ITEMS`` items at a time; only a block's shingle
hashes, of bounded number, go to the executors with the pass.

Edge cases: null and empty texts and items have no shingles and match nothing; an item
of fewer than 5 words is one shingle; rows that repeat a doc_id are one document; a null
doc_id or item_id is reported as null; very long texts are cut into windows whole, in pieces of bounded size; of windows of equal
similarity (ties) the first is reported; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._runs import rolled
from ._store import materialize

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 5, 13, 3
#: The guaranteed radius: with 20 bits apart, all five blocks could be 4 apart.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Items a pass, and with them the hashes that are sent along (an item of n words has n - 4).
ITEMS = 50_000
NULL_ID = -(2**63)


def item_shingles(texts: pa.Array) -> list[tuple[int, np.ndarray]]:
    """(words, shingle hashes in order) of each text."""
    out = []
    for piece in T.pieces(texts):
        tok = T.tokens(piece, lower=True, alnum=True)
        for a, b in zip(tok.first[:-1], tok.first[1:], strict=True):
            out.append((int(b - a), window_shingles(tok.hashes[a:b])))
    return out


def window_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of a word sequence's 5-grams, of the whole sequence where it is shorter."""
    return rolled(words, min(SHINGLE, len(words))) if len(words) else np.zeros(0, np.uint64)


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each (non-empty) group of shingle hashes; repeated shingles vote as often."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    votes = np.add.reduceat(2 * bits - 1, first, axis=0) > 0
    return np.packbits(votes, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingle hashes."""
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(values)), np.bincount(where[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum()) if len(values) else 0.0


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values if len(known) else np.zeros(len(values), bool)


class Lookup:
    """Membership of hashes in a fixed set: a bitmap, then a search for the few that pass it."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.values >> np.uint64(42)] = True

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[hashes >> np.uint64(42)]) if len(self.values) else np.zeros(0, np.int64)
        found = np.searchsorted(self.values, hashes[at])
        found[found == len(self.values)] = 0
        return at[self.values[found] == hashes[at]] if len(at) else at


def windows_near(hits: np.ndarray, first: np.ndarray, words: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(start, shingles) of all windows of ``words`` words (whole texts, where shorter) that hold enough hits.

    ``hits``: sorted token positions where a shingle of an item starts; ``first``: tokens of the texts.
    """
    n = words - k + 1
    lengths = np.diff(first)
    own = np.searchsorted(first, hits, "right") - 1
    starts, sizes = [], []
    # windows of n shingles: both sides have n, so |A and B| >= 2 n t / (1 + t)
    need = max(1, int(np.ceil(2 * n * least / (1 + least) - 1e-9)))
    if len(hits) >= need:
        a, b = hits[: len(hits) - need + 1], hits[need - 1 :]
        text = own[: len(a)]
        lo = np.maximum(b - n + 1, first[text])
        hi = np.minimum(a, first[text + 1] - words)
        ok = (own[need - 1 :] == text) & (b - a < n) & (lo <= hi)
        lo, hi = lo[ok], hi[ok]
        if len(lo):
            # spans of starts, merged
            count = hi - lo + 1
            s = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            s = np.unique(s)
            starts.append(s)
            sizes.append(np.full(len(s), n))
    # texts shorter than the item: m shingles in all, |A and B| >= t n
    texts, held = np.unique(own, return_counts=True)
    m = np.where(lengths[texts] >= k, lengths[texts] - k + 1, 0)
    short = (lengths[texts] < words) & (m > 0) & (held >= least * n - 1e-9)
    starts.append(first[texts[short]])
    sizes.append(m[short])
    return np.concatenate(starts), np.concatenate(sizes)


def _windows(docs: DataFrame, sizes: dict[int, np.ndarray]) -> DataFrame:
    """doc, words (of the item size), span, start, len, fp of the windows that may match, and for each span (windows that follow on from each other) its shingles; ``sizes``: item shingles by words."""
    of_k = {k: np.concatenate([v for w, v in sizes.items() if min(SHINGLE, w) == k]) for k in sorted({min(SHINGLE, w) for w in sizes})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_k = {k: Lookup(v) for k, v in of_k.items()}
        # sorted once a task
        of_size = {w: np.unique(v) for w, v in sizes.items()}
        for b in batches:
            for piece in T.pieces(b.column(1)):
                tok = T.tokens(piece, lower=True, alnum=True)
                for k, lookup in by_k.items():
                    grams = rolled(tok.hashes, k)
                    hits = lookup.positions(grams)
                    # not those that reach into the next text
                    hits = hits[hits + k <= tok.first[np.searchsorted(tok.first, hits, "right")]]
                    for words in sizes if len(hits) else ():
                        if min(SHINGLE, words) != k:
                            continue
                        own = hits[among(grams[hits], of_size[words])]
                        if not len(own):
                            continue
                        start, n = windows_near(own, tok.first, words, k, THRESHOLD)
                        if not len(start):
                            continue
                        ends = np.cumsum(n)
                        flat = grams[np.repeat(start, n) + np.arange(ends[-1]) - np.repeat(ends - n, n)]
                        text = np.searchsorted(tok.first, start, "right") - 1
                        # windows that follow on from each other share one list of shingles, their span's
                        new = np.ones(len(start), bool)
                        new[1:] = (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1]) | (n[1:] != n[:-1])
                        begin = np.flatnonzero(new)
                        last = np.append(begin[1:], len(start)) - 1
                        own = start - tok.first[text]
                        span = own[begin][np.cumsum(new) - 1]
                        lists = [grams[start[a] : start[z] + n[z]].view(np.int64) for a, z in zip(begin, last, strict=True)]
                        m = len(begin)
                        kept = pa.array([None] * len(start) + lists, pa.list_(pa.int64()))
                        none = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(piece.lo + np.append(text, text[begin]))), pa.array(np.full(len(start) + m, words, np.int32)), pa.array(np.append(span, span[begin])), none(own, pa.int64()),
                             none((n + k - 1).astype(np.int32), pa.int32()), none(simhash(flat, ends - n).view(np.int64), pa.int64()), kept],
                            names=["doc", "words", "span", "start", "len", "fp", "shingles"])

    return docs.mapInArrow(run, "doc long, words int, span long, start long, len int, fp long, shingles array<long>")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each span and item, the similarity of the windows that were found: doc, item, span, found (start, len), shingles, item_shingles, k."""
    schema = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("start", pa.int64()), ("len", pa.int32()), ("similarity", pa.float64())])
    for b in batches:
        out: list[tuple] = []
        for doc, item, span, found, x, y, k in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            x, y = np.array(x, np.int64), np.array(y, np.int64)
            for w in found:
                at = w["start"] - span
                sim = similarity(x[at : at + w["len"] - k + 1], y)
                if sim >= THRESHOLD:
                    out.append((doc, item, w["start"], w["len"], sim))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _block(fp, i: int):
    return F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND((1 << BLOCK_BITS) - 1)


def _matches(docs: DataFrame, items: pa.Table) -> DataFrame:
    spark = docs.sparkSession
    found = [(i, w, s) for i, (w, s) in zip(items["item"].to_pylist(), item_shingles(items["text"]), strict=True) if w]
    schema = "item long, words int, item_fp long, item_shingles array<long>"
    known = pa.table({
        "item": pa.array([i for i, _, _ in found], pa.int64()), "words": pa.array([w for _, w, _ in found], pa.int32()),
        "item_fp": pa.array([int(simhash(s, np.array([0])).view(np.int64)[0]) for _, _, s in found], pa.int64()),
        "item_shingles": pa.array([s.view(np.int64) for _, _, s in found], pa.list_(pa.int64())),
    })
    sizes: dict[int, list[np.ndarray]] = {}
    for _, w, s in found:
        sizes.setdefault(w, []).append(s)
    windows = materialize(_windows(docs, {w: np.concatenate(v) for w, v in sorted(sizes.items())}), "windows")
    held = spark.createDataFrame(known, schema=spark.createDataFrame([], schema).schema)
    masks = [sum(1 << b for b in bits) for r in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), r)]
    listed = held.select("item", "words", "item_fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("item_fp"), i).alias("own")) for i in range(BLOCKS)])).alias("b"))
    listed = listed.select("item", "words", "item_fp", "b.block", F.explode(F.transform(F.lit(masks).cast("array<bigint>"), lambda m: m.bitwiseXOR(F.col("b.own")))).alias("value"))
    asked = windows.filter("fp is not null").select("doc", "words", "span", "start", "len", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias("value")) for i in range(BLOCKS)])).alias("b"))
    asked = asked.select("doc", "words", "span", "start", "len", "fp", "b.block", "b.value")
    # merged, not broadcast: the list has thousands of rows an item, which its estimated size does not show
    near = asked.join(listed.hint("merge"), ["words", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # a row a span and item, however many of the span's windows are near the item
    candidates = near.groupBy("doc", "words", "span", "item").agg(F.collect_set(F.struct("start", "len")).alias("found"))
    spans = windows.filter("fp is null").select("doc", "words", "span", "shingles").dropDuplicates(["doc", "words", "span", "shingles"])
    full = candidates.join(spans, ["doc", "words", "span"]).join(held.select("item", "item_shingles"), "item")
    k = F.least(F.lit(SHINGLE), "words")
    checked = full.select("doc", "item", "span", "found", "shingles", "item_shingles", k.alias("k")).mapInArrow(_verify, "doc long, item long, start long, len int, similarity double")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("from"), "len")).alias("m")
    return checked.groupBy("doc", "item").agg(best).select("doc", "item", "m.similarity", (-F.col("m.from")).alias("start_word"), F.col("m.len").alias("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """(doc_id, item_id) pairs with the best window: similarity, start_word, n_words."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NULL_ID)).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = asked.count()
    passes = max(1, -(-total // items))
    out = None
    for i in range(passes):
        # at most about ``items`` rows, by the count just taken
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == i).toArrow() if passes > 1 else asked.toArrow()
        found = _matches(keyed, part)
        out = found if out is None else out.unionByName(found)
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(back("doc").alias("doc_id"), back("item").alias("item_id"), "similarity", "start_word", "n_words")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
#: Every window of every document that shares a shingle with an item (none else can be similar), compared in full.
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} ws FROM documents), b AS (SELECT item_id, {_WORDS} ws FROM benchmark),
k AS (SELECT item_id, least({SHINGLE}, len(ws)) k, len(ws) n, ws FROM b WHERE len(ws) > 0),
bs AS (SELECT item_id, k, n, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) sh FROM k),
bc AS (SELECT item_id, sh, count(*) c FROM bs GROUP BY ALL),
ds AS (SELECT doc_id, kk.k, unnest(list_transform(range(1, len(ws) - kk.k + 2), lambda i: array_to_string(ws[i:i + kk.k - 1], ' '))) sh FROM d, (SELECT DISTINCT k FROM k) kk),
pairs AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN bs USING (k, sh)),
win AS (SELECT doc_id, item_id, k.n, d.ws, unnest(range(1, greatest(len(d.ws) - k.n + 1, 1) + 1)) s FROM pairs JOIN d USING (doc_id) JOIN k USING (item_id)),
cut AS (SELECT doc_id, item_id, n, s, ws[s:s + n - 1] x FROM win),
sh AS (SELECT doc_id, item_id, n, s, len(x) m, unnest(list_transform(range(1, len(x) - least({SHINGLE}, len(x)) + 2), lambda i: array_to_string(x[i:i + least({SHINGLE}, len(x)) - 1], ' '))) sh FROM cut),
wc AS (SELECT doc_id, item_id, n, s, m, sh, count(*) c FROM sh GROUP BY ALL),
both_ AS (SELECT doc_id, item_id, s, any_value(m) m, sum(least(wc.c, coalesce(bc.c, 0))) o, sum(wc.c) a FROM wc LEFT JOIN bc USING (item_id, sh) GROUP BY doc_id, item_id, s),
tot AS (SELECT item_id, sum(c) t FROM bc GROUP BY item_id),
sim AS (SELECT doc_id, item_id, s, m, o / CAST(a + t - o AS DOUBLE) similarity FROM both_ JOIN tot USING (item_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) r FROM sim WHERE similarity >= {THRESHOLD})
SELECT doc_id, item_id, similarity, s - 1 AS start_word, CAST(m AS INT) n_words FROM top WHERE r = 1
"""
