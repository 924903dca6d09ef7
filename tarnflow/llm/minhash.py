"""MinHash fingerprints: universal hash permutations over word shingles, in numpy; pairs by signature bands.

A fingerprint is ``PERMS`` slots of 16 bits.  Slot i is the minimum of
``a_i * x + b_i`` (mod 2**64, a_i odd) over the hashes x of the text's distinct
5-word shingles (A-Z lower-cased; a shorter text is one shingle).  The likeness
of two fingerprints is their share of equal slots, an estimate of the Jaccard
similarity of the shingle sets.  Beside each likeness stands the similarity itself, verified on the full sets
(``jaccard_edited``, ``jaccard_next``).  :func:`near_groups` joins bands of the fingerprints and verifies likewise.

Edge cases: a null text is an empty one; texts without words share the
fingerprint of all ones, like only each other; equal doc_ids are ordered by
text, null doc_ids come first; a single document follows itself; very long texts are whole; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import position_in
from . import _lsh
from . import _text as T
from ._store import partitions

PERMS = 128
#: Slots of a band: a pair of similarity 0.8 shares none of the 32 bands with probability 5e-8.
BAND = 4
SHINGLE = 5


def permutations(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of the first m permutations."""
    drawn = np.random.default_rng(128).integers(0, 1 << 63, (m, 2), dtype=np.int64).astype(np.uint64)
    return drawn[:, 0] * np.uint64(2) + np.uint64(1), drawn[:, 1]


def signatures(texts: pa.Array, perms: int = PERMS, shingle: int = SHINGLE) -> np.ndarray:
    """(n, perms) uint16 slots."""
    out = np.full((len(texts), perms), 0xFFFF, np.uint16)
    for piece in T.pieces(texts, 1 << 19):
        out[piece.lo : piece.hi] = fingerprint_slots(*T.shingles(T.tokens(piece, lower=True), shingle), perms)
    return out


def hex_fingerprints(sig: np.ndarray) -> list[str]:
    width = sig.shape[1] * 4
    whole = sig.astype(">u2").tobytes().hex()
    return [whole[i : i + width] for i in range(0, len(whole), width)]


#: Shingle hashes of a text and the text's number in one word, for at most 2**10 texts: 54 bits of the hash, the number above them.
_BITS = np.uint64(54)


def packed_sets(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The distinct shingles of each text, sorted by text."""
    return np.unique((T.segment_ids(first).astype(np.uint64) << _BITS) | (values >> (np.uint64(64) - _BITS)))


def jaccard(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of sets i of x and j of y, pair by pair; of two empty sets 1."""
    n, sides = len(i), []
    for keys, rows in ((x, i), (y, j)):
        number = np.full(1 << 10, -1, np.int64)
        number[rows] = np.arange(n)
        own = number[(keys >> _BITS).astype(np.int64)]
        held = own >= 0
        low = keys[held] & ((np.uint64(1) << _BITS) - np.uint64(1))
        sides.append((own[held].astype(np.uint64) << _BITS) | low)
    every = np.sort(np.concatenate(sides))
    count = lambda keys: np.bincount((keys >> _BITS).astype(np.int64), minlength=n)
    both = count(every[1:][every[1:] == every[:-1]])
    union = count(every) - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hex_fingerprints(signatures(b.column(1))), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def near_groups(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """Bands of the fingerprints joined in Spark, Jaccard verified on the full sets: doc_id, n_shingles, component_id."""
    return _lsh.components(docs, fingerprint_slots, threshold, (BAND, PERMS // BAND))


def fingerprint_slots(values: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """(n, m) slots of shingle sets, those of the fingerprint."""
    a, b = permutations(m)
    out = np.full((len(first) - 1, m), 0xFFFF, np.uint16)
    rows = np.flatnonzero(np.diff(first) > 0)
    if len(rows):
        hashed = np.empty_like(values)
        for i in range(m):
            np.multiply(values, a[i], out=hashed)
            hashed += b[i]
            # a final mix of the minimum: its low 16 bits would else favour small values
            out[rows, i] = T.mix64(np.minimum.reduceat(hashed, first[rows])) >> np.uint64(48)
    return out


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows with a ``bucket``, ``role`` and ``last``: each bucket a run of ascending doc_ids, followed by the
    first row of the next bucket (role 1, only to be looked at; after the last bucket the very first row).

    Bucket bounds are quantiles of doc_id, and only one id a bucket comes to the driver.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    n = buckets or 4 * partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    rows = rows.withColumn("bucket", position_in("key", cuts, "bigint"))
    heads = {r.bucket: r.head for r in rows.groupBy("bucket").agg(F.min("key").alias("head")).collect()}
    order = sorted(heads)
    # a row a bucket
    before = [(heads[b], order[i - 1], int(i == 0)) for i, b in enumerate(order)]
    twice = F.broadcast(spark.createDataFrame(before, "key long, to int, last int"))
    places = F.array(F.struct(F.col("bucket"), F.lit(0).alias("role"), F.lit(0).alias("last")))
    also = F.array(F.struct(F.col("to").alias("bucket"), F.lit(1).alias("role"), F.col("last")))
    placed = rows.join(twice, "key", "left").withColumn("p", F.explode(F.when(F.col("to").isNull(), places).otherwise(F.concat(places, also))))
    spread = placed.select("doc_id", "text", "key", "p.*")
    return spread.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "last", "key", "role", "text")


def edited(text: str, following: str) -> str:
    """The last floor(n/2) characters replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"


def described(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed sets and signatures of a few texts."""
    sets, sig = [], np.full((len(texts), PERMS), 0xFFFF, np.uint16)
    for piece in T.pieces(texts, 1 << 19):
        values, first = T.shingles(T.tokens(piece, lower=True), SHINGLE)
        sets.append(packed_sets(values, first) + (np.uint64(piece.lo) << _BITS))
        sig[piece.lo : piece.hi] = fingerprint_slots(values, first, PERMS)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), sig


#: Rows, and bytes of text, that are taken at once.
_ROWS, _BYTES = 1000, 1 << 22


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lo = 0
        size = np.cumsum(pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        while lo < b.num_rows:
            hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _BYTES, "right"))
            hi = min(max(hi, lo + 1), lo + _ROWS)
            yield b.slice(lo, hi - lo)
            lo = hi


def _fingerprint_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), *((c, pa.float64()) for c in ("near_edited", "near_next", "jaccard_edited", "jaccard_next"))])
    held: list[list] = [[], [], [], []]  # the last row waits for its successor
    for part in _parts(batches):
        ids, texts, buckets, roles = ([*h, *part.column(i).to_pylist()] for i, h in enumerate(held))
        held = [[x[-1]] for x in (ids, texts, buckets, roles)]
        rows = np.array([i for i in range(len(ids) - 1) if roles[i] == 0], np.int64)
        if any(buckets[i] != buckets[i + 1] for i in rows):
            raise ValueError("a document has no successor in its bucket")
        changed = [edited(texts[i], texts[i + 1]) for i in rows]
        (sets, sig), (other_sets, other) = (described(pa.array(x, pa.string())) for x in (texts, changed))
        own, after = sig[rows], sig[rows + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip((
                [ids[i] for i in rows], [len(texts[i]) for i in rows], [hashlib.sha256(x.encode()).hexdigest() for x in changed],
                hex_fingerprints(own), hex_fingerprints(other), likeness(own, other), likeness(own, after),
                jaccard(sets, rows, other_sets, np.arange(len(rows))), jaccard(sets, rows, sets, rows + 1),
            ), schema, strict=True)], schema=schema)
    if held[3] == [0]:
        raise ValueError("the last document of a partition has no successor")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its successor's."""
    return in_order(docs).select("doc_id", "text", "bucket", "role").mapInArrow(_fingerprint_run, _OUT)


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: What SQL can express of the query: doc_id, n_chars, edited_sha256.
OP4_EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
n AS (SELECT *, length(t) n, coalesce(lead(t) OVER w, first_value(t) OVER w) following FROM d WINDOW w AS (ORDER BY doc_id))
SELECT doc_id, CAST(n AS BIGINT) n_chars, sha256(substr(t, 1, n - n // 2) || substr(following, 1, n // 2)) edited_sha256 FROM n
"""
