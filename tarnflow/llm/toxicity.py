"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms (runs of letters and digits, A-Z lower-cased, and their first
``PREFIX`` bytes), each hashed to one of ``2**BITS`` slots.  The machine scores ``w0 + sum w_t + sum over pairs <v_t, v_u>``
over all slots that at least two texts of the sample have, so it learns that two terms together (an insult
and a group mention) count for more, or less, than each alone, also where neither tells anything alone.

Training is on the driver, on a sample of labelled rows of bounded size (``MAX_TRAIN``, the
least by hash of doc_id).  Linear weights are fitted first; factors then learn from what these leave unexplained.  Both stop where the loss of
a quarter of the sample, set aside, no longer falls; the same quarter sets the bias.  No term is
left out beforehand: sparseness is the penalty's doing.  Scoring is one pass over the documents, with
no shuffle; every whole text is scored.

Edge cases: null and empty texts have no terms and get the score of the bias; several labels
of one doc_id count as their maximum; a null label is no label; a sample with one label only, or without rows,
gives every text the smoothed label rate; repeated rows are answered one by one, texts with equal terms get equal scores (ties); very long texts are whole; an
empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

BITS = 20
PREFIX = 4
FACTORS = 4
MAX_TRAIN = 16_000
#: Training: steps of so many texts at most, the rate, the spread of the factors' random start, the share of rows set aside to tell when to stop.
STEPS, BATCH, RATE, START, ASIDE = 800, 250, 0.5, 0.01, 4
#: A phase ends when so many looks at the rows set aside have not seen a loss lower by a share or an amount, but not before so many steps: factors start slowly.
PATIENCE, GAIN, LEAST = 4, (0.02, 0.001), (20, 120)
#: How far the bias is lowered at most to keep clean rows set aside below the threshold, and how far below (in log odds).
CAUTION, MARGIN = 0.5, 0.25
#: Penalties of the linear weight and of each factor: in units of texts, and of the squared weight.
L1, L2 = (16.0, 10.0), (0.0, 10.0)
THRESHOLD = 0.3


def term_slots(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each piece: its first row, and the distinct slots of each text with their ``first``."""
    for piece in T.pieces(texts, 1 << 19):
        tok = T.tokens(piece, lower=True, alnum=True)
        # the first PREFIX bytes of each longer term are a term as well: inflected and compound words share stems
        stems = T.range_hash(T.prefix_sums(piece.data, lower=True), tok.starts, np.minimum(tok.ends, tok.starts + PREFIX)) if len(tok.starts) else tok.hashes
        both = np.stack([tok.hashes, np.where(tok.ends - tok.starts > PREFIX, T.mix64(stems), tok.hashes)], axis=1).ravel()
        yield piece.lo, *T.distinct_per_text(both >> np.uint64(64 - BITS), tok.first * 2)


@dataclass
class Machine:
    """``index``: of each hash slot, the row in ``linear`` and ``factors``, or -1."""

    bias: float
    index: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = self.index[slots if slots.dtype.kind == "i" else slots.astype(np.int64)]
        rows = T.segment_ids(first)[at >= 0]
        return _raw(self.bias, self.linear, self.factors, at[at >= 0], rows, len(first) - 1)[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 1) -> Machine:
    """``rows``: the distinct slots of each text.

    A first machine learns from three quarters of the rows; the loss of the last quarter tells how many passes linear weights take, and then
    factors, and how far the bias is off for texts that were not learned from.  The machine then learns from all rows, in as many passes, with that bias.
    """
    n, n_pos = len(rows), int(labels.sum())
    prior = (n_pos + 0.5) / (n + 1) if n else 0.1
    empty = Machine(float(np.log(prior / (1 - prior))), np.full(1 << BITS, -1, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < n_pos < n:
        return empty
    # every fourth row of each label
    aside = np.zeros(n, bool)
    rng = np.random.default_rng(seed)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(labels == label))
        aside[own[: len(own) // ASIDE]] = True
    if not 0 < labels[aside].sum() < aside.sum():
        return _learn(rows, labels, (steps // 4, steps // 4), seed, empty)[0]
    pick = lambda keep: [rows[i] for i in np.flatnonzero(keep)]
    held = (pick(aside), labels[aside])
    first, took = _learn(pick(~aside), labels[~aside], (steps // 2, steps // 2), seed, empty, held)
    shift = _shift(_raw_of(first, held[0]), held[1])
    del first
    passes = n / max(1, int((~aside).sum()))
    machine, _ = _learn(rows, labels, tuple(int(np.ceil(t * passes)) for t in took), seed, empty)
    machine.bias += shift
    return machine


def _raw_of(machine: Machine, rows: list[np.ndarray]) -> np.ndarray:
    """The machine's value of each text, ``BATCH`` texts at a time: only their slots are copied."""
    out = np.empty(len(rows))
    for lo in range(0, len(rows), BATCH):
        some = rows[lo : lo + BATCH]
        first = np.zeros(len(some) + 1, np.int64)
        np.cumsum([len(r) for r in some], out=first[1:])
        out[lo : lo + BATCH] = machine.raw(np.concatenate(some), first)
    return out


def _loss(value: np.ndarray, labels: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(labels == 1, -value, value)).mean())


def _shift(value: np.ndarray, labels: np.ndarray) -> float:
    """What the bias lacks: the shift with the least loss, one positive and one negative text of no evidence added.

    To reject a clean text is worse than to keep a toxic one: the shift is lowered, by ``CAUTION`` at most, until no clean text reaches ``THRESHOLD``.
    """
    low, high = -5.0, 5.0
    for _ in range(40):
        mid = (low + high) / 2
        slope = (_sigmoid(value + mid) - labels).sum() + 2 * _sigmoid(mid) - 1
        low, high = (low, mid) if slope > 0 else (mid, high)
    clean = float(np.log(THRESHOLD / (1 - THRESHOLD)) - MARGIN - value[labels == 0].max())
    return min(mid, max(clean, mid - CAUTION))


def _learn(rows: list[np.ndarray], labels: np.ndarray, steps: tuple[int, int], seed: int, empty: Machine, held: tuple | None = None) -> tuple[Machine, tuple[int, int]]:
    """Logistic loss over all slots that two texts have, by follow-the-regularised-leader steps of ``BATCH`` texts: (machine, steps of each phase).

    A step keeps, of each weight, the sum of its gradients and of their squares; the weight is 0 while that sum is within the penalty.
    Factors start at random, since pairs of zeros have no gradient; where nothing was learned, that start is taken off at the end.
    With ``held`` (rows, labels) a phase goes back to where their loss was least.
    """
    n = len(rows)
    # slots are looked up where they lie, a text or a step at a time; no second copy of the sample
    texts_of = np.zeros(1 << BITS, np.int32)
    for r in rows:
        texts_of[r] += 1
    held_slots = np.flatnonzero(texts_of >= 2)
    del texts_of
    m = len(held_slots)
    if not m:
        return empty, (0, 0)
    index = np.full(1 << BITS, -1, np.int32)
    index[held_slots] = np.arange(m)
    del held_slots
    rng = np.random.default_rng(seed)
    # columns: the linear weight, then the factors; z and s hold the sums of gradients and of their squares
    start = np.hstack([np.zeros((m, 1)), rng.normal(0, START, (m, FACTORS))]).astype(np.float32)
    learned, z, s = np.zeros_like(start), np.zeros_like(start), np.zeros_like(start)
    lasso, ridge = (np.array([a, *[b] * FACTORS], np.float32) for a, b in (L1, L2))
    mark, number = np.zeros(m, bool), np.zeros(m, np.int64)
    w0, s0 = empty.bias, 1.0

    def machine() -> Machine:
        # factors that nothing was learned of are noise
        told = (learned[:, 1:] != 0).any(axis=1)
        factors = np.where(told[:, None], start[:, 1:] + learned[:, 1:], 0) if told.any() else np.zeros((m, 0), np.float32)
        return Machine(float(w0), index, learned[:, 0].copy(), factors)

    order, lo = rng.permutation(n), 0
    took = []
    for phase, most in enumerate(steps):
        columns = 1 + (FACTORS if phase else 0)
        best, kept, look, waited = np.inf, None, 0, 0
        for done in range(most + 1):
            if held and (done >= look or done == most):
                now = _loss(_raw_of(machine(), held[0]), held[1])
                waited += 1
                if now < best - max(GAIN[0] * min(best, 1.0), GAIN[1]):
                    waited = 0
                    best, kept = now, (done, w0, s0, *(a[:, :columns].copy() for a in (learned, z, s)))
                if waited >= PATIENCE and done >= LEAST[phase]:
                    break
                look = done + max(3, done // 6)
            if done == most:
                break
            docs = order[lo : lo + BATCH]
            lo += BATCH
            if lo >= n:
                order, lo = rng.permutation(n), 0
            terms = index[np.concatenate([rows[i] for i in docs])]
            row = np.repeat(np.arange(len(docs)), [len(rows[i]) for i in docs])[terms >= 0]
            terms = terms[terms >= 0]
            mark[terms] = True
            touched = np.flatnonzero(mark)
            mark[touched] = False
            k = len(touched)
            number[touched] = np.arange(k)
            terms = number[terms]
            now = learned[touched, :columns]
            weights = start[touched, :columns] + now
            value, sums = _raw(w0, weights[:, 0], weights[:, 1:], terms, row, len(docs))
            err = _sigmoid(value) - labels[docs]
            each = err[row]
            g = np.empty((k, columns), np.float32)
            g[:, 0] = np.bincount(terms, each, k)
            for f in range(1, columns):
                g[:, f] = np.bincount(terms, each * sums[row, f - 1], k) - weights[:, f] * g[:, 0]
            before = s[touched, :columns]
            after = before + g**2
            total = z[touched, :columns] + g - (np.sqrt(after) - np.sqrt(before)) / RATE * now
            z[touched, :columns], s[touched, :columns] = total, after
            learned[touched, :columns] = -np.sign(total) * np.maximum(np.abs(total) - lasso[:columns], 0) / ((1 + np.sqrt(after)) / RATE + ridge[:columns])
            s0 += err.sum() ** 2
            w0 -= RATE * err.sum() / np.sqrt(s0)
        if kept:
            done, w0, s0, learned[:, :columns], z[:, :columns], s[:, :columns] = kept
        took.append(done)
    return machine(), tuple(took)


def _raw(w0: float, w: np.ndarray, v: np.ndarray, terms: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value of each text, and its sums of factors."""
    out = w0 + np.bincount(row, w[terms], n)
    if not v.shape[1] or not v.any():
        return out, np.zeros((n, v.shape[1]))
    sums = np.stack([np.bincount(row, np.ascontiguousarray(v[:, f])[terms], n) for f in range(v.shape[1])], axis=1)
    return out + 0.5 * ((sums**2).sum(axis=1) - np.bincount(row, (v**2).sum(axis=1)[terms], n)), sums


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """Fit on at most ``max_train`` labelled documents that are not held out."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # at most max_train rows: small enough to send to every executor
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(slots[first[i] : first[i + 1]]) for _, slots, first in term_slots(b.column(2)) for i in range(len(first) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype(np.int32).tobytes() for x in found], pa.binary())], names=["doc_id", "toxic", "slots"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, slots binary")
    # one row a doc_id, should rows repeat it: the least text
    rows = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("slots").alias("slots")).toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    toxic = rows["toxic"].to_numpy()[order].astype(float)
    # views of the table's own memory
    slots = [np.frombuffer(x.as_buffer(), np.int32) for x in rows["slots"]]
    machine = fit([slots[i] for i in order], toxic)
    # Arrow keeps freed memory for later tables; there are none
    del rows, slots
    pa.default_memory_pool().release_unused()
    return machine


def score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` plus the score, 0 to 1."""
    at = docs.columns.index("text")
    cols = [c for c in docs.columns if c != name]
    schema = docs.select(*cols).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, slots, first in term_slots(b.column(at)):
                out[lo : lo + len(first) - 1] = _sigmoid(machine.raw(slots, first))
            kept = [b.column(i) for i, c in enumerate(b.schema.names) if c != name]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], names=[*cols, name])

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
