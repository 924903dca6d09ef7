"""SuperMinHash near-dedup: correlated permutation ranks, early stopping, bands, verification, grouping.

Per element of a set a pseudo-random permutation of the ``m`` slots is drawn step
by step; in step j the element offers ``j + u`` (u uniform in [0, 1)) to its j-th slot.  A
slot keeps the least offer, so the ranks of one element are spread over distinct slots, and
the signature varies less than that of independent permutations.  A set whose slots are all
below j + 1 after step j is finished: later offers are larger (early stopping).

The grouping of candidates is in :mod:`._lsh`; edge cases are stated there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _lsh
from . import _text as T

_STEP = np.uint64(0x9E3779B97F4A7C15)


def superminhash(values: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """(n, m) uint64 slots of the sets ``values[first[i]:first[i+1]]``: step in the high 32 bits, u in the low ones."""
    n = len(first) - 1
    slots = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    own = T.segment_ids(first)
    x = values.copy()
    row = np.arange(len(x))
    perm = None
    for j in range(m):
        if not len(x):
            break
        x = T.mix64(x + _STEP)
        u = x >> np.uint64(32)
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            pos = k
            if m > 1:
                k0 = k
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(x), 1))
                row = np.arange(len(x))
                # the swap of step 0
                perm[row, k0] = 0
            pos = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
        np.minimum.at(slots, own * m + pos, np.uint64(j << 32) | u)
        ids = np.unique(own) if j else np.flatnonzero(np.diff(first))
        open_ = np.zeros(n, bool)
        open_[ids] = slots.reshape(n, m)[ids].max(axis=1) >= np.uint64((j + 1) << 32)
        keep = open_[own]
        if not keep.all():
            x, own, row = x[keep], own[keep], row[keep]
            if j == 0:
                k0 = k0[keep]
    return slots.reshape(n, m)


def near_dedup(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; ``threshold`` in per cent of Jaccard similarity."""
    out = _lsh.components(docs, superminhash, threshold)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_superminhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All pairs that share a shingle, their full sets compared; reachability by recursion.
OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {_lsh.SHINGLE - 1}, 1) + 1)) i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {_lsh.SHINGLE - 1}], ' ')) sh FROM i),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n), 0) n_shingles, min(b) component_id, d.doc_id = min(b) kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
