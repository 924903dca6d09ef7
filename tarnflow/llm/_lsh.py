"""Near-duplicate components: banded signatures, exact verification, union-find.

The plan, for signatures of any kind:

1. One pass over the texts: distinct 5-word shingles (A-Z lower-cased; fewer words: the
   whole sequence as one), a 128-bit key of the set, and its signature in slots of 16 bits.
   Texts with the same set are one *class*, named by its smallest doc_id, so copies cost nothing later.
2. Classes that share a band (``rows`` slots in a row) form a bucket.  ``STARS`` rounds link within buckets
   without writing out their pairs: each picks one pivot a bucket, verifies the
   others that are not in its component yet on full sets, joins the links found into
   components, and leaves the pivot out of the bucket.  That connects large groups of near copies.
3. Of what is left, the nodes of different components are compared by signature inside the tasks that
   hold their bucket (large buckets cut into pairs of blocks).  Nodes whose signatures agree as well as those
   of a linked pair do, up to ``SIGMAS`` standard deviations, are tied together; only a forest of these ties is written out.
4. What is tied together, a cluster, is verified on full sets inside tasks (large clusters cut into pairs of blocks);
   only a forest of the links found is written out.

So every pair that shares a band is judged, or is in one component already: no link is lost but by a pair
that shares no band (probability under ``MISS`` at the threshold itself) or is ``SIGMAS`` deviations off.

Edge cases: null or empty texts and texts without words have no set and link with nothing;
rows that repeat a doc_id are one document (all of its texts count); a null doc_id is an id,
smaller than all others; very long texts are whole, in a batch of their own where they pass its bytes; documents of equal sets
(ties) are one class, which its smallest doc_id stands for; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import materialize, partitions

SHINGLE = 5
MISS = 1e-6
MAX_BANDS = 40
SIGMAS = 6
STARS = 2
#: Members of a bucket, or texts of a cluster, that one task compares with as many others; edges that it joins.
BLOCK = 512
TEXTS = 128
FOREST = 500_000
NULL_ID = -(2**63)
#: Ids up to which they are sent to every executor.
MAX_LOCAL = 500_000
_BYTES = 1 << 19


def shape(threshold: int) -> tuple[int, int]:
    """(rows, bands): the most rows a band for which a pair at the threshold shares none of ``MAX_BANDS`` or fewer with probability under MISS."""
    best = (1, 1)
    for rows in range(1, 30):
        hit = (threshold / 100) ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(MISS) / math.log1p(-hit))
        if bands <= MAX_BANDS:
            best = (rows, bands)
    return best


def _sets(column: pa.Array, limit: int = _BYTES) -> Iterator[tuple[T.Piece, np.ndarray, np.ndarray]]:
    for piece in T.pieces(column, limit):
        yield piece, *T.distinct_per_text(*T.shingles(T.tokens(piece, lower=True), SHINGLE))


def describe(docs: DataFrame, slots: Callable[[np.ndarray, np.ndarray, int], np.ndarray], rows: int, bands: int) -> DataFrame:
    """doc, n (set size), cls1, cls2 (key of the set), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, values, first in _sets(b.column(1)):
                n = np.diff(first)
                cls = []
                for salt in (1, 2):
                    sums = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(T.mix64(values + np.uint64(salt)), out=sums[1:])
                    cls.append((sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)).view(np.int64))
                sig = (T.mix64(slots(values, first, rows * bands)) >> np.uint64(48)).astype("<u2")
                sigs = pa.array([x.tobytes() for x in sig], pa.binary())
                doc = b.column(0).slice(piece.lo, piece.hi - piece.lo)
                yield pa.RecordBatch.from_arrays([doc, pa.array(n), pa.array(cls[0]), pa.array(cls[1]), sigs], names=["doc", "n", "cls1", "cls2", "sig"])

    return _keyed(docs).mapInArrow(run, "doc long, n long, cls1 long, cls2 long, sig binary")


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """(n, bands) hashes of each band's slots and number."""
    parts = sig.reshape(len(sig), -1, rows).astype(np.uint64)
    h = np.zeros(parts.shape[:2], np.uint64) + np.arange(parts.shape[1], dtype=np.uint64)
    for r in range(rows):
        h = T.mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<u2").reshape(len(values), -1) if values else np.zeros((0, 1), "<u2")


def banded(classes: DataFrame, rows: int) -> DataFrame:
    """node, band: a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = band_hashes(_matrix(b.column(1)), rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), h.shape[1])), pa.array(h.view(np.int64).ravel())], names=["node", "band"])

    return classes.select("node", "sig").mapInArrow(run, "node long, band long")


def in_blocks(rows: DataFrame, key: str, size: int, keep: list[str]) -> DataFrame:
    """Groups of ``k`` rows cut into blocks of about ``size``, a copy of each row for every pair of blocks it is in, sorted by (key, x, y)."""
    blocks = rows.withColumn("blocks", F.ceil(F.col("k") / size).cast("int"))
    placed = blocks.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(key, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), *keep)
    keys = [key, "x", "y"]
    return placed.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "node")


def alike(open_: DataFrame, threshold: int, m: int) -> DataFrame:
    """A forest (u, v) of the ties within buckets: different components, signatures that agree well enough; ``open_``: band, k, node, comp, sig (of m slots)."""
    t = threshold / 100
    least = m * t - SIGMAS * math.sqrt(m * t * (1 - t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            node, comp = group["node"].to_numpy(), group["comp"].to_numpy()
            sig = _matrix(group["sig"].combine_chunks())
            u, v = [], []
            for i in range(len(node) - 1):
                others = i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i])
                others = others[(sig[others] == sig[i]).sum(axis=1) >= least]
                u.append(np.full(len(others), node[i]))
                v.append(node[others])
            if u:
                yield _stars(np.concatenate(u), np.concatenate(v))

    return in_blocks(open_, "band", BLOCK, ["node", "comp", "sig"]).mapInArrow(run, "u long, v long")


def links_within(clusters: DataFrame, threshold: int) -> DataFrame:
    """A forest (u, v) of the links within clusters; ``clusters``: cluster, k, node, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            node = group["node"].to_numpy()
            values, first = _sets_of(group["packed"].combine_chunks())
            size = np.diff(first)
            own = T.segment_ids(first)
            _, number, times = np.unique(values, return_inverse=True, return_counts=True)
            shared = times[number] > 1
            number, own = np.unique(number[shared], return_inverse=True)[1], own[shared]
            both = np.zeros((len(node), len(node)))
            order = np.argsort(number, kind="stable")
            number, own = number[order], own[order]
            # counts of common shingles, so many shingles at a time
            for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
                a, b = np.searchsorted(number, (lo, lo + 2048))
                has = np.zeros((len(node), 2048), np.float32)
                has[own[a:b], number[a:b] - lo] = 1
                both += has @ has.T
            linked = (100 * both >= threshold * (size[:, None] + size[None, :] - both)) & (both > 0)
            i, j = np.nonzero(np.triu(linked, 1))
            if len(i):
                yield _stars(node[i], node[j])

    return in_blocks(clusters, "cluster", TEXTS, ["node", "packed"]).mapInArrow(run, "u long, v long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal leading columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and any(held[-1].column(i)[-1].as_py() != key[lo, i] for i in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def packed(rows: DataFrame) -> DataFrame:
    """doc, packed: texts deflated before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(x, 1) for x in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc", "packed"])

    return rows.mapInArrow(run, "doc long, packed binary")


def _sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a few deflated texts, as one piece."""
    texts = pa.array([zlib.decompress(x) for x in column.to_pylist()], pa.binary()).cast(pa.string())
    return next(iter(_sets(texts, 1 << 62)))[1:]


def links(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs (pivot, node), as (u, v), those whose sets have 100 * |intersection| >= threshold * |union|.

    A pivot's nodes are dealt out in groups of about ``BLOCK``, and its text goes once to each group, not to each node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, known = None, np.zeros(0, np.uint64)
        for b in batches:
            lo, size = 0, np.cumsum(pa.compute.binary_length(b.column(4)).to_numpy().astype(np.int64))
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _BYTES, "right")))
                part = b.slice(lo, hi - lo)
                lo = hi
                values, first = _sets_of(part.column(4))
                name, role, node = (part.column(i).to_numpy() for i in (0, 2, 3))
                # stretches of one pivot; each begins with the pivot itself, in this part or in one before
                cuts = [0, *(np.flatnonzero((name[1:] != name[:-1]) | (role[1:] < role[:-1])) + 1), len(name)]
                keep = np.zeros(len(name), bool)
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    if role[s] == 0:
                        pivot, known = name[s], values[first[s] : first[s + 1]]
                        s += 1
                    if s == e or name[s] != pivot:
                        continue
                    own = values[first[s] : first[e]]
                    at = np.searchsorted(known, own)
                    at[at == len(known)] = 0
                    shared = np.append(0, np.cumsum(known[at] == own))
                    both = shared[first[s + 1 : e + 1] - first[s]] - shared[first[s:e] - first[s]]
                    union = len(known) + np.diff(first[s : e + 1]) - both
                    keep[s:e] = (100 * both >= threshold * union) & (both > 0)
                at = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(name[at])], names=["u", "v"])

    spark = pairs.sparkSession
    sized = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"))
    dealt = materialize(pairs.join(sized, "pivot"), "pairs")
    member = dealt.select("pivot", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("group"), F.lit(1).alias("role"), "node")
    heads = dealt.groupBy("pivot").agg(F.max("groups").alias("groups")).select("pivot", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(0).alias("role"), F.col("pivot").alias("node"))
    held = member.unionByName(heads).join(texts.select(F.col("doc").alias("node"), "packed"), "node").select("pivot", "group", "role", "node", "packed")
    ordered = held.repartition(partitions(spark), "pivot", "group").sortWithinPartitions("pivot", "group", "role", "node")
    return ordered.mapInArrow(run, "u long, v long")


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Union-find over edges: each node beside the smallest one it is joined with."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[root[at]])], names=["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a task's edges."""
    edges = [b for b in batches if b.num_rows]
    if edges:
        yield _stars(*(np.concatenate([b.column(i).to_numpy() for b in edges]) for i in range(2)))


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) of all nodes that have an edge (u, v): comp is the smallest node reachable.

    Tasks of at most about ``FOREST`` edges reduce theirs to stars by union-find.  With more than one
    such task, large and small stars alternate: every node is attached to its least neighbour until all
    that is left are stars; rounds grow with the logarithm of a component's diameter, and each ends in a written table.
    """
    edges = materialize(edges.filter("u <> v"), name)
    before = None
    while True:
        tasks = -(-edges.count() // FOREST) or 1
        edges = materialize(edges.coalesce(tasks).mapInArrow(_forest, "u long, v long"), name)
        if tasks == 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = materialize(small.filter("u <> v").distinct(), name)
        # exact arithmetic on all edges: the same sum twice means the same set of stars
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def components(docs: DataFrame, slots: Callable[[np.ndarray, np.ndarray, int], np.ndarray], threshold: int, banding: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``; ``banding``: (rows, bands) other than those of :func:`shape`."""
    rows, bands = banding or shape(threshold)
    sets = materialize(describe(docs, slots, rows, bands), "sets")
    classes = sets.filter("n > 0").groupBy("cls1", "cls2").agg(F.min("doc").alias("node"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")
    held_bands = banded(classes, rows)
    full = materialize(held_bands.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1").drop("k"), "buckets")
    members = materialize(held_bands.join(full, "band"), "members")
    held = members.select("node").distinct()
    held = materialize(held, "held")
    wanted = held.withColumnRenamed("node", "doc")
    # few wanted texts are picked out where they are; many are met by a shuffle
    wanted = F.broadcast(wanted) if held.count() <= MAX_LOCAL else wanted
    texts = materialize(packed(_keyed(docs).join(wanted, "doc", "left_semi")), "texts")

    # rows that repeat a doc_id tie its classes together
    repeated = sets.filter("n > 0").groupBy("doc").agg(F.min("cls1").alias("x"), F.max("cls1").alias("y")).filter("x <> y").select("doc")
    found = sets.drop("sig").join(repeated, "doc").join(classes.drop("sig"), ["cls1", "cls2"]).select(F.col("doc").alias("u"), F.col("node").alias("v"))
    labels = None
    for turn in range(STARS + 1):
        current = members.withColumn("comp", F.col("node"))
        if labels is not None:
            current = members.join(labels, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
        # the pivot: the least id in the first round, then the least by a hash that changes
        current = current.withColumn("rank", F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), "node"))
        per = current.groupBy("band").agg(F.count("*").alias("k"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("rank").alias("pick")).filter("c0 <> c1")
        ranked = current.join(materialize(per.select("band", "k", "pick"), "buckets"), "band")
        if turn == STARS:
            sigs = classes.select("node", "sig").join(held, "node", "left_semi")
            ties = connected(alike(ranked.select("band", "k", "node", "comp").join(sigs, "node"), threshold, rows * bands), "ties").withColumnRenamed("comp", "cluster")
            sizes = materialize(ties.groupBy("cluster").agg(F.count("*").alias("k")), "clusters")
            new = links_within(ties.join(sizes, "cluster").join(texts.withColumnRenamed("doc", "node"), "node"), threshold)
        else:
            ranked = materialize(ranked, "open")
            pivots = ranked.filter("rank = pick").select("band", F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp"))
            star = ranked.join(pivots, "band").filter("comp <> pivot_comp")
            members = ranked.filter("rank <> pick").select("band", "node")
            new = links(star.select("pivot", "node").distinct(), texts, threshold)
        found = materialize(found.unionByName(new), "links")
        labels = connected(found)
    whole = sets.drop("sig").join(classes.drop("sig"), ["cls1", "cls2"], "left").join(labels, "node", "left")
    comp = F.coalesce("comp", "node", "doc")
    back = lambda c: F.when(c != NULL_ID, c)
    return whole.select(back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), back(comp).alias("component_id"))
