"""Windows that occur elsewhere: the distributed part of substring dedup, for tokens of any kind.

The question, for windows of ``width`` consecutive tokens of one document: does the same token sequence
also start elsewhere (``first=False``), or earlier, in a smaller doc_id or further ahead in the same document (``first=True``)?

1. One pass over the texts gives runs (see :mod:`._runs`): the hash ``h`` of the anchor, a hash ``seg`` of the whole
   run, its place.  Anchors that occur once drop out; their windows cannot occur elsewhere.
2. Runs with one and the same (h, seg) are a *class*.  Of each class the first and the last occurrence
   stand for all (role 0 and 1), so a group of copies is two rows from here on.
3. The contents of these occurrences are fetched and dealt out by anchor; an index of the shard decides
   which of their windows are marked (``compare``).  Nothing else marks a window.
4. What is marked in the first occurrence holds for the first one, what is marked in the last one for all others of the class.

Steps 1 and 2 only select what goes into which shard.  An anchor with more than ``LARGE`` classes is cut up
once more, by longer anchors within its runs, and at last by whole windows: the same steps with the next of ``Unit.ks``,
so that no task holds a group without bound and an index decides all the same.

Rows are known by (doc, sub): the doc_id, and 0, or a hash of the text where rows repeat a doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _runs as R
from . import _text as T
from ._store import materialize, partitions

NULL_ID = -(2**63)
#: Classes of an anchor that one shard holds at most.
LARGE = 4_000
#: Tokens of a shard, from which on no further anchor joins it.
SHARD = {True: 200_000, False: 3_000_000}


@dataclass(frozen=True)
class Unit:
    """What a token is: a word, or a byte; the window's width; the anchors' lengths, of which the last is the width."""

    words: bool
    width: int
    ks: tuple[int, ...]

    @property
    def symbol(self) -> type:
        return np.uint64 if self.words else np.uint8

    def tokens(self, piece: T.Piece) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, first) of a piece."""
        if self.words:
            tok = T.tokens(piece)
            return tok.hashes, tok.first
        return piece.data, piece.offs

    def runs(self, symbols: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
        """(text, start, count, left, h, seg) of the runs: ``left`` tokens stand before the anchor."""
        k = self.ks[level]
        if self.words:
            sums = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum(symbols * T.powers(len(symbols) + 1)[: len(symbols)], out=sums[1:])
            grams = R.rolled(symbols, k)
        else:
            sums = T.prefix_sums(symbols)
            n = max(0, len(symbols) - k + 1)
            grams = T.mix64((sums[k:] - sums[:n]) * T.powers(len(sums) + 1, "down")[:n])
        text, start, count, anchor = R.runs(grams, first, self.width, k)
        return text, start, count, anchor - start, grams[anchor], T.range_hash(sums, start, start + count + self.width - 1)


def keyed(docs: DataFrame) -> DataFrame:
    """doc, sub, text (null: empty)."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    rows = docs.select(doc.alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    twice = rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc")
    if twice.isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("sub"), "text")
    marked = rows.join(twice.withColumn("again", F.lit(True)), "doc", "left")
    return marked.select("doc", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("sub"), "text")


def all_runs(rows: DataFrame, unit: Unit) -> DataFrame:
    """h, seg, doc, sub, start, count, left: every window of every text is in one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in T.pieces(b.column(2)):
                symbols, first = unit.tokens(piece)
                text, start, count, left, h, seg = unit.runs(symbols, first, 0)
                at = pa.array(piece.lo + text)
                small = [pa.array(x.astype(np.int32)) for x in (start - first[text], count, left)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), b.column(0).take(at), b.column(1).take(at), *small],
                    names=["h", "seg", "doc", "sub", "start", "count", "left"])

    return rows.mapInArrow(run, "h long, seg long, doc long, sub long, start int, count int, left int")


def _place() -> Column:
    return F.struct("doc", "sub", "start")


def classes_of(runs: DataFrame, first: bool) -> DataFrame:
    """h, seg, lo, hi, segs: of each class its first and last place (``hi`` null where there is no second one), and the classes of its anchor.

    Rows that repeat a doc_id and its text are at one place.  They repeat each other, but neither is earlier.
    """
    found = runs.groupBy("h", "seg").agg(F.count("*").alias("n"), F.min(_place()).alias("lo"), F.max(_place()).alias("hi"))
    second = (F.col("n") > 1) if not first else (F.col("lo") < F.col("hi"))
    found = materialize(found.select("h", "seg", "lo", F.when(second, F.col("hi")).alias("hi")), "classes")
    return found.join(materialize(found.groupBy("h").agg(F.count("*").cast("int").alias("segs")), "crowds"), "h")


_CONTENT = pa.schema([("h", pa.int64()), ("seg", pa.int64()), ("role", pa.int32()), ("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("left", pa.int32()), ("segs", pa.int32()), ("data", pa.binary())])
_CONTENT_DDL = "h long, seg long, role int, doc long, sub long, start int, count int, left int, segs int, data binary"


def _roles() -> Column:
    """A row for each occurrence that stands for a class: ``r.role``, and its place ``r.p``."""
    both = F.array(F.struct(F.lit(0).alias("role"), F.col("lo").alias("p")), F.struct(F.lit(1).alias("role"), F.col("hi").alias("p")))
    return F.explode(F.filter(both, lambda x: x["p"].isNotNull())).alias("r")


def contents(rows: DataFrame, need: DataFrame, unit: Unit) -> DataFrame:
    """The tokens of the runs that stand for their classes, as ``data``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([zlib.decompress(x) for x in b.column(2).to_pylist()], pa.binary()).cast(pa.string())
            for piece in T.pieces(texts):
                symbols, first = unit.tokens(piece)
                wanted = b.column(3).slice(piece.lo, piece.hi - piece.lo)
                own = np.repeat(np.arange(piece.lo, piece.hi), np.asarray(pa.compute.list_value_length(wanted)))
                flat = wanted.flatten()
                field = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
                begin = first[own - piece.lo] + field["start"].to_numpy()
                end = begin + field["count"].to_numpy() + unit.width - 1
                data = pa.array([symbols[s:e].tobytes() for s, e in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
                held = field | {"doc": b.column(0).take(pa.array(own)), "sub": b.column(1).take(pa.array(own)), "data": data}
                yield pa.RecordBatch.from_arrays([held[f.name] for f in _CONTENT], schema=_CONTENT)

    return packed(rows).join(need, ["doc", "sub"]).select("doc", "sub", "packed", "wanted").mapInArrow(run, _CONTENT_DDL)


def packed(rows: DataFrame) -> DataFrame:
    """doc, sub, packed: texts deflated before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zlib.compress(x, 1) for x in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc", "sub", "packed"])

    return rows.mapInArrow(run, "doc long, sub long, packed binary")


def _shards(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.Table]:
    """Whole groups of equal h, gathered until they hold SHARD tokens; the input is sorted by h."""
    held: list[pa.RecordBatch] = []
    size, most = 0, SHARD[unit.words] * np.dtype(unit.symbol).itemsize
    for b in batches:
        h = b.column(0).to_numpy()
        sizes = pa.compute.binary_length(b.column("data")).to_numpy()
        lo = 0
        for cut in [*np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)] if len(h) else ():
            new_group = lo > 0 or (held and held[-1].column(0)[-1].as_py() != h[0])
            if new_group and size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(b.slice(lo, cut - lo))
            size += int(sizes[lo:cut].sum())
            lo = cut
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Shard:
    """Segments in order of their places: ``symbols[first[i]:first[i+1]]``, the anchor (of ``k`` tokens, number ``anchor``) at ``left``."""

    symbols: np.ndarray
    first: np.ndarray
    left: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    role: np.ndarray
    #: whether other classes have this anchor as well
    crowded: np.ndarray
    k: int
    width: int


#: Which windows, in order of the segments, are to be marked.
Compare = Callable[[Shard], np.ndarray]


def compare_shards(found: DataFrame, unit: Unit, compare: Compare, level: int) -> DataFrame:
    """h, seg, role, at, count: stretches of windows that ``compare`` marks, counted from the run's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches, unit):
            table = table.combine_chunks().sort_by([("doc", "ascending"), ("sub", "ascending"), ("start", "ascending"), ("role", "ascending")])
            data = table["data"].combine_chunks() if isinstance(table["data"], pa.ChunkedArray) else table["data"]
            if isinstance(data, pa.ChunkedArray):
                data = data.chunk(0)
            symbols = np.frombuffer(b"".join(data.to_pylist()), unit.symbol)
            first = np.append(0, np.cumsum(pa.compute.binary_length(data).to_numpy())) // np.dtype(unit.symbol).itemsize
            windows = table["count"].to_numpy()
            anchor = np.unique(table["h"].to_numpy(), return_inverse=True)[1]
            shard = Shard(symbols, first, table["left"].to_numpy().astype(np.int64), windows, anchor, table["role"].to_numpy(), table["segs"].to_numpy() > 1, unit.ks[level], unit.width)
            at = np.flatnonzero(compare(shard))
            if not len(at):
                continue
            base = np.cumsum(windows) - windows
            own = np.repeat(np.arange(len(windows)), windows)[at]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
            count = np.diff(np.append(np.flatnonzero(new), len(at)))
            own = own[new]
            rows = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [*(table[c].combine_chunks().take(rows) for c in ("h", "seg", "role")), pa.array((at[new] - base[own]).astype(np.int32)), pa.array(count.astype(np.int32))],
                schema=_MARKS)

    n = partitions(found.sparkSession)
    return found.repartition(n, "h").sortWithinPartitions("h").mapInArrow(run, "h long, seg long, role int, at int, count int")


_MARKS = pa.schema([("h", pa.int64()), ("seg", pa.int64()), ("role", pa.int32()), ("at", pa.int32()), ("count", pa.int32())])


def cut_again(found: DataFrame, unit: Unit, level: int) -> DataFrame:
    """The runs of these contents by the next longer anchors: h, seg, doc, sub, start, count, left, data, and ``of`` (h, seg, role, at) what they were cut from."""
    owner = pa.struct([("h", pa.int64()), ("seg", pa.int64()), ("role", pa.int32()), ("at", pa.int32())])
    schema = pa.schema([("h", pa.int64()), ("seg", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("left", pa.int32()), ("data", pa.binary()), ("of", owner)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                raw = part.column("data").to_pylist()
                symbols = np.frombuffer(b"".join(raw), unit.symbol)
                first = np.append(0, np.cumsum([len(x) for x in raw])) // np.dtype(unit.symbol).itemsize
                text, start, count, left, h, seg = unit.runs(symbols, first, level)
                at = (start - first[text]).astype(np.int32)
                col = {c: part.column(c).take(pa.array(text)) for c in ("h", "seg", "role", "doc", "sub", "start")}
                # windows of different outer anchors stay apart
                inner = T.mix64(h + T.mix64(col["h"].to_numpy().view(np.uint64)))
                data = [symbols[s:e].tobytes() for s, e in zip(start.tolist(), (start + count + unit.width - 1).tolist(), strict=True)]
                of = pa.StructArray.from_arrays([col["h"], col["seg"], col["role"], pa.array(at)], fields=list(owner))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(inner.view(np.int64)), pa.array(seg.view(np.int64)), col["doc"], col["sub"], pa.array(col["start"].to_numpy() + at), pa.array(count.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(data, pa.binary()), of],
                    schema=schema)

    ddl = "h long, seg long, doc long, sub long, start int, count int, left int, data binary, of struct<h: long, seg: long, role: int, at: int>"
    return found.mapInArrow(run, ddl)


def _by_class(marks: DataFrame, classes: DataFrame) -> DataFrame:
    """h, seg, lo, and the marks of role 0 and 1 as lists (``m0``, ``m1``)."""
    each = F.struct("at", "count")
    lists = marks.groupBy("h", "seg").agg(*[F.collect_list(F.when(F.col("role") == r, each)).alias(f"m{r}") for r in (0, 1)])
    return lists.join(classes.select("h", "seg", "lo"), ["h", "seg"])


def _of_member() -> Column:
    return F.explode(F.when(_place() == F.col("lo"), F.col("m0")).otherwise(F.col("m1"))).alias("m")


def judged(found: DataFrame, unit: Unit, compare: Compare, first: bool, large: int, level: int = 0) -> DataFrame:
    """The marks (h, seg, role, at, count) of contents."""
    if level == len(unit.ks) - 1:
        return compare_shards(found, unit, compare, level)
    marks = compare_shards(found.filter(F.col("segs") <= large), unit, compare, level)
    many = found.filter(F.col("segs") > large)
    if many.isEmpty():
        return marks
    inner = materialize(cut_again(many, unit, level + 1), "inner-runs")
    classes = materialize(classes_of(inner, first), "inner-classes")
    asked = inner.join(classes.select("h", "seg", "segs", _roles()), ["h", "seg"]).filter(_place() == F.col("r.p"))
    asked = asked.select("h", "seg", "r.role", "doc", "sub", "start", "count", "left", "segs", "data").dropDuplicates(["h", "seg", "role"])
    found = materialize(judged(materialize(asked, "inner-contents"), unit, compare, first, large, level + 1), "inner-marks")
    back = inner.drop("data").join(_by_class(found, classes), ["h", "seg"]).select("of", _of_member())
    return marks.unionByName(back.select("of.h", "of.seg", "of.role", (F.col("of.at") + F.col("m.at")).alias("at"), "m.count"))


def repeated_windows(rows: DataFrame, unit: Unit, compare: Compare, first: bool, large: int = LARGE) -> DataFrame:
    """doc, sub, spans: of each document with repeated windows, the stretches (start, count) of them."""
    runs = all_runs(rows, unit)
    # written first, so that the join deals out both of its sides itself and can split a common anchor's rows
    often = materialize(runs.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "anchors")
    runs = materialize(runs.join(often, "h"), "runs")
    classes = materialize(classes_of(runs.select("h", "seg", "doc", "sub", "start"), first), "classes")
    # a run's length and its anchor's place follow from its class
    shape = runs.groupBy("h", "seg").agg(F.min("count").alias("count"), F.min("left").alias("left"))
    asked = classes.join(shape, ["h", "seg"]).select("h", "seg", "count", "left", "segs", _roles())
    wanted = F.struct("h", "seg", F.col("r.role").alias("role"), F.col("r.p.start").alias("start"), "count", "left", "segs")
    need = asked.groupBy(F.col("r.p.doc").alias("doc"), F.col("r.p.sub").alias("sub")).agg(F.collect_list(wanted).alias("wanted"))
    found = materialize(contents(rows, need, unit), "contents")
    marks = judged(found, unit, compare, first, large)
    told = materialize(_by_class(marks, classes), "marks")
    spans = runs.join(told, ["h", "seg"]).select("doc", "sub", "start", _of_member())
    return spans.groupBy("doc", "sub").agg(F.collect_list(F.struct((F.col("start") + F.col("m.at")).alias("start"), F.col("m.count").alias("count"))).alias("spans"))


def covered(spans: list[dict] | None, width: int, n: int) -> np.ndarray:
    """Which of n tokens a marked window covers."""
    out = np.zeros(n + 1, np.int64)
    if spans:
        start = np.array([s["start"] for s in spans])
        end = start + np.array([s["count"] for s in spans]) + width - 1
        np.add.at(out, start, 1)
        np.add.at(out, end, -1)
    return np.cumsum(out[:n]) > 0


def cut(rows: DataFrame, spans: DataFrame, keep: Callable[[bytes, list[dict] | None], tuple], schema: str) -> DataFrame:
    """``keep(text, spans)`` of each document, beside its doc_id."""
    types = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [keep(zlib.decompress(x), s) for x, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = list(zip(*got, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    fields = [x.split() for x in schema.split(", ")]
    names = [n for n, _ in fields]
    types = [{"long": pa.int64(), "string": pa.string()}[t] for _, t in fields]
    held = packed(rows).join(spans, ["doc", "sub"], "left")
    return held.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "packed", "spans").mapInArrow(run, f"doc_id long, {schema}")
