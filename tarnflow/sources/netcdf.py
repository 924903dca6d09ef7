"""NetCDF, in the classic formats (CDF-1, CDF-2, CDF-5) and in the HDF5-based one (see :mod:`.hdf5`): a scan to long tables and a sink.

Both are Python data sources.  Of a scan the driver reads headers and axes only; each partition reads its own block of one variable of
one file, a chunk or several, so a file of any length is spread over tasks.  Conditions on path, var, time, lat, lon, yi and xi reach the
source: files, blocks and chunks that cannot fulfil them are not read.  Of a sink the driver writes headers and axes only; blocks
have places that follow from their numbers, so tasks write disjoint stretches of one file, a repeated task the same bytes again,
and the file takes its name when all are done.  Paths are those of a file system that driver and executors mount.
"""

from __future__ import annotations

import datetime
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..session import ship_package
from . import hdf5
from .placed import save_or_clear

#: The format's type numbers as numpy types, and its tags.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: Seconds of the units that times count in.
SECONDS = {"second": 1, "sec": 1, "s": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "h": 3600, "day": 86400, "d": 86400}
#: Cells that a partition aims at, and cells of a batch of rows.
SLAB, ROWS = 2_000_000, 250_000
#: Columns of a scan.
SCHEMA = "path string, var string, time timestamp_ntz, yi long, xi long, lat double, lon double, value double"


@dataclass
class Variable:
    name: str
    dims: list[int]
    attrs: dict
    kind: str
    begin: int


@dataclass
class Layout:
    """What a header says: dimensions (name, length; the record dimension has 0), attributes, variables, number of records."""

    dims: list[tuple[str, int]]
    attrs: dict
    variables: dict[str, Variable]
    records: int
    path: str = ""
    #: bytes from one record to the next
    stride: int = field(default=0)

    def is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.dims[d][1] or self.records for d in v.dims)

    def names(self, v: Variable) -> list[str]:
        return [self.dims[d][0] for d in v.dims]

    def chunk(self, v: Variable) -> tuple[int, ...]:
        """What is read in one go: an entry of the first dimension, a row of the second."""
        return tuple(1 if i < min(2, len(v.dims) - 1) else n for i, n in enumerate(self.shape(v)))

    def read(self, name: str, box: hdf5.Box | None = None) -> np.ndarray:
        """A box of a variable, in native byte order: of each entry of the first dimension the stretch from the first to the last row of the second."""
        v = self.variables[name]
        shape = self.shape(v) or (1,)
        (lo, hi), *rest = box or tuple((0, n) for n in shape)
        kind = np.dtype(v.kind)
        size = int(np.prod(shape[1:])) * kind.itemsize
        row = int(np.prod(shape[2:])) * kind.itemsize
        first, last = rest[0] if rest else (0, 1)
        step = self.stride if self.is_record(v) else size
        whole = step == size and last - first == (shape[1] if rest else 1)
        out = []
        with open(self.path, "rb") as f:
            for r in [lo] if whole else range(lo, hi):
                f.seek(v.begin + r * step + first * row)
                out.append(np.frombuffer(f.read(size * (hi - lo) if whole else (last - first) * row), kind))
        raw = np.concatenate(out) if out else np.zeros(0, kind)
        raw = raw.reshape(max(0, hi - lo), *((last - first, *shape[2:]) if rest else ()))
        return raw[(slice(None), slice(None), *(slice(a, b) for a, b in rest[1:]))[: raw.ndim]].astype(kind.newbyteorder("="))


def _padded(n: int) -> int:
    return -(-n // 4) * 4


class ChunkedLayout:
    """The same of a NetCDF-4 file: its dimensions are the scales that variables refer to, or have the variables' own names."""

    def __init__(self, path: str) -> None:
        self.path, self.file = path, hdf5.File(path)
        self.attrs, self.variables = self.file.attrs, self.file.datasets
        self._of = {d.address: name for name, d in self.variables.items()}
        self.records = 0

    def shape(self, v: hdf5.Dataset) -> tuple[int, ...]:
        return v.shape

    def names(self, v: hdf5.Dataset) -> list[str]:
        refs = v.attrs.get("DIMENSION_LIST")
        if refs:
            return [self._of.get(r[0], "") if r else "" for r in refs]
        return [self._of[v.address]] if len(v.shape) == 1 else [f"dim{i}" for i in range(len(v.shape))]

    def chunk(self, v: hdf5.Dataset) -> tuple[int, ...]:
        return v.chunk or tuple(1 if i == 0 and len(v.shape) > 1 else n for i, n in enumerate(v.shape))

    def read(self, name: str, box: hdf5.Box | None = None) -> np.ndarray:
        return self.variables[name].read(box)


def read_layout(path: str) -> Layout | ChunkedLayout:
    """The header of a file, by its first bytes."""
    with open(path, "rb") as f:
        magic = f.read(8)
    return classic_layout(path) if magic[:3] == b"CDF" else ChunkedLayout(path)


def classic_layout(path: str) -> Layout:
    """The header of a classic file."""
    with open(path, "rb") as f:
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError(f"{path} is no NetCDF file")
        wide, far = magic[3] == 5, magic[3] > 1
        number = lambda: struct.unpack(">q" if wide else ">i", f.read(8 if wide else 4))[0]
        tag = lambda: struct.unpack(">i", f.read(4))[0]

        def name() -> str:
            n = number()
            return f.read(_padded(n))[:n].decode()

        def attributes() -> dict:
            tag()
            out = {}
            for _ in range(number()):
                key, kind, n = name(), np.dtype(TYPES[tag()]), number()
                raw = f.read(_padded(n * kind.itemsize))[: n * kind.itemsize]
                values = np.frombuffer(raw, kind)
                out[key] = raw.decode(errors="replace") if kind.kind == "S" else values[0].item() if n == 1 else values.tolist()
            return out

        records = number()
        tag()
        dims = [(name(), number()) for _ in range(number())]
        attrs = attributes()
        tag()
        variables, stride, sizes = {}, 0, []
        for _ in range(number()):
            key = name()
            ids = [number() for _ in range(number())]
            own = attributes()
            kind = TYPES[tag()]
            number()
            begin = struct.unpack(">q" if far else ">i", f.read(8 if far else 4))[0]
            variables[key] = Variable(key, ids, own, kind, begin)
            if ids and dims[ids[0]][1] == 0:
                sizes.append(int(np.prod([dims[d][1] for d in ids[1:]])) * np.dtype(kind).itemsize)
        # a single record variable is not padded
        stride = sizes[0] if len(sizes) == 1 else sum(map(_padded, sizes))
        if records < 0 and stride:  # a file that was still growing: as many records as it holds
            first = min(v.begin for v in variables.values() if v.dims and dims[v.dims[0]][1] == 0)
            records = (Path(path).stat().st_size - first) // stride
    return Layout(dims, attrs, variables, max(records, 0), path, stride)


def decode_times(values: np.ndarray, units: str, calendar: str = "standard") -> np.ndarray:
    """Numbers ``<unit>s since <date>`` as microseconds of the proleptic Gregorian calendar."""
    if calendar.lower() not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ValueError(f"calendar {calendar!r} has no dates of its own here")
    unit, _, since = units.partition(" since ")
    step = SECONDS.get(unit.strip().lower()) or SECONDS.get(unit.strip().lower().removesuffix("s"))
    if not step or not since:
        raise ValueError(f"cannot read times in {units!r}")
    parts = since.strip().replace("T", " ").removesuffix("Z").split()
    day = [int(x) for x in parts[0].split("-")]
    clock = [float(x) for x in (parts[1].split(":") if len(parts) > 1 else [])] + [0.0] * 3
    start = datetime.datetime(*day) + datetime.timedelta(hours=clock[0], minutes=clock[1], seconds=clock[2])
    origin = int((start - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    return origin + np.rint(values.astype(float) * step * 1e6).astype(np.int64)


def _axes(layout: Layout | ChunkedLayout, v) -> dict[str, int]:
    """Positions of time, lat and lon among a variable's dimensions."""
    from .tables import resolve_axis

    names = layout.names(v)
    attrs = {n: layout.variables[n].attrs for n in names if n in layout.variables}
    found = {a: resolve_axis(names, a, attrs) for a in ("time", "lat", "lon")}
    if not found["lat"] or not found["lon"] or any(len(layout.shape(layout.variables[found[a]])) != 1 if found[a] in layout.variables else True for a in ("lat", "lon")):
        raise ValueError("no one-dimensional latitude and longitude")
    return {a: names.index(n) for a, n in found.items() if n}


def gridded(layout: Layout | ChunkedLayout, var: str | None) -> list[str]:
    """The named variable, or every one with latitude and longitude that is no bound."""
    if var:
        if var not in layout.variables:
            raise ValueError(f"{layout.path} has no variable {var}")
        return [var]
    out = []
    for name, v in layout.variables.items():
        if len(layout.shape(v)) >= 2 and not name.endswith(("_bnds", "_bounds")):
            try:
                _axes(layout, v)
            except ValueError:
                continue
            out.append(name)
    return out


def _axis_values(layout: Layout | ChunkedLayout, var: str, axes: dict[str, int]) -> dict[str, np.ndarray]:
    """Of each entry of an axis: time in microseconds, lat, lon, and yi, xi (row 0 in the north, column 0 in the west)."""
    out = {}
    names = layout.names(layout.variables[var])
    for a, d in axes.items():
        name = names[d]
        if name not in layout.variables:
            continue
        raw, own = layout.read(name), layout.variables[name].attrs
        if a == "time":
            out[a] = decode_times(raw, own["units"], own.get("calendar", "standard"))
            continue
        out[a] = raw.astype(float)
        place = np.empty(len(raw), np.int64)
        place[np.argsort(-out[a] if a == "lat" else out[a], kind="stable")] = np.arange(len(raw))
        out["yi" if a == "lat" else "xi"] = place
    return out


COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
OF_AXIS = {"time": "time", "lat": "lat", "lon": "lon", "yi": "lat", "xi": "lon"}


def _literal(value: object) -> object:
    if isinstance(value, datetime.datetime):
        return int((value.replace(tzinfo=None) - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))
    return value


def holds(condition: Filter, values: np.ndarray) -> np.ndarray:
    if isinstance(condition, In):
        return np.isin(values, [_literal(v) for v in condition.value])
    return COMPARE[type(condition)](values, _literal(condition.value))


@dataclass
class Block(InputPartition):
    path: str
    var: str
    box: hdf5.Box


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = sorted(str(p) for p in (Path("/").glob(options["path"].lstrip("/")) if "*" in options["path"] else [Path(options["path"])]))
        self.var = options.get("var")
        self.cells = int(options.get("cells", SLAB))
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep what is said of axes, files and variables; Spark checks it again, as blocks hold more rows than fulfil it."""
        for f in filters:
            if isinstance(f, (*COMPARE, In)) and f.attribute[0] in (*OF_AXIS, "path", "var"):
                self.conditions.append(f)
            yield f

    def _box(self, layout: Layout | ChunkedLayout, var: str) -> hdf5.Box | None:
        """The least box that holds what fulfils the conditions."""
        v = layout.variables[var]
        axes = _axes(layout, v)
        box = [(0, n) for n in layout.shape(v)]
        said = [c for c in self.conditions if c.attribute[0] in OF_AXIS]
        if said:
            values = _axis_values(layout, var, axes)
            for axis, d in axes.items():
                own = [holds(c, values[c.attribute[0]]) for c in said if OF_AXIS[c.attribute[0]] == axis and c.attribute[0] in values]
                if own:
                    at = np.flatnonzero(np.logical_and.reduce(own))
                    if not len(at):
                        return None
                    box[d] = (int(at[0]), int(at[-1]) + 1)
        return tuple(box)

    def partitions(self) -> list[InputPartition]:
        out = []
        fits = lambda name, value: all(holds(c, np.array([value], object))[0] for c in self.conditions if c.attribute[0] == name)
        for path in self.paths:
            if not fits("path", path):
                continue
            layout = read_layout(path)
            for var in gridded(layout, self.var):
                box = self._box(layout, var) if fits("var", var) else None
                if box:
                    out += [Block(path, var, b) for b in blocks(box, layout.chunk(layout.variables[var]), self.cells)]
        return out

    def read(self, part: Block | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no block at all
            return
        layout = read_layout(part.path)
        v = layout.variables[part.var]
        axes = _axes(layout, v)
        values = _axis_values(layout, part.var, axes)
        data = layout.read(part.var, part.box)
        value = data.astype(float)
        for key in ("_FillValue", "missing_value"):
            for bad in np.atleast_1d(v.attrs.get(key, [])):
                value[data == np.asarray(bad).astype(data.dtype)] = np.nan
        value = (value * float(v.attrs.get("scale_factor", 1)) + float(v.attrs.get("add_offset", 0))).ravel()
        bad = ~np.isfinite(value)
        for lo in range(0, len(value), ROWS):
            cells = np.unravel_index(np.arange(lo, min(lo + ROWS, len(value))), data.shape)
            pick = lambda name: values[name][cells[axes[OF_AXIS[name]]] + part.box[axes[OF_AXIS[name]]][0]]  # noqa: B023, E731
            n = len(cells[0])
            time = pa.array(pick("time"), pa.timestamp("us")) if "time" in values else pa.nulls(n, pa.timestamp("us"))
            const = lambda x: pa.repeat(pa.scalar(x, pa.string()), n)  # noqa: B023, E731
            columns = [const(part.path), const(part.var), time, *(pa.array(pick(c)) for c in ("yi", "xi", "lat", "lon")), pa.array(value[lo : lo + n], mask=bad[lo : lo + n])]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "var", "time", "yi", "xi", "lat", "lon", "value"])


def blocks(box: hdf5.Box, chunk: tuple[int, ...], cells: int) -> list[hdf5.Box]:
    """A box cut at borders of chunks: each block as many chunks as ``cells`` allow, taken from the last dimension on; one at least."""
    side, left = [], cells
    for (lo, hi), c in reversed(list(zip(box, chunk, strict=True))):
        # chunks that the box meets in this dimension, and how many of them a block may have
        most = -(-hi // c) - lo // c
        take = max(1, min(most, left // c))
        side.append(take * c)
        left //= min(take * c, max(1, hi - lo))
    side.reverse()
    cuts = []
    for (lo, hi), s, c in zip(box, side, chunk, strict=True):
        edges = [lo, *range(lo // c * c + s, hi, s), hi]
        cuts.append(list(zip(edges[:-1], edges[1:], strict=True)))
    return [tuple(b) for b in product(*cuts)]


class NetCDF(DataSource):
    """``spark.read.format("netcdf").option("var", ...).load(path or glob)``; option ``cells``: what a partition aims at."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def _register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetCDF)


def read_netcdf(spark: SparkSession, path: str, var: str | None = None, cells: int = SLAB) -> DataFrame:
    """path, var, time, yi, xi, lat, lon, value of one file or a glob, of any of the formats."""
    _register(spark)
    reader = spark.read.format("netcdf").option("cells", cells)
    return (reader.option("var", var) if var else reader).load(path)


def _bytes_of(attrs: dict) -> bytes:
    out = struct.pack(">ii", ATTRIBUTES if attrs else 0, len(attrs))
    for key, value in attrs.items():
        raw, kind, n = (value.encode(), 2, len(value.encode())) if isinstance(value, str) else (struct.pack(">d", value), 6, 1)
        out += _named(key) + struct.pack(">ii", kind, n) + raw.ljust(_padded(len(raw)), b"\0")
    return out


def _named(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">i", len(raw)) + raw.ljust(_padded(len(raw)), b"\0")


def axis_edges(c: np.ndarray) -> np.ndarray:
    """(n, 2) bounds of cells: midpoints, the outer ones as far off as the inner ones, half a unit around a single centre."""
    if len(c) == 1:
        return np.array([[c[0] - 0.5, c[0] + 0.5]])
    mid = (c[1:] + c[:-1]) / 2
    edges = np.concatenate([[2 * c[0] - mid[0]], mid, [2 * c[-1] - mid[-1]]])
    return np.stack([edges[:-1], edges[1:]], axis=1)


#: Entries of an axis up to which it is held by the driver, and rows of a lookup up to which it is broadcast.
AXIS, MAX_LOCAL = 5_000_000, 20_000
EPOCH = datetime.datetime(1900, 1, 1)


class _Writer(DataSourceArrowWriter):
    """Blocks of cells to their places: rows are block, cell, value, sorted by block, and a block's rows are in one task.

    Without ``chunk`` a block is ``rows`` lines of a step, as they lie in a classic file.  With it a block is a chunk, shuffled, deflated
    and written into a slot as long as the chunk is; what a slot does not need stays a hole of the file.
    """

    def __init__(self, options: dict) -> None:
        self.plan = json.loads(options["plan"])

    def _blocks(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        size, fill, own, line = self.plan["size"], self.plan["fill"], None, None
        for b in iterator:
            number, cell, value = (b.column(i) for i in range(3))
            number, cell = number.to_numpy(zero_copy_only=False), cell.fill_null(-1).to_numpy(zero_copy_only=False)
            value = value.fill_null(fill).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(number)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(number)], strict=True):
                if hi > lo:
                    if number[lo] != own:
                        if own is not None:
                            yield own, line
                        own, line = int(number[lo]), np.full(size, fill, "<f8" if self.plan["chunk"] else ">f8")
                    real = cell[lo:hi] >= 0
                    line[cell[lo:hi][real]] = value[lo:hi][real]
        if own is not None:
            yield own, line

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        p, done = self.plan, []
        with open(p["part"], "r+b") as f:
            for number, cells in self._blocks(iterator):
                if p["chunk"]:
                    raw = cells.tobytes()
                    packed = zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, 8).T.tobytes(), p["level"])
                    # a chunk that does not shrink stays as it is: both filters are masked
                    body, mask = (packed, 0) if len(packed) < len(raw) else (raw, 3)
                    f.seek(p["first"] + number * len(raw))
                    f.write(body)
                    done.append((number, len(body), mask))
                else:
                    step, part = divmod(number, p["parts"])
                    lines = min(p["rows"], p["lines"] - part * p["rows"])
                    f.seek(p["first"] + step * p["stride"] + part * p["rows"] * p["width"] * 8)
                    f.write(cells[: lines * p["width"]].tobytes())
            f.flush()
            os.fsync(f.fileno())
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        p = self.plan
        if p["chunk"]:
            shape, chunk = tuple(p["shape"]), tuple(p["chunk"])
            grid = [-(-n // c) for n, c in zip(shape, chunk, strict=True)]
            entries = []
            for number, stored, mask in (d for m in messages if m for d in m.done):
                at = np.unravel_index(number, grid)
                entries.append((tuple(int(a) * c for a, c in zip(at, chunk, strict=True)), p["first"] + number * p["size"] * 8, stored, mask))
            with open(p["part"], "r+b") as f:
                f.seek(p["index"])
                f.write(hdf5.chunk_index(entries, shape, chunk, p["index"]))
        os.replace(p["part"], p["path"])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Path(self.plan["part"]).unlink(missing_ok=True)


@dataclass
class Written(WriterCommitMessage):
    done: list[tuple[int, int, int]]


def _axis(df: DataFrame, key: str, value: str | None = None) -> list:
    """The distinct entries of an axis in order, with a value each: as many as a file has on it."""
    found = df.groupBy(key).agg(F.min(value or key).alias("c")).orderBy(key).limit(AXIS + 1).collect()
    if len(found) > AXIS:
        raise ValueError(f"{key} has more than {AXIS} entries")
    return found


def write_netcdf(
    df: DataFrame, path: str, var: str = "value", attrs: dict | None = None, provenance: dict | None = None, fill: float = -9999.0, kind: str = "classic", chunk: tuple[int, int, int] = (1, 512, 512), level: int = 4
) -> None:
    """One file from ``df`` with yi, xi, lat, lon, value and, for series, time (or t): CDF-2, or with ``kind="netcdf4"`` chunked, shuffled and deflated.

    The driver writes the header with CF attributes, the axes and their bounds; tasks write the blocks.  Cells without a row are missing.
    """
    spark = df.sparkSession
    _register(spark)
    time = next((c for c in ("time", "t") if c in df.columns), None)
    lat, lon = _axis(df, "yi", "lat"), _axis(df, "xi", "lon")
    if not lat:
        raise ValueError("an empty grid cannot be written")
    steps = [r[0] for r in _axis(df, time)] if time else [None]
    shape = (len(steps), len(lat), len(lon))
    head = _netcdf4_head if kind == "netcdf4" else _classic_head
    hours = np.array([(s - EPOCH).total_seconds() / 3600 for s in steps]) if time else None
    raw, plan = head(var, np.array([r.c for r in lat]), np.array([r.c for r in lon]), hours, attrs or {}, provenance or {}, fill, chunk, level)
    plan |= {"path": path, "part": f"{path}.{uuid.uuid4().hex}.part", "fill": fill, "level": level}
    Path(plan["part"]).write_bytes(raw)
    with open(plan["part"], "r+b") as f:
        f.truncate(plan.pop("length"))
        for at, body in plan.pop("records", []):
            f.seek(at)
            f.write(body)
    cells = df.select(*([F.col(time).alias("__t")] if time else []), "yi", "xi", F.col("value").cast("double").alias("value"))
    for key, index, entries in (("__t", "ti", steps if time else None), ("yi", "y", [r[0] for r in lat]), ("xi", "x", [r[0] for r in lon])):
        if entries is None:
            cells = cells.withColumn(index, F.lit(0))
            continue
        table = spark.createDataFrame(list(zip(entries, range(len(entries)), strict=True)), f"`{key}` {dict(cells.dtypes)[key]}, {index} int")
        cells = cells.join(F.broadcast(table) if len(entries) <= MAX_LOCAL else table, key)
    block, cell = _place(plan, shape)
    rows = cells.select(block.cast("long").alias("block"), cell.cast("int").alias("cell"), "value")
    if not plan["chunk"]:
        # every block is written, also where no cell has a row
        rows = rows.unionByName(spark.range(shape[0] * plan["parts"]).select(F.col("id").alias("block"), F.lit(None).cast("int").alias("cell"), F.lit(None).cast("double").alias("value")))
    save_or_clear(rows.repartition("block").sortWithinPartitions("block").write.format("netcdf").option("plan", json.dumps(plan)), path, plan["part"])


def _place(plan: dict, shape: tuple[int, int, int]):
    """Columns of a cell's block, and its number in there."""
    ti, y, x = F.col("ti"), F.col("y"), F.col("x")
    if not plan["chunk"]:
        return ti.cast("long") * plan["parts"] + F.floor(y / plan["rows"]), (y % plan["rows"]) * plan["width"] + x
    sides = plan["chunk"] if len(plan["chunk"]) == 3 else [1, *plan["chunk"]]
    grid = [-(-n // c) for n, c in zip(shape, sides, strict=True)]
    at = [F.floor(i / c).cast("long") for i, c in zip((ti, y, x), sides, strict=True)]
    inner = [i % c for i, c in zip((ti, y, x), sides, strict=True)]
    return (at[0] * grid[1] + at[1]) * grid[2] + at[2], (inner[0] * sides[1] + inner[1]) * sides[2] + inner[2]


def _described(var: str, lat: np.ndarray, lon: np.ndarray, hours: np.ndarray | None, attrs: dict, fill: float) -> dict[str, tuple[list[str], dict]]:
    """Dimensions and attributes of each variable."""
    return {
        "lat": (["lat"], {"standard_name": "latitude", "long_name": "latitude", "units": "degrees_north", "axis": "Y", "bounds": "lat_bnds"}), "lon": (["lon"], {"standard_name": "longitude", "long_name": "longitude", "units": "degrees_east", "axis": "X", "bounds": "lon_bnds"}),
        "lat_bnds": (["lat", "bnds"], {}), "lon_bnds": (["lon", "bnds"], {}),
        **({"time": (["time"], {"standard_name": "time", "long_name": "time", "units": "hours since 1900-01-01 00:00:00", "calendar": "standard", "axis": "T"})} if hours is not None else {}),
        var: ([*(["time"] if hours is not None else []), "lat", "lon"], {"_FillValue": fill, "missing_value": fill, **attrs}),
    }


def _netcdf4_head(var, lat, lon, hours, attrs, provenance, fill, chunk, level) -> tuple[bytes, dict]:
    of = _described(var, lat, lon, hours, attrs, fill)
    values = {"lat": lat, "lon": lon, "lat_bnds": axis_edges(lat), "lon_bnds": axis_edges(lon), "time": hours}
    shape = (*((len(hours),) if hours is not None else ()), len(lat), len(lon))
    sides = tuple(min(c, n) for c, n in zip(chunk[-len(shape) :], shape, strict=True))
    specs = [hdf5.Spec(n, d, values[n].shape, a, values[n]) for n, (d, a) in of.items() if n != var]
    specs.append(hdf5.Spec(var, of[var][0], shape, of[var][1], None, sides, level, fill))
    raw, index, first = hdf5.file_head(specs, {"Conventions": "CF-1.8", **provenance})
    size = int(np.prod(sides))
    slots = int(np.prod([-(-n // c) for n, c in zip(shape, sides, strict=True)]))
    return raw, {"chunk": list(sides), "shape": list(shape), "size": size, "index": index[var], "first": first, "length": first + slots * size * 8}


#: Cells of a block of a classic file.
BLOCK = 1 << 20


def _classic_head(var, lat, lon, hours, attrs, provenance, fill, chunk, level) -> tuple[bytes, dict]:
    of = _described(var, lat, lon, hours, attrs, fill)
    dims = [*([("time", 0)] if hours is not None else []), ("lat", len(lat)), ("lon", len(lon)), ("bnds", 2)]
    at = {n: i for i, (n, _) in enumerate(dims)}
    length = dict(dims)
    size = {n: 8 * int(np.prod([length[d] or 1 for d in ds])) for n, (ds, _) in of.items()}

    def header(begins: dict[str, int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", len(hours) if hours is not None else 0) + struct.pack(">ii", DIMENSIONS, len(dims))
        out += b"".join(_named(n) + struct.pack(">i", k) for n, k in dims) + _bytes_of({"Conventions": "CF-1.8", **provenance}) + struct.pack(">ii", VARIABLES, len(of))
        for n, (ds, own) in of.items():
            out += _named(n) + struct.pack(f">i{len(ds)}i", len(ds), *(at[d] for d in ds)) + _bytes_of(own) + struct.pack(">iiq", 6, min(size[n], 2**31 - 4), begins[n])
        return out

    place = len(header(dict.fromkeys(of, 0)))
    begins = {}
    for n in sorted(of, key=lambda n: "time" in of[n][0]):
        begins[n] = place
        place += size[n]
    stride = size[var] + 8 if hours is not None else 0
    values = {"lat": lat, "lon": lon, "lat_bnds": axis_edges(lat), "lon_bnds": axis_edges(lon)}
    records = [(begins[n], v.astype(">f8").tobytes()) for n, v in values.items()]
    if hours is not None:
        records += [(begins["time"] + k * stride, struct.pack(">d", h)) for k, h in enumerate(hours)]
    rows = max(1, min(len(lat), BLOCK // len(lon)))
    plan = {"chunk": None, "rows": rows, "lines": len(lat), "width": len(lon), "parts": -(-len(lat) // rows), "size": rows * len(lon), "stride": stride, "first": begins[var]}
    steps = len(hours) if hours is not None else 1
    return header(begins), plan | {"records": records, "length": begins[var] + (stride * (steps - 1) if steps else 0) + size[var]}
