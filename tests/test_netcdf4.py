"""NetCDF-4: files put together byte by byte, pushdown, and the sink that tasks write in parallel."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.sources import hdf5, netcdf

UNDEFINED = b"\xff" * 8
FLOAT = bytes([0x11, 0x21, 0x1F, 0]) + struct.pack("<IHHBBBBI", 4, 0, 32, 23, 8, 0, 23, 127)  # big-endian
SHORT = bytes([0x10, 0x08, 0, 0]) + struct.pack("<IHH", 2, 0, 16)
REF = bytes([0x17, 0, 0, 0]) + struct.pack("<I", 8)
LIST = bytes([0x19, 0, 0, 0]) + struct.pack("<I", 16) + REF


class Builder:
    """A file of the newer kind: superblock 2, headers of version 2, links and attributes in headers or in fractal heaps."""

    def __init__(self):
        self.body = bytearray(hdf5.SIGNATURE + bytes([2, 8, 8, 0]) + bytes(36))

    def put(self, raw):
        at = len(self.body)
        self.body += raw
        return at

    @staticmethod
    def message(kind, raw):
        return struct.pack("<BHB", kind, len(raw), 0) + raw

    def header(self, messages, cut=None):
        """An object header; messages from ``cut`` on stand in a continuation block."""
        first, rest = messages[:cut], messages[cut:] if cut else []
        if rest:
            block = b"OCHK" + b"".join(rest) + bytes(4)
            first = [*first, self.message(16, struct.pack("<QQ", self.put(block), len(block)))]
        area = b"".join(first)
        return self.put(b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(area)) + area + bytes(4))

    @staticmethod
    def space(*shape):
        return struct.pack(f"<BBBB{len(shape)}Q", 2, len(shape), 0, 1 if shape else 0, *shape)

    def attribute(self, name, kind, shape, raw):
        key, space = name.encode() + b"\0", self.space(*shape)
        return struct.pack("<BBHHHB", 3, 0, len(key), len(kind), len(space), 1) + key + kind + space + raw

    def text(self, name, value):
        return self.attribute(name, bytes([0x13, 0, 0, 0]) + struct.pack("<I", len(value)), (), value.encode())

    def heap(self, objects, record, size, indirect=False, deep=False):
        """Objects in a fractal heap and a version 2 B-tree of ``record(heap id)``: (heap, tree) addresses."""
        start, bits, most, largest = 512, 32, 2048, 1024
        wide = bits // 8
        blocks, ids = [bytearray(13 + wide)], []
        for raw in objects:
            if len(blocks[-1]) + len(raw) > start:
                blocks.append(bytearray(13 + wide))
            offset = (len(blocks) - 1) * start + len(blocks[-1])
            ids.append(bytes([0]) + offset.to_bytes(wide, "little") + len(raw).to_bytes(2, "little"))
            blocks[-1] += raw
        assert len(blocks) == 1 or indirect and len(blocks) <= 4  # two rows of two
        places = []
        for i, b in enumerate(blocks):
            b[:13] = b"FHDB" + bytes(9)
            b[13 : 13 + wide] = (i * start).to_bytes(wide, "little")
            places.append(self.put(bytes(b).ljust(start, b"\0")))
        root = places[0]
        if indirect:
            root = self.put(b"FHIB" + bytes(9) + bytes(wide) + b"".join(struct.pack("<Q", p) for p in places) + UNDEFINED * (4 - len(places)) + bytes(4))
        heap = self.put(b"FRHP" + struct.pack("<BHHBI", 0, 7, 0, 0, largest) + bytes(96) + struct.pack("<HQQHHQH", 2, start, most, bits, 1, root, 2 if indirect else 0) + bytes(4))
        records = [record(i) for i in ids]
        node = 512
        if deep:
            half = len(records) // 2
            leaves = [self.put((b"BTLF" + bytes(2) + b"".join(r)).ljust(node, b"\0")) for r in (records[:half], records[half + 1 :])]
            pointers = b"".join(struct.pack("<QB", a, n) for a, n in zip(leaves, (half, len(records) - half - 1), strict=True))
            top = self.put((b"BTIN" + bytes(2) + records[half] + pointers).ljust(node, b"\0"))
            n = 1
        else:
            top, n = self.put((b"BTLF" + bytes(2) + b"".join(records)).ljust(node, b"\0")), len(records)
        tree = self.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, 5, node, size, int(deep), 100, 40, top, n, len(records)) + bytes(4))
        return heap, tree

    def dense_attributes(self, attributes, **how):
        heap, tree = self.heap(attributes, lambda i: i.ljust(8, b"\0") + bytes(9), 17, **how)
        return self.message(21, struct.pack("<BBQQ", 0, 0, heap, tree))

    def finish(self, root):
        self.body[12:48] = struct.pack("<QQQQI", 0, (1 << 64) - 1, len(self.body), root, 0)
        return bytes(self.body)


def chunked_file(dense_links, indirect):
    """time 3 x lat 3 x lon 4 in chunks of 2 x 2 x 3 of 16-bit numbers, one chunk absent, packed, filtered by shuffle, deflate and fletcher32."""
    b = Builder()
    m = b.message
    fill = m(5, struct.pack("<BBIh", 3, 0x2A, 2, -1))
    scale = [b.text("CLASS", "DIMENSION_SCALE"), b.text("NAME", "x")]
    axes = {"time": (np.array([0, 1, 3], ">f4"), [b.text("units", "days since 2000-02-28 06:00")]), "latitude": (np.array([10, 11, 12], ">f4"), [b.text("units", "degrees_north")]), "lon": (np.array([5, 6, 7, 8], ">f4"), [])}
    links = {}
    for name, (values, own) in axes.items():
        raw = values.tobytes()
        layout = m(8, struct.pack("<BBH", 3, 0, len(raw)) + raw) if name == "lon" else m(8, struct.pack("<BBQQ", 3, 1, b.put(raw), len(raw)))
        links[name] = b.header([m(1, b.space(len(values))), m(3, FLOAT), layout, *(m(12, a) for a in scale + own)], cut=2 if name == "time" else None)
    refs = b"".join(struct.pack("<HHIQQ", i + 1, 1, 0, 8, links[n]) for i, n in enumerate(axes))
    heap = b.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(refs) + 16) + refs + bytes(16))
    cells = np.arange(36, dtype="<i2").reshape(3, 3, 4)
    cells[0, 0, 1] = -1
    padded = np.full((4, 4, 6), 99, "<i2")
    padded[:3, :3, :4] = cells
    entries = []
    for t, y, x in [(t, y, x) for t in (0, 2) for y in (0, 2) for x in (0, 3)]:
        if (t, y, x) == (2, 0, 0):
            continue
        raw = padded[t : t + 2, y : y + 2, x : x + 3].tobytes()
        mask = 0
        if (t, y, x) == (0, 2, 3):  # stored without deflate and shuffle
            mask, stored = 3, raw + b"sumx"
        else:
            stored = zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, 2).T.tobytes()) + b"sumx"
        entries.append((struct.pack("<II4Q", len(stored), mask, t, y, x, 0), b.put(stored)))
    last = struct.pack("<II4Q", 0, 0, 4, 4, 6, 0)

    def node(level, children, after):
        return b.put(b"TREE" + struct.pack("<BBH", 1, level, len(children)) + UNDEFINED * 2 + b"".join(k + struct.pack("<Q", a) for k, a in children) + after)

    leaves = [node(0, entries[:4], entries[4][0]), node(0, entries[4:], last)]
    top = node(1, [(entries[0][0], leaves[0]), (entries[4][0], leaves[1])], last)
    filters = struct.pack("<BB", 2, 3) + struct.pack("<HHHI", 2, 1, 1, 2) + struct.pack("<HHHI", 1, 1, 1, 6) + struct.pack("<HHH", 3, 1, 0)
    own = [b.attribute("DIMENSION_LIST", LIST, (3,), b"".join(struct.pack("<IQI", 1, heap, i + 1) for i in range(3))), b.attribute("_FillValue", SHORT, (1,), struct.pack("<h", -1)), b.attribute("scale_factor", FLOAT, (), struct.pack(">f", 0.5)), b.attribute("add_offset", SHORT, (), struct.pack("<h", 10))]
    own += [b.text(f"note{i}", "n" * (20 + i)) for i in range(20 if indirect else 3)]
    links["pre"] = b.header([m(1, b.space(3, 3, 4)), m(3, SHORT), fill, m(8, struct.pack("<BBBQ4I", 3, 2, 4, top, 2, 2, 3, 2)), m(11, filters), b.dense_attributes(own, indirect=indirect, deep=indirect)])
    raws = [struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", a) for n, a in links.items()]
    if dense_links:
        h, tree = b.heap(raws, lambda i: bytes(4) + i, 11)
        root = b.header([m(2, struct.pack("<BBQQ", 0, 0, h, tree)), m(12, b.text("title", "a test"))])
    else:
        root = b.header([m(2, struct.pack("<BB", 0, 0) + UNDEFINED * 2), *(m(6, r) for r in raws)])
    value = np.where(cells == -1, np.nan, cells * 0.5 + 10)
    value[2, 0:2, 0:3] = np.nan
    return b.finish(root), value[:, ::-1]


@pytest.mark.parametrize(("dense", "indirect"), [(False, False), (True, True)])
def test_file_byte_by_byte(spark, tmp_path, dense, indirect):
    raw, want = chunked_file(dense, indirect)
    path = tmp_path / "pre.nc"
    path.write_bytes(raw)
    layout = netcdf.read_layout(str(path))
    assert set(layout.variables) == {"time", "latitude", "lon", "pre"} and layout.attrs == ({"title": "a test"} if dense else {})
    assert layout.names(layout.variables["pre"]) == ["time", "latitude", "lon"] and layout.variables["pre"].attrs["scale_factor"] == 0.5
    assert not indirect or layout.variables["pre"].attrs["note19"] == "n" * 39
    rows = netcdf.read_netcdf(spark, str(path), cells=12).collect()
    got = {(str(r.time), r.yi, r.xi): (r.lat, r.lon, r.value) for r in rows}
    assert len(got) == len(rows) == 36 and {r["var"] for r in rows} == {"pre"}
    for t, day in enumerate(("2000-02-28 06:00:00", "2000-02-29 06:00:00", "2000-03-02 06:00:00")):
        for y in range(3):
            for x in range(4):
                v = want[t, y, x]
                assert got[day, y, x] == (12.0 - y, 5.0 + x, None if np.isnan(v) else v)


def test_a_box_reads_its_chunks_only(tmp_path, monkeypatch):
    raw, _ = chunked_file(False, False)
    (tmp_path / "pre.nc").write_bytes(raw)
    layout = netcdf.read_layout(str(tmp_path / "pre.nc"))
    pre, seen = layout.variables["pre"], []
    decode = hdf5.Dataset._decoded
    monkeypatch.setattr(hdf5.Dataset, "_decoded", lambda self, raw, mask: seen.append(len(raw)) or decode(self, raw, mask))
    assert pre.read(((0, 1), (0, 1), (3, 4))).tolist() == [[[3]]] and len(seen) == 1
    assert pre.read(((2, 3), (0, 1), (0, 1))).tolist() == [[[-1]]] and len(seen) == 1
    assert pre.read(((0, 0), (0, 1), (0, 1))).shape == (0, 1, 1)


def test_what_is_not_read_is_named(tmp_path):
    for raw, words in ((b"\x89HDF\r\n\x1a\n", "superblock"), (b"no such file at all", "no HDF5"), (hdf5.SIGNATURE + bytes([2, 4, 4, 0]) + bytes(60), "addresses")):
        (tmp_path / "bad.nc").write_bytes(raw)
        with pytest.raises(ValueError, match=words):
            netcdf.read_layout(str(tmp_path / "bad.nc"))


@pytest.fixture
def series(spark):
    rows = [(f"2001-{m:02d}-01", y, x, 50 - y * 0.5, 10 + x * 0.5, None if (y + x + m) % 4 == 0 else float(m * 100 + y * 10 + x)) for m in range(1, 13) for y in range(13) for x in range(17) if not (m == 5 and y < 8)]
    return spark.createDataFrame(rows, "t string, yi long, xi long, lat double, lon double, value double").withColumn("t", F.to_timestamp_ntz("t"))


@pytest.mark.parametrize("kind", ["classic", "netcdf4"])
def test_sink_and_scan(spark, tmp_path, series, kind, monkeypatch):
    path = str(tmp_path / "pre.nc")
    monkeypatch.setattr(netcdf, "BLOCK", 60)
    for _ in range(2):  # the second takes the first one's place
        netcdf.write_netcdf(series.repartition(7), path, "pre", {"units": "mm"}, kind=kind, chunk=(2, 8, 8))
    assert [p.name for p in tmp_path.iterdir()] == ["pre.nc"]
    want = {(str(r.t), r.yi, r.xi): r.value for r in series.collect()}
    got = netcdf.read_netcdf(spark, path, "pre", cells=300)
    rows = got.collect()
    assert len(rows) == 12 * 13 * 17 and got.rdd.getNumPartitions() > 4
    assert all(r.value == want.get((str(r.time), r.yi, r.xi)) and r.lat == 50 - r.yi * 0.5 for r in rows)
    some = got.filter("time >= timestamp_ntz'2001-03-01' AND time < timestamp_ntz'2001-04-01' AND lat > 48 AND xi in (1, 2)")
    assert some.count() == 4 * 2 and some.rdd.getNumPartitions() == 1
    assert got.filter("lon > 99").count() == 0 and got.filter("path = 'x'").count() == 0
    one = netcdf.read_layout(path)
    assert one.read("lat_bnds").tolist()[0] == [50.25, 49.75] and one.variables["pre"].attrs["units"] == "mm"


def test_maps_without_time(spark, tmp_path, series):
    flat = series.filter("month(t) = 1").drop("t")
    for kind in ("classic", "netcdf4"):
        path = str(tmp_path / f"{kind}.nc")
        netcdf.write_netcdf(flat, path, "dem", kind=kind, chunk=(1, 5, 6))
        rows = netcdf.read_netcdf(spark, path).collect()
        assert {(r.yi, r.xi): r.value for r in rows} == {(r.yi, r.xi): r.value for r in flat.collect()} and {r.time for r in rows} == {None}


def test_a_failed_write_leaves_nothing(spark, tmp_path, series):
    bad = series.withColumn("value", F.when(F.col("yi") == 12, F.raise_error(F.lit("no value"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no value"):
        netcdf.write_netcdf(bad, str(tmp_path / "pre.nc"), "pre", kind="netcdf4")
    assert not list(tmp_path.iterdir())
    with pytest.raises(ValueError, match="empty"):
        netcdf.write_netcdf(series.limit(0), str(tmp_path / "pre.nc"))


def test_chunk_index_of_several_levels():
    shape, chunk = (200, 80), (2, 2)
    entries = [((t, y), 10_000 + t * 100 + y, 32, 0) for t in range(0, 200, 2) for y in range(0, 80, 2)]
    raw = hdf5.chunk_index(entries, shape, chunk, 64)
    assert len(raw) == hdf5.index_size(shape, chunk)

    class Held:
        path = ""
        bytes = staticmethod(lambda at, n: raw[at - 64 : at - 64 + n])

    data = hdf5.Dataset(Held(), 0, shape, hdf5.Type(8, "<f8"), {}, ("chunked", 64), chunk)
    found = lambda *box: [(o, a) for o, a, _, _ in data.chunks(box)]
    assert found((0, 200), (0, 80)) == [(o, a) for o, a, _, _ in entries]
    assert found((101, 103), (7, 8)) == [((100, 6), 20_006), ((102, 6), 20_206)]


def test_blocks_follow_chunks():
    got = netcdf.blocks(((3, 10), (1, 5), (0, 7)), (2, 4, 8), 64)
    assert sum(np.prod([b - a for a, b in box]) for box in got) == 7 * 4 * 7
    assert all(a % 2 == 0 or a == 3 for (a, _), *_ in got) and len(got) == 4
