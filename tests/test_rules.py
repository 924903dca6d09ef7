"""Rules and graph operators against plain restatements that share no code with the queries' SQL."""

import random

import pytest
from pyspark.sql import functions as F

from tarnflow.functions import arith, text
from tarnflow.operators import flow, grid, rank, resample, tables, workflows


def test_regions_by_first_digit(spark):
    want = {1: "Africa", 2: "Asia", 3: "South America", 4: "North/Central America", 5: "SW Pacific", 6: "Europe"}
    got = {r.k: r.region for r in spark.range(1, 10).select(F.col("id").alias("k"), text.region(F.concat("id", F.lit("42.0"))).alias("region")).collect()}
    assert got == {k: want.get(k, "Unknown") for k in range(1, 10)}


def test_names_of_coordinates_hold_one_of_the_keys(spark):
    names = ["pre", "lat", "latitude", "lon", "longitude", "lon2d", "easting", "northing", "lat_bnds", "time_bnds", "x", "y", "time", "plateau", "L1_soilMoist", "colony", "East"]
    keys = ["lon", "lat", "latitude", "longitude", "easting", "northing", "_bnds"]
    rows = spark.createDataFrame([("f", n, "output", 0.0, 0.0, 0.0, "m") for n in names], "file_name string, variable string, vartype string, min_value double, mean_value double, max_value double, unit string")
    assert {r.variable for r in tables.overview(rows).collect()} == {n for n in names if not any(k in n for k in keys)}


def test_position_in_cuts(spark):
    for n in (0, 1, 2, 7, 100):
        cuts = sorted(random.Random(n).sample(range(1000), n))
        got = {r.id: r.p for r in spark.range(-2, 1002).select("id", arith.position_in("id", cuts, "bigint").alias("p")).collect()}
        assert got == {i: sum(c < i for c in cuts) for i in range(-2, 1002)}


def test_numbered_by_ranges(spark):
    keys = [f"k{i * 7919 % 1000:04d}" for i in range(1000)]
    got = {r.k: r.n for r in rank.numbered(spark.createDataFrame([(k,) for k in keys], "k string").repartition(7), "k", "n").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_surrogate_ids(spark):
    rows = [("7",), ("07",), ("G1",), ("12",), ("A",), (None,), ("7",)]
    got = {r.id: r.numeric_id for r in workflows.surrogate_ids(spark.createDataFrame(rows, "id string")).collect()}
    # '07' comes first of the two spellings of 7; the others follow on from 12 in order of text
    assert got == {"07": 7, "12": 12, None: 13, "7": 14, "A": 15, "G1": 16}


def forest(n, seed):
    rng = random.Random(seed)
    return {i: (None if i % 50 == 0 else rng.randrange(max(0, i - 6), i)) for i in range(n)}


def upstream(down):
    out = {c: {c} for c in down}
    for c in down:
        p = down[c]
        while p is not None:
            out[p].add(c)
            p = down[p]
    return out


def test_tours_hold_what_drains_through_a_cell(spark):
    for down in (forest(200, 1), {i: i - 1 if i else None for i in range(150)}):
        f = spark.createDataFrame(list(down.items()), "cell long, down long")
        rows = {r.cell: (r.outlet, r.at, r["size"]) for r in flow.tour(f).collect()}
        for c, cells in upstream(down).items():
            root, at, size = rows[c]
            assert {x for x, (o, p, _) in rows.items() if o == root and at <= p < at + size} == cells


def test_snap_by_shape_on_a_long_river_and_a_forest(spark):
    for seed, down in ((3, forest(160, 2)), (4, {i: i - 1 if i else None for i in range(120)})):
        rng = random.Random(seed)
        up = upstream(down)
        f = spark.createDataFrame(list(down.items()), "cell long, down long")
        ids, shapes, cands, areas = range(6), [], [], []
        for i in ids:
            top = rng.randrange(len(down))
            shape = {c for c in up[top] if rng.random() < 0.8} | {top}
            shapes += [(i, c) for c in shape]
            areas.append((i, float(len(shape))))
            cands += [(i, c, abs(c - top)) for c in range(max(0, top - 4), min(len(down), top + 5))]
        naive = [(i, rng.randrange(len(down))) for i in ids]
        of = lambda i: {c for j, c in shapes if j == i}
        iou = lambda i, c: len(up[c] & of(i)) / len(up[c] | of(i))
        score = lambda i, c: (((1 - min(len(up[c]), len(of(i))) / max(len(up[c]), len(of(i)))) ** 2 + (1 - iou(i, c)) ** 2) / 2) ** 0.5
        best = {i: min((round(score(i, c), 9), d, c) for j, c, d in cands if j == i) for i in ids}
        want = {i: (c, s) for i, (s, _, c) in best.items() if s <= 0.7}
        args = (spark.createDataFrame(areas, "id long, area double"), f, flow.accumulate(f), spark.createDataFrame(shapes, "id long, cell long"), spark.createDataFrame(cands, "id long, cell long, distance long"), 0.7)
        got = {r.id: (r.cell, round(r.score, 9)) for r in flow.snap_by_shape(*args).collect()}
        assert got == want
        kept = {r.id: r.cell for r in flow.snap_by_shape(*args, naive=spark.createDataFrame(naive, "id long, cell long")).collect()}
        assert kept == {i: n if iou(i, n) > iou(i, want[i][0]) else want[i][0] for i, n in naive if i in want}


def test_looking_ahead_takes_one_pass(spark):
    """No frame reaches to the end of its partition: such a frame is computed anew for each row."""
    ts = spark.createDataFrame([(1, "2001-01-01", 1.0), (1, "2001-01-09", 2.0)], "id long, t string, value double").withColumn("t", F.to_timestamp_ntz("t"))
    axis = spark.range(10).select(F.col("id").alias("i"), F.col("id").cast("double").alias("c"))
    cells = spark.range(9).select(F.lit(1).alias("s"), F.floor(F.col("id") / 3).alias("yi"), (F.col("id") % 3).alias("xi"), F.when(F.col("id") % 2 == 0, 1.0).alias("value"))
    for df in (resample.to_finer(ts, ["id"], "D", "value"), grid.nearest_axis(axis, axis), grid.bracket_axis(axis, axis), grid.fill_nearest(cells, ["s"])):
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    long = spark.range(60_000).select(F.col("id").alias("i"), F.col("id").cast("double").alias("c"))
    assert grid.nearest_axis(long, long).filter("ti <> si").count() == 0


@pytest.mark.parametrize("keys", [["s"], ["s", "v"]])
def test_fill_nearest_with_several_keys(spark, keys):
    rng = random.Random(9)
    rows = [(s, v, y, x, rng.random() if rng.random() < 0.3 else None) for s in range(2) for v in range(2) for y in range(6) for x in range(7)]
    rows = [r for r in rows if keys == ["s", "v"] or r[1] == 0]
    df = spark.createDataFrame(rows, "s long, v long, yi long, xi long, value double")
    got = {(r.s, r.v, r.yi, r.xi): r.value for r in grid.fill_nearest(df, keys).collect()}
    for s, v, y, x, value in rows:
        valid = [((y - b) ** 2 + (x - c) ** 2, b, c, w) for a, u, b, c, w in rows if a == s and u == v and w is not None]
        assert got[s, v, y, x] == (value if value is not None else min(valid)[3])


def test_units_as_words(spark):
    from tarnflow.functions import units

    cases = {"mm/d": ("d", "mm/s"), "mm d-1": ("d", "mm s-1"), "kg m-2 s-1": ("s", "kg m-2 s-1"), "mm / day": ("d", "mm / s"), "m3 sec^-1": ("s", "m3 s^-1"), "mm month - 1": ("month", "mm s-1"), "mm/yr": ("y", "mm/s"), "mm": (None, "mm"), "m3": (None, "m3"), "degC": (None, "degC"), "mm days-1": ("d", "mm s-1")}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: (r.code, r.renamed.replace(" / ", "/").replace(" /", "/"), r.v) for r in df.select("u", units.rate_code(F.col("u")).alias("code"), units.rebase_rate(F.lit(1.0), F.col("u"), "s")[1].alias("renamed"), units.rebase_rate(F.lit(1.0), F.col("u"), "s")[0].alias("v")).collect()}
    for u, (code, renamed) in cases.items():
        assert got[u][0] == code, u
        if code:
            assert got[u][1].replace(" ", "") == renamed.replace(" ", ""), u
            assert got[u][2] == pytest.approx(1 / units.SECONDS[code])
    told = [("mm", None, None, False), ("mm/s", None, None, True), ("K", None, None, True), ("m", "thickness_of_rainfall", "time: mean", True), ("mm", None, "time: sum", False), ("kg m-2 s-1", None, None, True), ("mm d-1", None, None, True), ("W", "heat_flux", None, True), ("kg m-2", "precipitation_amount", None, False), ("", None, None, True)]
    assert [units.is_intensive(u, n, m) for u, n, m, _ in told] == [w for *_, w in told]


def test_shares_of_cells_against_fine_points(spark):
    rng = random.Random(3)
    size, n = 0.5, 8
    cells = spark.createDataFrame([(y, x, 10 - y * size, 20 + x * size) for y in range(n) for x in range(n)], "yi long, xi long, lat double, lon double")
    ring = [(20.3, 7.1), (22.4, 6.8), (23.1, 8.9), (21.9, 8.2), (20.6, 9.7)]
    edges = spark.createDataFrame([(1, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)], "id int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.yi, r.xi): r.share for r in grid.covered_shares(cells, edges, size).collect()}

    def inside(x, y):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                hit = not hit
        return hit

    for y in range(n):
        for x in range(n):
            points = [(20 + x * size - size / 2 + rng.random() * size, 10 - y * size - size / 2 + rng.random() * size) for _ in range(400)]
            assert abs(sum(inside(*p) for p in points) / 400 - got.get((y, x), 0.0)) < 0.11
    shoelace = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    assert sum(got.values()) * size**2 == pytest.approx(shoelace)


def test_netcdf_classic_file_byte_by_byte(spark, tmp_path):
    """A CDF-1 file put together after the format description, with packing, fill values, an unlimited time and ascending latitudes."""
    import struct

    from tarnflow.sources import netcdf

    name = lambda t: struct.pack(">i", len(t)) + t.encode().ljust(-(-len(t) // 4) * 4, b"\0")
    text = lambda k, v: name(k) + struct.pack(">ii", 2, len(v)) + v.encode().ljust(-(-len(v) // 4) * 4, b"\0")
    short = lambda k, v: name(k) + struct.pack(">iihh", 3, 1, v, 0)
    dims = struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0) + name("latitude") + struct.pack(">i", 2) + name("lon") + struct.pack(">i", 3)

    def variables(at):
        out = struct.pack(">ii", 11, 4)
        out += name("latitude") + struct.pack(">ii", 1, 1) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 5, 8, at[0])
        out += name("lon") + struct.pack(">ii", 1, 2) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 5, 12, at[1])
        out += name("time") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 12, 1) + text("units", "days since 2000-02-28 06:00") + struct.pack(">iii", 4, 4, at[2])
        out += name("pre") + struct.pack(">iiii", 3, 0, 1, 2) + struct.pack(">ii", 12, 3) + short("_FillValue", -1) + name("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + short("add_offset", 10)
        return out + struct.pack(">iii", 3, 12, at[3])

    head = b"CDF\x01" + struct.pack(">i", 2) + dims + struct.pack(">ii", 0, 0)
    size = len(head) + len(variables([0] * 4))
    at = [size, size + 8, size + 20, size + 24]
    body = struct.pack(">2f", 10.0, 11.0) + struct.pack(">3f", 5.0, 6.0, 7.0)
    for day, cells in ((0, (1, 2, -1, 4, 5, 6)), (2, (7, 8, 9, 10, -1, 12))):
        body += struct.pack(">i", day) + struct.pack(">6h", *cells)
    path = tmp_path / "pre.nc"
    path.write_bytes(head + variables(at) + body)
    rows = netcdf.read_netcdf(spark, str(path)).collect()
    got = {(str(r.time), r.yi, r.xi): (r.lat, r.lon, r.value) for r in rows}
    assert len(got) == 12 and {r["var"] for r in rows} == {"pre"}
    assert got["2000-02-28 06:00:00", 0, 0] == (11.0, 5.0, 12.0) and got["2000-02-28 06:00:00", 1, 2] == (10.0, 7.0, None)
    assert got["2000-03-01 06:00:00", 0, 1] == (11.0, 6.0, None) and got["2000-03-01 06:00:00", 1, 0] == (10.0, 5.0, 13.5)
    bad = tmp_path / "h.nc"
    bad.write_bytes(b"\x89HDF\r\n\x1a\n")
    with pytest.raises(ValueError, match="HDF5"):
        netcdf.read_layout(str(bad))


def test_netcdf_slabs_and_globs(spark, tmp_path):
    from tarnflow.sources import netcdf

    rows = [(f"2001-0{m}-01", y, x, 50 - y * 0.5, 10 + x * 0.5, None if (y + x + m) % 4 == 0 else float(m * 100 + y * 10 + x)) for m in range(1, 7) for y in range(3) for x in range(4)]
    df = spark.createDataFrame(rows, "t string, yi long, xi long, lat double, lon double, value double").withColumn("t", F.to_timestamp_ntz("t"))
    netcdf.write_netcdf(df.filter("month(t) <= 3"), str(tmp_path / "a.nc"), "pre")
    netcdf.write_netcdf(df.filter("month(t) > 3"), str(tmp_path / "b.nc"), "pre")
    got = netcdf.read_netcdf(spark, str(tmp_path / "*.nc"), "pre", cells=24)
    assert got.rdd.getNumPartitions() == 4
    want = {(str(r.t), r.yi, r.xi): (r.lat, r.lon, r.value) for r in df.collect()}
    assert {(str(r.time), r.yi, r.xi): (r.lat, r.lon, r.value) for r in got.collect()} == want


def test_shared_folder_must_be_given_on_a_cluster(spark):
    from tarnflow import session

    class Conf:
        get = staticmethod(lambda key, default: default)

    class Fake:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Fake)
