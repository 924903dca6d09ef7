"""Grids, graphs, tiles, steps and text sources on small inputs."""

import itertools

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import flow, gauges, grid, landcover, resample, tables, tiles
from tarnflow.sources import ascii_grid, series, texts
from tarnflow.sources import tables as source_tables


def cells(spark, matrix):
    return spark.createDataFrame([(y, x, v) for y, row in enumerate(matrix) for x, v in enumerate(row)], "yi long, xi long, value double")


def as_dict(df, value="value"):
    return {(r.yi, r.xi): r[value] for r in df.collect()}


def test_fill_leaves_valid_cells_and_takes_the_nearest(spark):
    got = as_dict(grid.fill_nearest(cells(spark, [[1.0, None, None, None], [None, None, None, 9.0]]).withColumn("t", F.lit(0)), ["t"]))
    assert got[0, 0] == 1.0 and got[1, 3] == 9.0 and got[0, 1] == 1.0 and got[0, 3] == 9.0 and got[1, 0] == 1.0


def test_fill_far_masked_and_empty_steps(spark):
    far = as_dict(grid.fill_nearest(cells(spark, [[5.0] + [None] * 40]).withColumn("t", F.lit(0)), ["t"]))
    assert set(far.values()) == {5.0}
    masked = cells(spark, [[1.0, None, None]]).withColumn("t", F.lit(0)).withColumn("m", (F.col("xi") != 2).cast("int"))
    assert as_dict(grid.fill_nearest(masked, ["t"], mask="m"))[0, 2] is None
    assert set(as_dict(grid.fill_nearest(cells(spark, [[None, None]]).withColumn("t", F.lit(0)), ["t"], default=-1.0)).values()) == {-1.0}


def test_regrid_to_the_same_grid_is_identity(spark):
    g = cells(spark, [[1.0, 2.0, None], [4.0, 5.0, 6.0]]).withColumn("lat", -F.col("yi").cast("double")).withColumn("lon", F.col("xi").cast("double"))
    y, x = grid.axis(g, "yi", "lat"), grid.axis(g, "xi", "lon")
    assert as_dict(grid.regrid_nearest(g, grid.nearest_axis(y, y), grid.nearest_axis(x, x), [], ["value"])) == as_dict(g)
    assert as_dict(grid.regrid_linear(g, grid.bracket_axis(y, y), grid.bracket_axis(x, x), [], "value")) == as_dict(g)


def test_nearest_axis_tolerance(spark):
    fine = spark.createDataFrame([(0, 0.49), (1, 0.74), (2, 0.99), (3, 3.0)], "i long, c double")
    coarse = spark.createDataFrame([(0, 0.0), (1, 1.0)], "i long, c double")
    assert {r.ti: r.si for r in grid.nearest_axis(coarse, fine, 1.0).collect()} == {0: 0, 1: 1, 2: 1}


def test_mask_choice():
    assert grid.choose_mask({"a": 1.0, "b": 0.5, "c": 0.25}, 0.5) == "b"
    assert grid.choose_mask({"a": 1.0, "c": 0.25, "d": 0.1}, 0.5) == "d"
    with pytest.raises(ValueError):
        grid.choose_mask({"a": 1.0}, 0.5)
    assert grid.choose_mask({"a": 1.0}, 0.5, "a") == "a"


def test_empty_masks_and_disjoint_grids_raise(spark):
    g = cells(spark, [[1.0]])
    with pytest.raises(ValueError):
        grid.apply_mask(g, g.select("yi", "xi", F.lit(0).alias("mask")), ["value"])
    with pytest.raises(ValueError):
        grid.crop_to_overlap(g, g.withColumn("xi", F.col("xi") + 5))
    with pytest.raises(ValueError):
        grid.integer_ratio(3.0, 2.0)
    assert grid.resolution_ladder(1.0, 4.0) == {"l0": 1.0, "l1": 4.0, "l11": 4.0, "l2": 4.0}


def test_ascii_round_trip(spark, tmp_path):
    g = ascii_grid.template(spark, ascii_grid.Header(4, 3, 0.5, 10.0, 40.0)).withColumn("value", F.when((F.col("xi") != 1) | (F.col("yi") != 2), F.col("yi") * 10.0 + F.col("xi")))
    path = str(tmp_path / "g.asc")
    head = ascii_grid.write_ascii(g, path)
    assert (head.ncols, head.nrows, head.xllcorner, head.yllcorner) == (4, 3, pytest.approx(10), pytest.approx(40))
    back = source_tables.read_grid(spark, path)
    assert as_dict(back) == as_dict(g) and as_dict(back, "lat") == pytest.approx(as_dict(g, "lat")) and back.first()["var"] == "g"
    assert ascii_grid.read_header(spark, path).ncols == 4
    (tmp_path / "bad.asc").write_text(head.text() + "\n1 2 3 4\n")
    with pytest.raises(Exception, match="do not fit"):
        ascii_grid.read_ascii(spark, str(tmp_path / "bad.asc")).collect()
    with pytest.raises(ValueError):
        source_tables.write_grid(g, str(tmp_path / "x.xyz"))
    with pytest.raises(ValueError):
        ascii_grid.Header(4, 3, 1.0).rescaled(1.5)
    assert ascii_grid.parse_header(["ncols 2", "NROWS 2", "xllcenter 1", "yllcenter 1", "cellsize 2"]).xllcorner == 0


def test_discharge_text(spark, tmp_path):
    p = tmp_path / "daily.out"
    p.write_text(" No Day Mon Year Qobs_0000000398 Qsim_0000000398\n 1 1 1 1990 2.5 3.5\n 2 2 1 1990 -9999. 4.5\n")
    rows = series.read_discharge_text(spark, str(p)).orderBy("t").collect()
    assert [(r.id, r.obs, r.sim) for r in rows] == [(398, 2.5, 3.5), (398, None, 4.5)]


def test_namelist_log_and_csv(spark, tmp_path):
    nml = tmp_path / "a.nml"
    nml.write_text("&x\ndir_Out(1) = 'out!1/' ! note\nLCoverYearStart(1,1) = 1981\nLCoverYearEnd(1,1) = 1990\nLCoverfName(1,1) = 'lc.asc'\nplain = 3.5 ! c\n/\n")
    got = {(r.key, r["index"]): r.value for r in texts.read_namelist(spark, str(nml)).collect()}
    assert got["dir_out", "1"] == "out!1/" and got["plain", None] == "3.5"
    lc = texts.read_landcover_intervals(spark, str(nml)).first()
    assert (lc.year_start, lc.year_end, lc.file) == (1981, 1990, "lc.asc")
    log = tmp_path / "a.log"
    log.write_text("Total[km2] 1.0\nx\nTotal[km2]   11636.25\n")
    assert texts.catchment_area(spark, str(log)) == "11636" and texts.catchment_area(spark, str(log), 3) == "11636.250"
    (tmp_path / "c").mkdir()
    (tmp_path / "c/m.csv").write_text("id,kge,nse\n1,0.5,inf\n2,bad,0.25\n")
    rows = {(r.metric, r.value) for r in texts.read_metric_csv(spark, str(tmp_path / "c"), ["kge", "nse", "none"]).collect()}
    assert rows == {("kge", 0.5), ("nse", 0.25)}


def test_links(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.nc").write_text("1")
    assert texts.link_tree(str(tmp_path / "a"), str(tmp_path / "z"), "*.nc") == 1
    assert texts.link_tree(str(tmp_path / "a"), str(tmp_path / "z"), "*.nc") == 0
    assert (tmp_path / "z/b/x.nc").read_text() == "1"


def test_axis_discovery():
    assert source_tables.resolve_axis(["a", "Northing"], "lat") == "Northing"
    assert source_tables.resolve_axis(["a", "lat"], "lat", {"a": {"axis": "Y"}}) == "a"
    with pytest.raises(ValueError):
        source_tables.resolve_axis(["a", "b"], "lat", {"a": {"axis": "Y"}, "b": {"axis": "Y"}})
    assert source_tables.payload(["lat", "lon", "time_bnds", "pre"]) == "pre"
    assert source_tables.payload(["lat", "pre", "tavg"], "x/tavg.parquet") == "tavg"


def test_flow_doubling_on_a_long_chain(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)], "cell long, down long")
    total = {r.cell: r.total for r in flow.accumulate(df).collect()}
    assert all(total[i] == 100 - i for i in range(100))
    assert {(r.outlet, r.steps) for r in flow.basins(df).collect()} == {(0, i) for i in range(100)}


def test_tiles_cover_and_need_a_mask(spark):
    t = tiles.make_tiles(spark, 0.0, 2.5, 0.0, 3.0, 1.0)
    assert t.count() == 9 and t.agg(F.max("lat1")).first()[0] == 2.5
    with pytest.raises(ValueError):
        tiles.active_tiles(t, spark.createDataFrame([(0.5, 0.5, 0)], "lat double, lon double, mask int"), 0.5, 1.0)
    edge = tiles.active_tiles(t, spark.createDataFrame([(0.5, 0.75, 1)], "lat double, lon double, mask int"), 0.5, 1.0)
    assert [r.tile for r in edge.collect()] == [0]


def test_resample_keeps_totals(spark):
    rows = [(1, f"2001-{m:02d}-01", float(m)) for m in range(1, 7)]
    df = spark.createDataFrame(rows, "k int, t string, v double").withColumn("t", F.to_timestamp_ntz("t"))
    daily = resample.spread_totals(df, ["k"], "D", "v", 730.0, 24.0)
    back = {r.t.month: r.v for r in resample.to_coarser(daily, ["k"], "M", {"v": "sum"}).collect()}
    assert all(back[m] == pytest.approx(m) for m in range(1, 6))
    assert resample.adaptive(df, ["k"], ["v"], "D", None, True) is df


def test_no_overlap_raises(spark):
    df = spark.createDataFrame([("2001-01-01", 1.0), ("2005-01-01", None)], "t string, v double").withColumn("t", F.to_timestamp_ntz("t"))
    late = df.withColumn("t", F.to_timestamp_ntz(F.lit("2009-01-01")))
    with pytest.raises(ValueError, match="1 and 1"):
        resample.crop_to_overlap(df, late, "M", "v", "v")
    assert resample.coarser_of("6h", "h") == "6h" and resample.coarser_of("D", "MS") == "M"


def test_intervals(spark):
    ok = spark.createDataFrame([(1, 1981, 1990), (1, 1991, 2000)], "d int, year_start int, year_end int")
    assert landcover.check_intervals(ok, ["d"]) is ok
    for start, kind in ((1992, "gap"), (1990, "overlap")):
        with pytest.raises(ValueError, match=kind):
            landcover.check_intervals(spark.createDataFrame([(1, 1981, 1990), (1, start, 2000)], ok.schema), ["d"])


def test_nearest_node_equals_brute_force(spark):
    import random

    random.seed(3)
    g = [(i, random.uniform(-30, 30), random.uniform(-30, 30)) for i in range(25)]
    n = [(i, random.uniform(-3, 3), random.uniform(-3, 3)) for i in range(40)]
    got = {r.id: r.node for r in gauges.nearest_node(spark.createDataFrame(g, "id int, x double, y double"), spark.createDataFrame(n, "node int, x double, y double"), 0.5).collect()}
    assert got == {i: min(n, key=lambda m: ((x - m[1]) ** 2 + (y - m[2]) ** 2, m[0]))[0] for i, x, y in g}


def test_groups_and_medians(spark):
    df = spark.createDataFrame([("1", 0.25), ("1.0", 0.75), ("2", 0.1), (None, 5.0)], "id string, kge double")
    assert {r.match_id: r.kge for r in tables.medians_by_id(df, "id", ["kge"]).collect()} == {"1": 0.5, "2": 0.1}
    alone = spark.createDataFrame([(1, None)], "v int, g string")
    assert tables.comparison_groups(alone, "g").first().g == "ungrouped"


def test_polygon_is_a_square(spark):
    grid_ = spark.createDataFrame([(y, x, float(y), float(x)) for y, x in itertools.product(range(6), range(6))], "yi long, xi long, lat double, lon double")
    ring = [(1, 0.5, 0.5, 3.5, 0.5), (1, 3.5, 0.5, 3.5, 3.5), (1, 3.5, 3.5, 0.5, 3.5), (1, 0.5, 3.5, 0.5, 0.5)]
    got = {(r.yi, r.xi) for r in grid.polygon_cells(grid_, spark.createDataFrame(ring, "id int, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert got == set(itertools.product(range(1, 4), range(1, 4)))


def test_fill_equals_brute_force_on_random_sparse_grids(spark):
    import random

    random.seed(11)
    rows = [(t, y, x, round(random.random(), 3) if random.random() < 0.06 else None) for t in range(4) for y in range(12) for x in range(17) if random.random() < 0.8]
    step = (0.5, 1.25)
    got = {(r.t, r.yi, r.xi): r.value for r in grid.fill_nearest(spark.createDataFrame(rows, "t int, yi long, xi long, value double"), ["t"], step=step).collect()}
    for t, y, x, v in rows:
        valid = [(((y - b) * step[0]) ** 2 + ((x - c) * step[1]) ** 2, b, c, w) for a, b, c, w in rows if a == t and w is not None]
        assert got[t, y, x] == (v if v is not None else min(valid)[3] if valid else None)
