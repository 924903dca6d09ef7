"""Commands end to end on tiny inputs."""

import pytest
from pyspark.sql import functions as F

from tarnflow.cli import COMMANDS, main
from tarnflow.sources.tables import read_grid


@pytest.fixture
def asc(tmp_path):
    p = tmp_path / "dem.asc"
    p.write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2 -9999\n4 5 6\n")
    return str(p)


def test_convert_fill_crop_and_compare(spark, asc, tmp_path):
    out = lambda n: str(tmp_path / n)
    main(["converter", asc, out("dem.parquet")])
    assert read_grid(spark, out("dem.parquet")).count() == 6
    main(["fill_nearest", out("dem.parquet"), out("filled.asc")])
    assert (tmp_path / "filled.asc").read_text().splitlines()[6:] == ["1.0 2.0 2.0", "4.0 5.0 6.0"]
    main(["crop", asc, out("cut.parquet"), "--lat", "0,1", "--lon", "0,2"])
    assert sorted(r.value for r in read_grid(spark, out("cut.parquet")).collect()) == [4.0, 5.0]
    main(["ratio", out("filled.asc"), asc, out("ratio.parquet")])
    assert {r.value for r in read_grid(spark, out("ratio.parquet")).collect()} == {1.0, None}
    main(["regrid-file", asc, asc, out("same.parquet"), "--method", "linear"])
    assert {(r.yi, r.xi): r.value for r in read_grid(spark, out("same.parquet")).collect()} == {(r.yi, r.xi): r.value for r in read_grid(spark, asc).collect()}
    main(["create-header", asc, out("h")])
    assert "ncols         3" in (tmp_path / "h/header.txt").read_text()
    main(["latlon", asc, out("ll"), "--levels", "l0=1,l1=2"])
    assert spark.read.parquet(out("ll/l1")).count() == 2


def test_series_commands(spark, tmp_path):
    text = tmp_path / "daily.out"
    text.write_text("No Day Mon Year Qobs_7 Qsim_7\n" + "".join(f"{i} {i} 1 2000 {i}. {i}.\n" for i in range(1, 20)))
    main(["hydrograph", str(text), str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).first().kge == pytest.approx(1)
    main(["discharge-evaluation", str(text), str(tmp_path / "e"), "--step", "W"])
    assert spark.read.parquet(str(tmp_path / "e")).first().nse == pytest.approx(1)
    f = spark.createDataFrame([(50.0, "2001-06-01", 10.0)], "lat double, t string, tavg double").withColumn("t", F.to_timestamp_ntz("t"))
    f.write.parquet(str(tmp_path / "f"))
    main(["calculate-pet", str(tmp_path / "f"), str(tmp_path / "p")])
    assert spark.read.parquet(str(tmp_path / "p")).first().pet > 0
    with pytest.raises(SystemExit):
        main(["no-such-command"])
    assert len(COMMANDS) >= 20


def grid_file(path, rows, size=1.0):
    path.write_text(f"ncols {len(rows[0])}\nnrows {len(rows)}\nxllcorner 0\nyllcorner 0\ncellsize {size:g}\nNODATA_value -9999\n" + "\n".join(" ".join(str(v) for v in r) for r in rows) + "\n")
    return str(path)


def test_catchment_and_gauge_rasters(spark, tmp_path):
    out = lambda n: str(tmp_path / n)
    # all of the rows drain east, the last column south: one outlet in the lower right corner
    codes = grid_file(tmp_path / "fdir.asc", [[1, 1, 4], [1, 1, 4], [1, 1, 0]])
    (tmp_path / "gauges.csv").write_text("id,lat,lon,area\n7,0.5,2.5,\n8,1.5,1.5,\n")
    main(["create-catchment", codes, out("gauges.csv"), out("c"), "--cell-size", "1", "--reach", "0"])
    sums = {(r.yi, r.xi): r.cells for r in spark.read.parquet(out("c/accumulation")).collect()}
    assert sums[2, 2] == 9 and sums[1, 2] == 6 and sums[0, 1] == 2
    found = {r.id: r for r in spark.read.parquet(out("c/gauges")).collect()}
    assert (found[7].yi, found[7].xi, found[8].yi, found[8].xi) == (2, 2, 1, 1) and all(r.acceptable for r in found.values())
    basins = {(r.yi, r.xi): r.id for r in spark.read.parquet(out("c/basins")).collect()}
    assert basins[1, 0] == 8 and basins[1, 1] == 8 and sum(v == 7 for v in basins.values()) == 7
    main(["create_id_gauges", codes, out("c/gauges"), out("ids.asc")])
    assert {(r.yi, r.xi): r.value for r in read_grid(spark, out("ids.asc")).collect() if r.value} == {(2, 2): 7.0, (1, 1): 8.0}


def test_landcover_subdomains_restarts_and_map(spark, tmp_path):
    out = lambda n: str(tmp_path / n)
    (tmp_path / "lc").mkdir()
    for k in (1, 2):
        grid_file(tmp_path / f"lc/lc_{k}.asc", [[k, k], [k, 3]])
    (tmp_path / "m.nml").write_text("LCoverYearStart(1,1) = 1950\nLCoverYearEnd(1,1) = 1980\nLCoverfName(1,1) = 'lc_1.asc'\nLCoverYearStart(1,2) = 1981\nLCoverYearEnd(1,2) = 2000\nLCoverfName(1,2) = 'lc_2.asc'\n")
    main(["landcover-ascii-to-nc", out("m.nml"), out("lc"), out("lc.nc")])
    got = {(r.time.year, r.yi, r.xi): r.value for r in read_grid(spark, out("lc.nc")).collect()}
    assert got[1950, 0, 0] == 1.0 and got[1981, 0, 0] == 2.0 and got[1981, 1, 1] == 3.0 and len(got) == 8
    (tmp_path / "bad.nml").write_text((tmp_path / "m.nml").read_text().replace("1981", "1985"))
    with pytest.raises(ValueError, match="gap"):
        main(["landcover-ascii-to-nc", out("bad.nml"), out("lc"), out("lc2.nc")])
    basins, classes, land = (grid_file(tmp_path / f"{n}.asc", m) for n, m in (("b", [[1, 1], [2, 2]]), ("k", [[5, -9999], [6, 5]]), ("l", [[1, 1], [1, -9999]])))
    main(["create-subdomain-masks", basins, classes, land, out("sub")])
    assert {(r.yi, r.xi): r.cls for r in spark.read.parquet(out("sub")).collect()} == {(0, 0): 5.0, (0, 1): 5.0, (1, 0): 6.0}
    spark.createDataFrame([(0, "soil", 0, 0, 1.0), (0, "soil", 0, 1, None), (1, "soil", 0, 0, 4.0)], "tile long, var string, yi long, xi long, value double").write.parquet(out("cells"))
    spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0)], "tile long, lat0 double, lon0 double").write.parquet(out("tiles"))
    on = grid_file(tmp_path / "on.asc", [[1, 1], [1, 1]])
    for name, want in (("create-mhm-restart-file", None), ("create-mhm-restart-from-setup", 1.0)):
        main([name, out("cells"), out("tiles"), on, out(name), "--origin", "0,0", "--cell-size", "1", "--rename", "soil=L1_soil"])
        assert {(r["var"], r.yi, r.xi): r.value for r in spark.read.parquet(out(name)).collect()} == {("L1_soil", 0, 0): 1.0, ("L1_soil", 0, 1): want, ("L1_soil", 1, 0): 4.0}
    main(["2d-map", out("lc/lc_1.asc"), out("map")])
    assert tuple(spark.read.parquet(out("map")).first()) == (1.0, 3.0, 1.0, 2)


def test_second_names_and_hints(spark, asc, tmp_path, capsys):
    main(["converter_nc_ascii", asc, str(tmp_path / "a.nc")])
    assert read_grid(spark, str(tmp_path / "a.nc")).count() == 6
    with pytest.raises(SystemExit):
        main(["create-catchmet"])
    assert "did you mean create-catchment" in capsys.readouterr().err
    assert len(COMMANDS) >= 28


def test_catchment_from_terrain(spark, tmp_path):
    # a valley that falls to the east between two ridges; the rim is an outlet of its own
    heights = grid_file(tmp_path / "dem.asc", [[9, 9, 9, 9, 9], [9, 8, 6, 4, 2], [9, 9, 9, 9, 9]])
    (tmp_path / "gauges.csv").write_text("id,lat,lon,area\n1,1.5,4.5,\n")
    main(["create-catchment", heights, str(tmp_path / "gauges.csv"), str(tmp_path / "c"), "--cell-size", "1", "--reach", "0", "--terrain"])
    sums = {(r.yi, r.xi): r.cells for r in spark.read.parquet(str(tmp_path / "c/accumulation")).collect()}
    assert sums[1, 4] == 4 and sums[1, 2] == 2 and sums[0, 0] == 1
    assert {(r.yi, r.xi) for r in spark.read.parquet(str(tmp_path / "c/basins")).collect()} == {(1, 1), (1, 2), (1, 3), (1, 4)}
