"""Queries that write files and read them back: formats, text tables, caches."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from ..operators import skill, tables
from ..session import shared_dir
from ..sources import ascii_grid, netcdf, series, texts
from ..sources import tables as store
from .gauges import scored
from .registry import query
from .views import GAUGE_TS, GRID_TS, STATIC_GRID, gauge_ts, grid_ts, static_grid


def _folder(spark, name: str) -> str:
    """A new folder in the shared one, as a path: formats that are read and written in place need a mounted file system."""
    shared = shared_dir(spark)
    if ":" in shared.removeprefix("file:"):
        raise ValueError(f"{shared} is no mounted folder: give one as spark.checkpoint.dir")
    path = Path(shared.removeprefix("file://").removeprefix("file:")) / f"{name}-{uuid.uuid4().hex}"
    path.mkdir(parents=True)
    return str(path)


_DENSE = f"""{STATIC_GRID}, ys AS (SELECT DISTINCT yi, lat FROM static_grid), xs AS (SELECT DISTINCT xi, lon FROM static_grid),
    dense AS (SELECT ys.yi - min(ys.yi) OVER () AS yi, xs.xi - min(xs.xi) OVER () AS xi, ys.lat, xs.lon, value FROM ys CROSS JOIN xs LEFT JOIN static_grid g ON g.yi = ys.yi AND g.xi = xs.xi)"""


def _dense(spark, sf):
    """The static map with a row for every cell of its box."""
    g = static_grid(spark, sf).persist()
    ys, xs = (g.select(i, c).distinct().withColumn("__k", F.lit(1)) for i, c in (("yi", "lat"), ("xi", "lon")))
    return ys.join(xs, "__k").drop("__k").join(g.select("yi", "xi", "value"), ["yi", "xi"], "left")  # two axes


@query("k02_ascii_round_trip", f"WITH {_DENSE} SELECT 'dem' AS var, yi, xi, lat, lon, value FROM dense", "lat lon value")
def ascii_round_trip(spark, sf):
    """An ASCII grid written and scanned."""
    path = _folder(spark, "ascii") + "/dem.asc"
    head = ascii_grid.write_ascii(_dense(spark, sf), path)
    if ascii_grid.read_header(spark, path).ncols != head.ncols:
        raise ValueError("the header does not come back")
    return ascii_grid.read_ascii(spark, path).select("var", "yi", "xi", "lat", "lon", "value")


@query("k06_converter", f"WITH {_DENSE} SELECT yi, xi, lat, lon, value FROM dense", "lat lon value")
def converter(spark, sf):
    """ASCII to NetCDF, to a table, to ASCII, by suffix."""
    folder = _folder(spark, "converter")
    store.write_grid(_dense(spark, sf), f"{folder}/a.asc")
    for a, b in (("a.asc", "b.nc"), ("b.nc", "c.parquet"), ("c.parquet", "d.asc")):
        store.write_grid(store.read_grid(spark, f"{folder}/{a}").drop("path", "var", "time"), f"{folder}/{b}")
    return store.read_grid(spark, f"{folder}/d.asc").select("yi", "xi", "lat", "lon", "value")


_SERIES = f"""{GRID_TS}, b AS (SELECT min(yi) y0, min(xi) x0 FROM grid_ts),
    cells AS (SELECT DISTINCT yi FROM grid_ts), cols AS (SELECT DISTINCT xi FROM grid_ts), steps AS (SELECT DISTINCT t FROM grid_ts),
    dense AS (SELECT s.t, c.yi - y0 AS yi, x.xi - x0 AS xi, 50 - c.yi * CAST(0.5 AS DOUBLE) lat, 10 + x.xi * CAST(0.5 AS DOUBLE) lon, g.ref AS value FROM steps s CROSS JOIN cells c CROSS JOIN cols x CROSS JOIN b LEFT JOIN grid_ts g ON g.t = s.t AND g.yi = c.yi AND g.xi = x.xi)"""


@query("k01_netcdf_round_trip", f"WITH {_SERIES} SELECT 'pre' AS var, t AS time, yi, xi, lat, lon, value FROM dense", "lat lon value")
def netcdf_round_trip(spark, sf):
    """A gridded series written as NetCDF with bounds and attributes, and scanned; cells without a row are missing."""
    path = _folder(spark, "netcdf") + "/pre.nc"
    place = [(50 - F.col("yi") * 0.5).alias("lat"), (10 + F.col("xi") * 0.5).alias("lon")]
    netcdf.write_netcdf(grid_ts(spark, sf).select("yi", "xi", "t", *place, F.col("ref").alias("value")), path, "pre", {"units": "mm"})
    return netcdf.read_netcdf(spark, path, "pre").select("var", "time", "yi", "xi", "lat", "lon", "value")


def _chunked(spark, sf) -> str:
    """The gridded series as a NetCDF-4 file of small chunks."""
    place = [(50 - F.col("yi") * 0.5).alias("lat"), (10 + F.col("xi") * 0.5).alias("lon")]
    path = _folder(spark, "netcdf4") + "/pre.nc"
    netcdf.write_netcdf(grid_ts(spark, sf).select("yi", "xi", "t", *place, F.col("ref").alias("value")), path, "pre", {"units": "mm"}, kind="netcdf4", chunk=(6, 32, 8))
    return path


@query("s01_netcdf4_round_trip", f"WITH {_SERIES} SELECT 'pre' AS var, t AS time, yi, xi, lat, lon, value FROM dense", "lat lon value")
def netcdf4_round_trip(spark, sf):
    """A gridded series written as a chunked, shuffled and deflated file, and scanned, a partition a block of chunks."""
    return netcdf.read_netcdf(spark, _chunked(spark, sf), "pre").select("var", "time", "yi", "xi", "lat", "lon", "value")


@query("s01_netcdf_pushdown", f"WITH {_SERIES} SELECT t AS time, yi, xi, value FROM dense WHERE t >= TIMESTAMP '1994-03-01' AND t < TIMESTAMP '1995-07-01' AND lat <= 49.5 AND lon > 11 AND lon < 13.5", "value")
def netcdf_pushdown(spark, sf):
    """A time range and a box, of which the source reads its chunks only."""
    box = "time >= timestamp_ntz'1994-03-01' AND time < timestamp_ntz'1995-07-01' AND lat <= 49.5 AND lon > 11 AND lon < 13.5"
    return netcdf.read_netcdf(spark, _chunked(spark, sf), "pre").filter(box).select("time", "yi", "xi", "value")


@query("k07_axis_bounds", f"WITH {STATIC_GRID}, a AS (SELECT DISTINCT lat c FROM static_grid), n AS (SELECT c, lag(c) OVER (ORDER BY c) p, lead(c) OVER (ORDER BY c) q FROM a) SELECT c AS lat, greatest(coalesce((c + p) / 2, c - (q - c) / 2, c - 0.5), coalesce((c + q) / 2, c + (c - p) / 2, c + 0.5)) AS upper, least(coalesce((c + p) / 2, c - (q - c) / 2, c - 0.5), coalesce((c + q) / 2, c + (c - p) / 2, c + 0.5)) AS lower FROM n", "lat upper lower")
def netcdf_bounds(spark, sf):
    """K7: the bounds that a NetCDF file is given."""
    path = _folder(spark, "bounds") + "/value.nc"
    netcdf.write_netcdf(static_grid(spark, sf), path)
    layout = netcdf.read_layout(path)
    rows = [(float(c), float(max(b)), float(min(b))) for c, b in zip(layout.read("lat"), layout.read("lat_bnds"), strict=True)]
    return spark.createDataFrame(rows, "lat double, upper double, lower double")


@query("s02_table_tree", f"WITH {STATIC_GRID} SELECT yi, xi, lat, lon, value FROM static_grid", "lat lon value")
def table_tree(spark, sf):
    """A folder of tables with long axis names, all its files as one."""
    folder = _folder(spark, "tree")
    g = static_grid(spark, sf).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    g.filter("xi % 2 = 0").write.parquet(f"{folder}/even")
    g.filter("xi % 2 = 1").write.parquet(f"{folder}/odd/part")
    return store.read_tree(spark, folder).select("yi", "xi", "lat", "lon", "value")


@query("k10_result_cache", f"WITH {STATIC_GRID} SELECT yi, xi, value FROM static_grid", "value")
def result_cache(spark, sf):
    """Built once, then read; the second builder is not called."""
    path = _folder(spark, "cache") + "/grid"
    store.cached(None, path, spark, lambda: static_grid(spark, sf))
    return store.cached(None, path, spark, lambda: static_grid(spark, sf).limit(0)).select("yi", "xi", "value")


@query("k09_link_tree", f"WITH {STATIC_GRID} SELECT yi, xi, value FROM static_grid WHERE xi % 3 < 2", "value")
def link_tree(spark, sf):
    """K9: links to the files of a folder that fit a pattern, read as the files themselves are."""
    source, target = _folder(spark, "links-from"), _folder(spark, "links-to")
    for k in range(3):
        static_grid(spark, sf).filter(f"xi % 3 = {k}").select("yi", "xi", "value").write.parquet(f"{source}/{'left' if k == 2 else 'part'}/{k}")
    texts.link_tree(f"{source}/part", target, "*.parquet")
    return spark.read.option("recursiveFileLookup", True).parquet(target)


@query("k08_provenance", f"WITH {STATIC_GRID} SELECT attribute, n FROM (SELECT unnest(['command', 'date', 'history', 'version']) AS attribute), (SELECT count(*) AS n FROM static_grid)")
def provenance(spark, sf):
    """K8: the attributes of a table's sidecar file, as it is written, beside the table's rows."""
    path = _folder(spark, "provenance") + "/t"
    store.write_grid(static_grid(spark, sf), path)
    store.write_provenance(path, version="1", history="before")
    found = spark.read.option("multiLine", True).json(path + ".provenance.json").select(F.explode(F.map_keys(F.from_json(F.to_json(F.struct("*")), "map<string, string>"))).alias("attribute"))
    return found.crossJoin(F.broadcast(spark.read.parquet(path).agg(F.count("*").alias("n"))))


@query("s09_discharge_text", f"WITH {GAUGE_TS}, w AS (SELECT DISTINCT t FROM gauge_ts), i AS (SELECT DISTINCT id FROM gauge_ts) SELECT i.id, w.t, g.obs, g.sim FROM w CROSS JOIN i LEFT JOIN gauge_ts g ON g.t = w.t AND g.id = i.id", "obs sim")
def discharge_text(spark, sf):
    """Wide text tables of discharge, a file a block of gauges, missing values below 0."""
    folder = _folder(spark, "discharge") + "/q"
    series.write_discharge_text(series.wide_blocks(gauge_ts(spark, sf)), folder)
    return series.read_discharge_text(spark, folder).select("id", "t", "obs", "sim")


@query("s10_observed_parts", f"WITH {GAUGE_TS} SELECT id, t, obs FROM gauge_ts WHERE t BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1996-12-31' AND id % 40 BETWEEN 5 AND 25 AND id % 7 BETWEEN 1 AND 4 AND id % 3 = 0", "obs")
def observed_parts(spark, sf):
    """Time, box and ids before anything is shuffled."""
    folder = _folder(spark, "parts") + "/ts"
    ts = gauge_ts(spark, sf).withColumns({"x": (F.col("id") % 40).cast("double"), "y": (F.col("id") % 7).cast("double")})
    ts.write.parquet(folder)
    ids = ts.filter("id % 3 = 0").select("id").distinct()
    return series.read_parts(spark, folder, ids, "1993-01-01", "1996-12-31", (5, 25, 1, 4)).select("id", "t", "obs")


@query("s11_metric_files", f"WITH {GAUGE_TS}, sk AS ({scored('id', 'gauge_ts')}), lg AS (UNPIVOT (SELECT id, kge, nse FROM sk) ON kge, nse INTO NAME metric VALUE value) SELECT metric, count(*) n, min(value) AS least, max(value) AS most, avg(value) mean FROM lg GROUP BY metric", "least most mean")
def metric_files(spark, sf):
    """Metric tables as CSV files, one a part, scanned; columns that no file has give nothing."""
    folder = _folder(spark, "metrics")
    found = skill.skill(gauge_ts(spark, sf), ["id"]).filter("n > 0").select("id", "kge", "nse")
    texts.write_metrics(found.filter("id % 2 = 0"), f"{folder}/even")
    texts.write_metrics(found.filter("id % 2 = 1"), f"{folder}/odd")
    long = texts.read_metric_csv(spark, folder, ["kge", "nse", "absent"])
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))


def _lines(spark, rows, name: str) -> str:
    """A text file of the lines of ``rows`` (k, line), in order of k."""
    folder = _folder(spark, name) + "/text"
    rows.repartitionByRange(1, "k").sortWithinPartitions("k").select("line").write.text(folder)  # one file is the format
    return folder


def _namelist(spark, sf) -> str:
    """Of each supplier a name in quotes with a comment's sign in it, a number with a comment after it, a line that is a comment, and a land-cover scene."""
    k = F.col("s_suppkey").cast("string")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    lines = F.array(
        say("  S_Name(", k, ') = "', F.col("s_name"), '!x"   ! note'), say(" s_nation(1, ", k, ") = ", F.col("s_nationkey").cast("string"), ", ! key"), say("! s_off = ", k),
        say("LCoverYearStart(1,", k, ") = ", (1900 + F.col("s_suppkey")).cast("string")), say("LCoverYearEnd(1,", k, ") = ", (1901 + F.col("s_suppkey")).cast("string"), ","), say("LCoverfName(1,", k, ") = 'lc_", k, ".asc'"),
    )
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select((F.col("s_suppkey") * 10).alias("s"), F.posexplode(lines).alias("p", "line"))
    return _lines(spark, rows.select((F.col("s") + F.col("p")).alias("k"), "line"), "namelist")


@query(
    "s12_namelist",
    """SELECT key, "index", value FROM (SELECT s_suppkey k, s_name n, s_nationkey a FROM supplier), LATERAL (VALUES ('s_name', k || '', n || '!x'), ('s_nation', '1, ' || k, a || ''),
    ('lcoveryearstart', '1,' || k, (1900 + k) || ''), ('lcoveryearend', '1,' || k, (1901 + k) || ''), ('lcoverfname', '1,' || k, 'lc_' || k || '.asc')) v(key, "index", value)""",
)
def namelist(spark, sf):
    """Assignments of a namelist."""
    return texts.read_namelist(spark, _namelist(spark, sf)).select("key", "index", "value")


@query("s13_landcover_namelist", "SELECT CAST(s_suppkey AS INT) AS scene, CAST(1900 + s_suppkey AS INT) AS year_start, CAST(1901 + s_suppkey AS INT) AS year_end, 'lc_' || s_suppkey || '.asc' AS file FROM supplier")
def landcover_namelist(spark, sf):
    """Land-cover intervals of a namelist."""
    return texts.read_landcover_intervals(spark, _namelist(spark, sf)).select("scene", "year_start", "year_end", "file")


@query("s14_catchment_log", "SELECT format('{:.0f}', CAST(arg_max(s_acctbal, s_suppkey) AS DOUBLE)) AS area FROM supplier")
def catchment_log(spark, sf):
    """The area of a log's last line with one."""
    text = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Total[km2]   ").otherwise("  Total[km2]:  "), F.col("s_acctbal").cast("double").cast("string"))
    path = _lines(spark, spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"), text.alias("line")), "log")
    return spark.createDataFrame([(texts.catchment_area(spark, path),)], "area string")


@query("s15_gauge_ids", "SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_suppkey % 2 = 0")
def gauge_ids(spark, sf):
    """A list of ids without a header."""
    folder = _folder(spark, "ids") + "/list"
    spark.read.parquet(f"{sf}/supplier.parquet").filter("s_suppkey % 2 = 0").select("s_suppkey", F.lit("x")).write.csv(folder)
    return series.read_ids(spark, folder)


@query("a47_metric_comparison", f"WITH {GAUGE_TS}, sk AS ({scored('id', 'gauge_ts')}), lg AS (UNPIVOT (SELECT id, kge, nse FROM sk) ON kge, nse INTO NAME variable VALUE value) SELECT CASE id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS label, variable, count(*) n, min(value) AS min, max(value) AS max, avg(value) mean, quantile_cont(value, 0.5) AS median FROM lg GROUP BY ALL", "min max mean median")
def metric_comparison(spark, sf):
    """Numbers of each metric and input, from the inputs' files; a metric without any finite value raises."""
    folder = _folder(spark, "comparison")
    found = skill.skill(gauge_ts(spark, sf), ["id"]).filter("n > 0").select("id", "kge", "nse")
    for k, name in enumerate(("even", "odd")):
        texts.write_metrics(found.filter(f"id % 2 = {k}"), f"{folder}/{name}")
    return tables.compare_inputs({n: texts.read_metric_csv(spark, f"{folder}/{n}", ["kge", "nse"]) for n in ("even", "odd")}, ["kge", "nse"])
