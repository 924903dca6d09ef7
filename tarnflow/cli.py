"""``python -m tarnflow COMMAND ...``: the operators on tables and ASCII grids, by path.

Inputs are read by suffix (Parquet, CSV, ``.asc``, ``.nc``); results are Parquet, or ``.asc`` or ``.nc`` for grids.
"""

from __future__ import annotations

import argparse
import difflib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import limits
from .functions.arith import difference, ratio, relative_difference
from .functions.pet import pet
from .operators import bankfull, grid, rank, resample, skill, tables, terrain, tiles, workflows
from .session import session
from .sources import ascii_grid, series, texts
from .sources.tables import read_grid, write_grid

COMMANDS: dict[str, tuple[Callable, Callable]] = {}
#: Second names of commands.
ALIASES = {"crop-mhm-setup": "crop", "prepare-mhm-forcings": "prepare-forcings", "converter-nc-ascii": "converter", "metric-plots": "metric-tables"}


def command(name: str, *arguments: tuple):
    def register(run: Callable[[SparkSession, argparse.Namespace], None]):
        def options(p: argparse.ArgumentParser) -> None:
            for flags, kw in arguments:
                p.add_argument(*flags.split(), **kw)

        COMMANDS[name] = options, run
        return run

    return register


def arg(flags: str, **kw) -> tuple:
    return flags, kw


IN, OUT = arg("input"), arg("output")
TWO = (arg("input"), arg("reference"), arg("output"))
BOX = (arg("--lat", help="lat,lat"), arg("--lon", help="lon,lon"))


def _series(spark: SparkSession, path: str) -> DataFrame:
    return series.read_discharge_text(spark, path) if path.endswith((".out", ".txt")) else spark.read.parquet(path)


def _pair(spark: SparkSession, a: argparse.Namespace, how: Callable) -> None:
    x, y = (read_grid(spark, p) for p in (a.input, a.reference))
    keys = [k for k in ("yi", "xi", "t", "time") if k in x.columns and k in y.columns]
    joined = x.withColumnRenamed("value", "__model").join(y.select(*keys, F.col("value").alias("__ref")), keys)
    write_grid(joined.withColumn("value", how("__model", "__ref")).drop("__model", "__ref"), a.output)


@command("hydrograph", IN, OUT)
def hydrograph(spark, a):
    """Objectives of each gauge over the common span."""
    ts = _series(spark, a.input)
    skill.skill(skill.flagged_overlap(ts, ["id"], "t"), ["id"]).write.mode("overwrite").parquet(a.output)


@command("discharge-evaluation", IN, OUT, arg("--step", default="D"), arg("--min-years", type=int, default=1), arg("--min-overlap", type=int, default=1), arg("--ids"))
def discharge_evaluation(spark, a):
    """Objectives of gauges with enough years, on one step."""
    ids = series.read_ids(spark, a.ids).withColumn("id", F.col("id").cast("long")) if a.ids else None
    workflows.evaluate_discharge(_series(spark, a.input), a.step, a.min_years, a.min_overlap, ids).write.mode("overwrite").parquet(a.output)


@command("flow-duration", IN, OUT, arg("--value", default="obs"))
def flow_duration(spark, a):
    """Flow duration curves."""
    rank.flow_duration_curve(_series(spark, a.input), ["id"], a.value).write.mode("overwrite").parquet(a.output)


@command("gridded-data-evaluation", *TWO, arg("--mask"), arg("--direct", action="store_true"), arg("--step", default="M"))
def gridded_data_evaluation(spark, a):
    """Rank correlations, scores and relative fields of two gridded series (tables with yi, xi, t, value)."""
    mask = read_grid(spark, a.mask).withColumnRenamed("value", "mask") if a.mask else None
    for name, df in workflows.evaluate_grids(spark.read.parquet(a.input), spark.read.parquet(a.reference), mask, a.direct, a.step).items():
        df.write.mode("overwrite").parquet(f"{a.output.rstrip('/')}/{name}")


@command("bankfull", IN, OUT, arg("--return-period", type=float, default=1.5), arg("--keys", default="id"), arg("--value", default="value"))
def bankfull_(spark, a):
    """Bankfull discharge and wetted perimeter."""
    bankfull.bankfull_discharge(spark.read.parquet(a.input), a.keys.split(","), a.value, a.return_period).write.mode("overwrite").parquet(a.output)


@command("long-term-mean", IN, OUT, arg("--step", default="M"), arg("--sum", action="store_true"), arg("--threshold", type=float), arg("--keys", default="yi,xi"))
def long_term_mean(spark, a):
    """Mean of the means or sums per step."""
    resample.long_term_mean(spark.read.parquet(a.input), a.keys.split(","), "value", a.step, not a.sum, a.threshold).write.mode("overwrite").parquet(a.output)


for _name, _how in (("difference", lambda m, r: difference(r, m)), ("ratio", ratio), ("relative-difference", lambda m, r: relative_difference(r, m))):
    command(_name, *TWO)(lambda spark, a, how=_how: _pair(spark, a, how))


@command("calculate-pet", IN, OUT, arg("--method", default="oudin"), arg("--hourly", action="store_true"))
def calculate_pet(spark, a):
    """PET of a table with lat, t, tavg (and tmin, tmax)."""
    df = spark.read.parquet(a.input)
    extra = [F.col(c) if c in df.columns else None for c in ("tmin", "tmax")]
    if all(e is not None for e in extra) and df.filter("tmin > tmax").limit(1).count():
        raise ValueError("tmin over tmax")
    df.withColumn("pet", pet(a.method, F.col("lat"), F.dayofyear("t"), F.col("tavg"), *extra, daily=not a.hourly).cast("float")).write.mode("overwrite").parquet(a.output)


@command("prepare-forcings", IN, OUT, arg("--unit", required=True), arg("--source-hours", type=float, required=True), arg("--target", default="D", choices=["D", "h"]), *BOX)
def prepare_forcings(spark, a):
    """Resample, convert, crop a table with yi, xi, lat, lon, t, value."""
    lat, lon = (workflows.parse_coordinates(x) if x else None for x in (a.lat, a.lon))
    workflows.prepare_forcing(spark.read.parquet(a.input), ["yi", "xi", "lat", "lon"], "value", a.unit, a.source_hours, a.target, lat, lon).write.mode("overwrite").parquet(a.output)


@command("crop", IN, OUT, *(arg(f, required=True, help=k["help"]) for f, k in BOX), arg("--mask"))
def crop(spark, a):
    """A grid cut to a box, and masked."""
    cut = workflows.crop_setup({"dem": read_grid(spark, a.input)}, workflows.parse_coordinates(a.lat), workflows.parse_coordinates(a.lon), read_grid(spark, a.mask).withColumnRenamed("value", "mask") if a.mask else None)
    write_grid(cut["dem"], a.output)


@command("fill-nearest", IN, OUT, arg("--keys", default=""), arg("--default", type=float))
def fill_nearest(spark, a):
    """Missing cells from the nearest valid ones, step by step."""
    df = read_grid(spark, a.input).withColumn("__k", F.lit(0))
    write_grid(grid.fill_nearest(df, ["__k", *filter(None, a.keys.split(","))], default=a.default).drop("__k"), a.output)


@command("regrid-file", *TWO, arg("--method", default="nearest", choices=["nearest", "linear"]))
def regrid_file(spark, a):
    """A grid on the cells of another one."""
    src, dst = (read_grid(spark, p) for p in (a.input, a.reference))
    axes = [grid.axis(f, i, c) for f in (src, dst) for i, c in (("yi", "lat"), ("xi", "lon"))]
    keys = [k for k in ("t", "time", "var") if k in src.columns]
    if a.method == "nearest":
        out = grid.regrid_nearest(src, grid.nearest_axis(axes[0], axes[2]), grid.nearest_axis(axes[1], axes[3]), keys, ["value"])
    else:
        out = grid.regrid_linear(src, grid.bracket_axis(axes[0], axes[2]), grid.bracket_axis(axes[1], axes[3]), keys, "value")
    write_grid(out.join(dst.select("yi", "xi", "lat", "lon").distinct(), ["yi", "xi"]), a.output)


@command("merge-files", arg("inputs", nargs="+"), arg("--output", required=True), arg("--keys", default="yi,xi"))
def merge_files(spark, a):
    """Tables of a series united; of repeated stamps the first file's."""
    resample.merge_files([spark.read.parquet(p) for p in a.inputs], a.keys.split(",")).write.mode("overwrite").parquet(a.output)


@command("converter", IN, OUT, arg("--only-header", action="store_true"))
def converter(spark, a):
    """Between .asc, .nc and Parquet, by suffix."""
    df = read_grid(spark, a.input)
    ascii_grid.write_header(df, a.output) if a.only_header else write_grid(df, a.output)


@command("create-header", IN, OUT)
def create_header(spark, a):
    """The header of a grid."""
    ascii_grid.write_header(read_grid(spark, a.input), a.output)


@command("latlon", IN, OUT, arg("--levels", required=True, help="l0=500,l1=1000,..."))
def latlon(spark, a):
    """Templates of cell centres on the extent of a header, a folder a level."""
    levels = {k: float(v) for k, v in (x.split("=") for x in a.levels.split(","))}
    for name, df in ascii_grid.latlon_ladder(spark, ascii_grid.read_header(spark, a.input), levels).items():
        df.write.mode("overwrite").parquet(f"{a.output.rstrip('/')}/{name}")


@command("run-overview", IN, OUT, arg("--target"))
def run_overview(spark, a):
    """Least, mean, largest of each variable of a long table (file_name, variable, vartype, unit, value)."""
    stats = tables.variable_statistics(spark.read.parquet(a.input), ["file_name", "variable", "vartype", "unit"], "value")
    out = tables.overview(stats, a.target).withColumns({c: tables.as_text(c) for c in ("min_value", "mean_value", "max_value")})
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(a.output)


@command("metric-tables", IN, OUT, arg("--metrics", default="kge,nse,alpha,beta,gamma"))
def metric_tables(spark, a):
    """Numbers of each metric of CSV files."""
    tables.summary(texts.read_metric_csv(spark, a.input, a.metrics.split(",")), ["metric"], "value").write.mode("overwrite").parquet(a.output)


@command("taylor-diagram", IN, OUT, arg("--series", default="id"))
def taylor_diagram(spark, a):
    """The numbers of Taylor diagrams."""
    skill.taylor_statistics(_series(spark, a.input), a.series).write.mode("overwrite").parquet(a.output)


@command("create-catchment", IN, arg("gauges", help="CSV with id, lat, lon and perhaps area"), OUT, arg("--cell-size", type=float, required=True), arg("--reach", type=int, default=3), arg("--max-error", type=float, default=0.3), arg("--terrain", action="store_true", help="the input holds heights instead of D8 codes"))
def create_catchment(spark, a):
    """Gauges on a grid of D8 codes, or of heights, their basins, and accumulation, a folder each."""
    cells = read_grid(spark, a.input)
    if a.terrain:
        directions = cells.select("yi", "xi", "lat", "lon").join(terrain.flow_directions(cells).select("yi", "xi", "dir"), ["yi", "xi"])
    else:
        directions = cells.withColumn("dir", F.col("value").cast("int"))
    gauges = spark.read.csv(a.gauges, header=True, inferSchema=True)
    gauges = gauges if "area" in gauges.columns else gauges.withColumn("area", F.lit(None).cast("double"))
    for name, df in workflows.create_catchment(directions, gauges, a.cell_size, a.reach, a.max_error).items():
        df.write.mode("overwrite").parquet(f"{a.output.rstrip('/')}/{name}")


@command("landcover-ascii-to-nc", arg("namelist"), IN, OUT)
def landcover_ascii_to_nc(spark, a):
    """Land-cover grids of a folder on the intervals of a namelist, as one series."""
    write_grid(workflows.landcover_series(read_grid(spark, f"{a.input.rstrip('/')}/*.asc"), texts.read_landcover_intervals(spark, a.namelist)), a.output)


@command("create-id-gauges", IN, arg("gauges", help="table with id, yi, xi"), OUT)
def create_id_gauges(spark, a):
    """A grid with the ids of gauges at their cells."""
    g = read_grid(spark, a.input).select("yi", "xi", "lat", "lon")
    ids = tiles.gauge_raster(g, spark.read.parquet(a.gauges).select("id", "yi", "xi"))
    write_grid(g.join(ids, ["yi", "xi"]).withColumnRenamed("gauge", "value"), a.output)


@command("create-subdomain-masks", arg("basins"), arg("classes"), arg("land"), OUT)
def create_subdomain_masks(spark, a):
    """The old class of most cells for each new basin (grids of basins, old classes, land)."""
    new, old, land = (read_grid(spark, p).withColumnRenamed("value", n) for p, n in ((a.basins, "basin"), (a.classes, "cls"), (a.land, "mask")))
    workflows.subdomain_masks(new.select("yi", "xi", "basin"), old.select("yi", "xi", "cls"), land.select("yi", "xi", "mask")).write.mode("overwrite").parquet(a.output)


def _restart(spark, a, merge) -> None:
    y, x = workflows.parse_coordinates(a.origin)
    renames = dict(p.split("=") for p in a.rename.split(",")) if a.rename else None
    mask = read_grid(spark, a.mask).withColumnRenamed("value", "mask").select("yi", "xi", "mask")
    merge(spark.read.parquet(a.input), spark.read.parquet(a.tiles), mask, (y, x), a.cell_size, renames).write.mode("overwrite").parquet(a.output)


_RESTART = (IN, arg("tiles", help="table with tile, lat0, lon0"), arg("mask"), OUT, arg("--origin", required=True, help="lat,lon of the lower corner"), arg("--cell-size", type=float, required=True), arg("--rename", help="old=new,..."))


@command("create-mhm-restart-file", *_RESTART)
def create_restart_file(spark, a):
    """Restart tiles (tile, var, yi, xi, value) on one grid, masked and renamed."""
    _restart(spark, a, tiles.merge_restarts)


@command("create-mhm-restart-from-setup", *_RESTART)
def create_restart_from_setup(spark, a):
    """The same, with gaps of each tile filled from its nearest cells first."""
    _restart(spark, a, workflows.restart_from_tiles)


@command("2d-map", IN, OUT)
def map_numbers(spark, a):
    """What a map of a grid is drawn from: its least and largest value, half range and digits of its labels."""
    r = read_grid(spark, a.input).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    half, digits = limits.label_step((F.col("most") - F.col("least")) / 2)
    r.select("least", "most", half.alias("half_range"), digits.alias("digits")).write.mode("overwrite").parquet(a.output)


@command("link-folder-tree", IN, OUT, arg("--pattern", default="*"), arg("--overwrite", action="store_true"))
def link_folder_tree(spark, a):
    """Symbolic links to the files of a folder."""
    texts.link_tree(a.input, a.output, a.pattern, a.overwrite)


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    parser = argparse.ArgumentParser(prog="tarnflow", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    second = {n: [o for o, of in ALIASES.items() if of == n] for n in COMMANDS}
    for name, (options, run) in sorted(COMMANDS.items()):
        names = [*second[name], *(n.replace("-", "_") for n in (name, *second[name]) if "-" in n)]
        options(sub.add_parser(name, aliases=names, help=run.__doc__))
    given = argv[0] if argv and not argv[0].startswith("-") else None
    if given and given not in sub.choices:
        near = difflib.get_close_matches(given, [*COMMANDS, *ALIASES], 3)
        parser.error(f"no command {given!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    args = parser.parse_args(argv)
    name = args.command.replace("_", "-")
    COMMANDS[ALIASES.get(name, name)][1](session(f"tarnflow {args.command}"), args)
