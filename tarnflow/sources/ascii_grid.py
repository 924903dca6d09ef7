"""ESRI ASCII grids: headers, scans to long tables, writing, lat/lon templates."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_through
from .placed import write_placed

#: Lines of a grid up to which their places are broadcast.
MAX_LOCAL = 20_000
NODATA = -9999.0
REQUIRED = ("ncols", "nrows", "cellsize")


@dataclass(frozen=True)
class Header:
    ncols: int
    nrows: int
    cellsize: float
    xllcorner: float = 0.0
    yllcorner: float = 0.0
    nodata: float = NODATA

    def text(self) -> str:
        rows = [("ncols", self.ncols), ("nrows", self.nrows), ("xllcorner", self.xllcorner), ("yllcorner", self.yllcorner), ("cellsize", self.cellsize), ("NODATA_value", f"{self.nodata:g}")]
        return "\n".join(f"{k:<14}{v}" for k, v in rows)

    def rescaled(self, cellsize: float, tolerance: float = 1e-7) -> Header:
        """The same extent in coarser cells, rounded up; the ratio must be an integer, up to a tolerance that is raised tenfold until 1e-5."""
        ratio = cellsize / self.cellsize
        while abs(ratio - round(ratio)) > tolerance:
            tolerance *= 10
            if tolerance > 1e-5:
                raise ValueError(f"{cellsize} is no integer multiple of {self.cellsize}")
        k = round(ratio)
        return replace(self, ncols=-(-self.ncols // k), nrows=-(-self.nrows // k), cellsize=cellsize)


def parse_header(lines: list[str]) -> Header:
    """Six lines ``key value`` in any order and case; centres become corners by half a cell."""
    found = {}
    for line in lines:
        parts = line.split()
        if len(parts) == 2:
            found[parts[0].lower()] = float(parts[1])
    missing = [k for k in REQUIRED if k not in found]
    if missing:
        raise ValueError(f"header lacks {', '.join(missing)}")
    half = found["cellsize"] / 2
    corner = {a: found.get(f"{a}llcorner", found[f"{a}llcenter"] - half if f"{a}llcenter" in found else 0.0) for a in "xy"}
    return Header(int(found["ncols"]), int(found["nrows"]), found["cellsize"], corner["x"], corner["y"], found.get("nodata_value", NODATA))


def read_header(spark: SparkSession, path: str) -> Header:
    rows = spark.read.text(path).limit(6).collect()
    return parse_header([r.value for r in rows])


def read_ascii(spark: SparkSession, path: str, var: str | None = None) -> DataFrame:
    """path, var, yi, xi, lat, lon, value: each file a grid, row 0 in the north; nodata is null.

    Files are read whole, one a row, and exploded by line and cell; a file whose rows do not fit its header raises.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.split(F.regexp_replace(F.trim("value"), "\r", ""), "\n").alias("lines"))
    pairs = F.map_from_entries(F.transform(F.slice("lines", 1, 6), lambda x: F.struct(F.lower(F.split(F.trim(x), r"\s+")[0]).alias("k"), F.split(F.trim(x), r"\s+")[1].cast("double").alias("v"))))
    head = lines.withColumn("h", pairs)
    at = lambda k: F.try_element_at("h", F.lit(k))
    half = at("cellsize") / 2
    head = head.select(
        "path", at("ncols").cast("int").alias("ncols"), at("nrows").cast("int").alias("nrows"), at("cellsize").alias("cell"),
        F.coalesce(at("xllcorner"), at("xllcenter") - half, F.lit(0.0)).alias("x0"), F.coalesce(at("yllcorner"), at("yllcenter") - half, F.lit(0.0)).alias("y0"),
        F.coalesce(at("nodata_value"), F.lit(NODATA)).alias("nodata"), F.filter(F.slice("lines", F.lit(7), F.size("lines")), lambda x: F.trim(x) != "").alias("rows"),
    )
    head = head.withColumn("rows", F.when(F.size("rows") == F.col("nrows"), F.col("rows")).otherwise(F.raise_error(F.concat(F.lit("rows do not fit the header: "), "path"))))
    rows = head.select("*", F.posexplode("rows").alias("yi", "row")).drop("rows").withColumn("cells", F.split(F.trim("row"), r"\s+"))
    rows = rows.withColumn("cells", F.when(F.size("cells") == F.col("ncols"), F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("columns do not fit the header: "), "path"))))
    cells = rows.select("path", "yi", "x0", "y0", "cell", "nrows", "nodata", F.posexplode("cells").alias("xi", "v"))
    name = F.lit(var) if var else F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    value = F.col("v").cast("double")
    return cells.select("path", name.alias("var"), F.col("yi").cast("long"), F.col("xi").cast("long"), (F.col("y0") + (F.col("nrows") - F.col("yi") - 0.5) * F.col("cell")).alias("lat"), (F.col("x0") + (F.col("xi") + 0.5) * F.col("cell")).alias("lon"), F.when(value != F.col("nodata"), value).alias("value"))


def header_of(df: DataFrame) -> Header:
    """The header of a long grid (yi, xi, lat, lon): corners are half a cell off the least centres."""
    r = df.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"), F.countDistinct("yi").alias("ny"), F.countDistinct("xi").alias("nx")).first()
    if r.ny is None or not r.ny:
        raise ValueError("an empty grid has no header")
    cell = (r.b - r.a) / (r.ny - 1) if r.ny > 1 else (r.d - r.c) / (r.nx - 1) if r.nx > 1 else 1.0
    return Header(r.nx, r.ny, cell, r.c - cell / 2, r.a - cell / 2)


def grid_lines(df: DataFrame, value: str = "value", nodata: float = NODATA) -> DataFrame:
    """yi, line: each row of the grid as text, missing cells as nodata; rows are gathered by yi."""
    text = F.format_string("%s", F.coalesce(F.col(value).cast("double"), F.lit(nodata)).cast("string"))
    cells = df.groupBy("yi").agg(F.array_sort(F.collect_list(F.struct("xi", text.alias("t")))).alias("c"))
    return cells.select("yi", F.array_join(F.transform("c", lambda x: x["t"]), " ").alias("line"))


def write_ascii(df: DataFrame, path: str, value: str = "value") -> Header:
    """One ASCII file; a table of several variables is refused.

    The lines are a table first.  Their lengths (a number a line of the grid) give each its place, and tasks write them there.
    """
    if "var" in df.columns and df.select("var").distinct().limit(2).count() > 1:
        raise ValueError("an ASCII grid holds one variable")
    head = header_of(df)
    lines = write_through(grid_lines(df, value, head.nodata).select("yi", F.concat("line", F.lit("\n")).alias("text")), "lines")
    places, at = [], 0
    for r in lines.select("yi", F.octet_length("text").alias("n")).orderBy("yi").collect():
        places.append((r.yi, at))
        at += r.n
    table = df.sparkSession.createDataFrame(places, "yi long, place long")
    write_placed(lines.join(F.broadcast(table) if len(places) <= MAX_LOCAL else table, "yi").select("place", "text"), path, (head.text() + "\n").encode())
    return head


def write_header(df: DataFrame, path: str) -> Header:
    """``header.txt`` in a folder, or the file itself."""
    head = header_of(df)
    target = Path(path)
    if target.suffix == "":
        target.mkdir(parents=True, exist_ok=True)
        target = target / "header.txt"
    target.write_text(head.text() + "\n")
    return head


def template(spark: SparkSession, head: Header) -> DataFrame:
    """yi, xi, lat, lon of a header's cells, row 0 in the north."""
    cells = spark.range(head.nrows * head.ncols).select(F.floor(F.col("id") / head.ncols).cast("long").alias("yi"), (F.col("id") % head.ncols).alias("xi"))
    return cells.select("yi", "xi", (head.yllcorner + (head.nrows - F.col("yi") - 0.5) * head.cellsize).alias("lat"), (head.xllcorner + (F.col("xi") + 0.5) * head.cellsize).alias("lon"))


def latlon_ladder(spark: SparkSession, head: Header, levels: dict[str, float]) -> dict[str, DataFrame]:
    """A template for each level (l0, l1, l11, l2), all on the extent of ``head``."""
    return {name: template(spark, head if size == head.cellsize else head.rescaled(size)) for name, size in levels.items()}


def as_matrix(df: DataFrame, value: str = "value") -> pd.DataFrame:
    """A small grid as a matrix on the driver, for looking at."""
    return df.select("yi", "xi", value).toPandas().pivot(index="yi", columns="xi", values=value)
