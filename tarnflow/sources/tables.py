"""Long Parquet grids, reading and writing by suffix, axis discovery, provenance."""

from __future__ import annotations

import datetime
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import finite
from .ascii_grid import read_ascii, write_ascii
from .netcdf import read_netcdf, write_netcdf

#: Names of the axes.
NAMES = {"lat": ("lat", "latitude", "northing", "y"), "lon": ("lon", "longitude", "easting", "x"), "time": ("time", "t", "date")}
AXIS_FLAG = {"lat": "Y", "lon": "X", "time": "T"}


def resolve_axis(columns: list[str], axis: str, attrs: dict[str, dict[str, str]] | None = None) -> str | None:
    """The column of an axis: by its ``axis`` attribute (two of them raise), then by name."""
    flagged = [c for c in columns if (attrs or {}).get(c, {}).get("axis") == AXIS_FLAG[axis]]
    if len(flagged) > 1:
        raise ValueError(f"several columns are flagged as {AXIS_FLAG[axis]}: {flagged}")
    if flagged:
        return flagged[0]
    by_name = {c.lower(): c for c in columns}
    return next((by_name[n] for n in NAMES[axis] if n in by_name), None)


def normalize_axes(df: DataFrame, attrs: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Latitude and longitude renamed to lat and lon, unless those are there."""
    renames = {found: name for name in ("lat", "lon") if (found := resolve_axis(df.columns, name, attrs)) and name not in df.columns}
    return df.withColumnsRenamed(renames)


def payload(columns: list[str], path: str | None = None) -> str:
    """The one column that is no axis, index or bound; of several the one that the file's name spells."""
    axes = {n for names in NAMES.values() for n in names} | {"yi", "xi", "path", "var"}
    left = [c for c in columns if c.lower() not in axes and not c.lower().endswith(("_bnds", "_bounds"))]
    if len(left) != 1 and path:
        left = [c for c in left if c.lower() in Path(path).name.lower()]
    if len(left) != 1:
        raise ValueError(f"no single variable among {columns}")
    return left[0]


def read_grid(spark: SparkSession, path: str, var: str | None = None, nodata: float | None = -9999.0) -> DataFrame:
    """A long grid by suffix: ``.asc`` files, Parquet, CSV, NetCDF."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix == ".asc":
        return read_ascii(spark, path, var)
    if suffix in (".nc", ".nc4"):
        found = read_netcdf(spark, path, var)
        return found if var or found.select("var").distinct().limit(2).count() < 2 else found.filter(F.col("var") == payload([r[0] for r in found.select("var").distinct().collect()], path))
    if suffix in (".tif", ".tiff"):
        raise NotImplementedError("GeoTIFF needs a library that is not part of this engine; convert to a long Parquet table")
    df = spark.read.csv(path, header=True, inferSchema=True) if suffix == ".csv" else spark.read.parquet(path)
    df = normalize_axes(df)
    value = var if var in df.columns else payload(df.columns, path)
    return df.withColumn("value", finite(value, nodata)).drop(*({value} - {"value"}))


def read_tree(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """All files below a folder whose names fit a pattern, as one table."""
    return normalize_axes(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(path))


def write_grid(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """``.asc``, ``.nc`` (classic format), ``.nc4`` (chunked and deflated), or Parquet (partitioned by the columns named); what was there is replaced only when the suffix is known."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix == ".asc":
        write_ascii(df, path)
    elif suffix in (".nc", ".nc4"):
        write_netcdf(df, path, provenance=provenance(), kind="netcdf4" if suffix == ".nc4" else "classic")
    elif suffix in (".parquet", ""):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition) if partition else writer).parquet(path)
    else:
        raise ValueError(f"cannot write {suffix}")


def provenance(version: str = "0", history: str = "") -> dict[str, str]:
    now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    command = " ".join(sys.argv)
    return {"version": version, "date": now, "command": command, "history": f"{now}: {command}" + (f"\n{history}" if history else "")}


def write_provenance(path: str, **attrs: str) -> None:
    """A sidecar file next to a table on the driver's file system."""
    Path(f"{path.rstrip('/')}.provenance.json").write_text(json.dumps(provenance(**attrs), indent=1))


def cached(df_or_none, path: str, spark: SparkSession, build, overwrite: bool = False) -> DataFrame:
    """The saved table at ``path``, built and written where it is absent, unreadable or to be overwritten."""
    from pyspark.errors import AnalysisException

    if not overwrite:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    (df_or_none if df_or_none is not None else build()).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def null_counts(df: DataFrame, values: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(v).isNull()).alias(v) for v in values])
