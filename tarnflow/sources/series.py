"""Gauge series: discharge text, wide tables, observed metadata, id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arith import finite
from ..session import write_through

#: Gauges of a block of a wide table, and of a text file: with two columns a gauge a row stays some kilobytes, however many gauges there are.
BLOCK = 250
#: Column names of text files that may be sent to every executor.
NAMES = 200_000


def read_discharge_text(spark: SparkSession, path: str) -> DataFrame:
    """id, t, obs, sim from blank-separated tables ``No Day Mon Year Qobs_<id> Qsim_<id> ...``; negative values are missing."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").alias("c")).filter(F.size("c") >= 5)
    names = lines.filter(F.lower(F.col("c")[0]) == "no").select("path", F.col("c").alias("names"))
    # one row a file: sent behind a check of its size, else joined as it is
    few = (names.agg(F.sum(F.size("names"))).first()[0] or 0) <= NAMES
    rows = lines.filter(F.col("c")[0].rlike(r"^\d+$")).join(F.broadcast(names) if few else names, "path")
    cells = rows.select(F.make_date(F.col("c")[3].cast("int"), F.col("c")[2].cast("int"), F.col("c")[1].cast("int")).cast("timestamp_ntz").alias("t"), F.explode(F.slice(F.arrays_zip("names", "c"), F.lit(5), F.size("c"))).alias("z"))
    value = finite(F.col("z.c").cast("double"))
    long = cells.select(F.regexp_extract("z.names", r"(?i)^q(obs|sim)_0*(\d+)$", 2).alias("id"), F.lower(F.regexp_extract("z.names", r"(?i)^q(obs|sim)_", 1)).alias("side"), "t", F.when(value >= 0, value).alias("v"))
    return sides(long.filter("id <> ''").withColumn("id", F.col("id").cast("long")))


def sides(long: DataFrame) -> DataFrame:
    """id, t, side, v to id, t, obs, sim: one aggregation instead of a full outer join."""
    return long.groupBy("id", "t").agg(*[F.max(F.when(F.col("side") == s, F.col("v"))).alias(s) for s in ("obs", "sim")])


def unpivot_collection(wide: DataFrame, time: str = "t") -> DataFrame:
    """Columns ``Qobs_<id>`` and ``Qsim_<id>`` to id, t, obs, sim; leading zeros of ids go."""
    cols = [c for c in wide.columns if c.lower().startswith(("qobs_", "qsim_"))]
    return _named_cells(wide.select(F.col(time).alias("t"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot("t", cols, "name", "v"))


def _named_cells(long: DataFrame) -> DataFrame:
    """t, name, v to id, t, obs, sim."""
    return sides(long.select(F.regexp_extract("name", r"_0*(\d+)$", 1).cast("long").alias("id"), "t", F.lower(F.substring("name", 2, 3)).alias("side"), finite("v").alias("v")))


def wide_blocks(long: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, t, names, cells of series (id, t, obs, sim): a wide table cut into blocks of about ``block`` gauges, each with every stamp of the table.

    A plan can't have a column a gauge where gauges are many: ``names`` are the block's columns Qobs_<id> and Qsim_<id>, ``cells`` their values.
    """
    long = write_through(long.select("id", "t", "obs", "sim"), "series")
    ids = long.select("id").distinct()
    blocks = max(1, -(-ids.count() // block))
    of = F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")).alias("block")
    named = ids.groupBy(of).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # every stamp meets every block, with or without a value there
    stamps = long.select("t").distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "t", F.lit(None).cast("struct<id: bigint, v: struct<obs: double, sim: double>>").alias("e"))
    values = long.select(of, "t", F.struct(F.col("id").cast("long").alias("id"), F.struct(F.col("obs").cast("double").alias("obs"), F.col("sim").cast("double").alias("sim")).alias("v")).alias("e"))
    rows = values.unionByName(stamps).groupBy("block", "t").agg(F.map_from_entries(F.collect_list("e")).alias("at")).join(named, "block")
    name = lambda side, i: F.format_string(f"Q{side}_%010d", i)
    names = F.flatten(F.transform("ids", lambda i: F.array(name("obs", i), name("sim", i))))
    found = F.transform("ids", lambda i: F.col("at")[i])
    cells = F.flatten(F.transform(found, lambda v: F.array(v["obs"], v["sim"])))
    return rows.select("block", "t", names.alias("names"), cells.alias("cells"))


def unpivot_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of a wide table (t, names, cells) to id, t, obs, sim."""
    return _named_cells(blocks.select("t", F.explode(F.arrays_zip("names", "cells")).alias("z")).select("t", F.col("z.names").alias("name"), F.col("z.cells").alias("v")))


def write_discharge_text(blocks: DataFrame, path: str) -> None:
    """Blank-separated tables ``No Day Mon Year Qobs_<id> Qsim_<id> ...`` of the blocks of a wide table (block, t, names, cells): a file a block, its header first, missing values as -9999."""
    first = F.row_number().over(Window.partitionBy("block").orderBy("t")) == 1
    head = F.concat_ws(" ", F.lit("No Day Mon Year"), "names")
    line = F.concat_ws(" ", F.lit("1"), F.dayofmonth("t"), F.month("t"), F.year("t"), F.transform("cells", lambda c: F.coalesce(c.cast("string"), F.lit("-9999.0"))))
    lines = blocks.withColumn("first", first).select("block", "t", F.posexplode(F.when(F.col("first"), F.array(head, line)).otherwise(F.array(line))).alias("n", "value"))
    lines.sortWithinPartitions("block", "t", "n").select("block", "value").write.partitionBy("block").text(path)


def outer_align(obs: DataFrame, sim: DataFrame) -> DataFrame:
    """id, t, obs, sim of two tables (id, t, value), rows of either side kept."""
    return obs.select("id", "t", F.col("value").alias("obs")).join(sim.select("id", "t", F.col("value").alias("sim")), ["id", "t"], "full")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The first column of a table without a header."""
    return spark.read.csv(path, header=False).select(F.col("_c0").alias("id")).filter("id is not null")


def read_parts(spark: SparkSession, path: str, ids: DataFrame | None = None, start: str | None = None, stop: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A Parquet table of series by projection, time, box (x0, x1, y0, y1) and ids, all before anything is shuffled."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col("t") >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        df = df.filter(F.col("t") <= F.lit(stop).cast("timestamp_ntz"))
    if box is not None:
        df = df.filter(F.col("x").between(*box[:2]) & F.col("y").between(*box[2:]))
    return df if ids is None else df.join(ids, "id", "left_semi")


def first_metadata(meta: DataFrame, order: str) -> DataFrame:
    """One row an id: the first in order."""
    return meta.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(order))).filter("__n = 1").drop("__n")
