"""Metric tables: summaries, medians, comparison groups, run overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import finite
from ..functions.text import match_id
from ..functions.units import rebase_rate

#: What a name has in it that is a coordinate and not data.
COORDINATE_NAMES = "lon|lat|latitude|longitude|easting|northing|_bnds"


def finite_values(df: DataFrame, value: str) -> DataFrame:
    """Text or numbers to finite doubles; rows without one drop out."""
    return df.withColumn(value, finite(F.expr(f"try_cast(`{value}` as double)"))).filter(F.col(value).isNotNull())


def metric_long(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """ids, variable, value: one row a finite metric."""
    wide = df.select(*ids, *[F.expr(f"try_cast(`{m}` as double)").alias(m) for m in metrics])
    return finite_values(wide.unpivot(ids, metrics, "variable", "value"), "value")


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, min, max, mean, median."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"))


def compare_inputs(inputs: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    """label, variable, n, min, max, mean, median of metric values (metric, value) by input; a metric that no input has a finite value of raises."""
    long = None
    for label, df in inputs.items():
        one = finite_values(df.select(F.lit(label).alias("label"), F.col("metric").alias("variable"), "value"), "value")
        long = one if long is None else long.unionByName(one)
    out = summary(long, ["label", "variable"], "value")
    lacking = set(metrics) - {r.variable for r in long.select("variable").distinct().collect()}
    if lacking:
        raise ValueError(f"no finite value of {', '.join(sorted(lacking))}")
    return out


def medians_by_id(df: DataFrame, id_: str, metrics: list[str]) -> DataFrame:
    """Medians of the finite values by canonical id; rows without an id drop out."""
    rows = df.withColumn("match_id", match_id(F.col(id_))).filter("match_id <> ''")
    return rows.groupBy("match_id").agg(*[F.percentile(finite(F.expr(f"try_cast(`{m}` as double)")), F.lit(0.5)).alias(m) for m in metrics])


def comparison_groups(df: DataFrame, group: str) -> DataFrame:
    """Rows without the group field join every group; if there is no group at all they are ``ungrouped``."""
    groups = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("__g")).distinct()
    alone = df.filter(F.col(group).isNull())
    if groups.isEmpty():
        return df.withColumn(group, F.lit("ungrouped"))
    # groups are the few values of one label field: an equi-join on a constant, not on rows
    spread = alone.withColumn("__one", F.lit(1)).join(groups.withColumn("__one", F.lit(1)), "__one").withColumn(group, F.col("__g")).drop("__one", "__g")
    return df.filter(F.col(group).isNotNull()).unionByName(spread)


def variable_statistics(df: DataFrame, keys: list[str], value: str, cells: list[str] | None = None) -> DataFrame:
    """keys, min_value, mean_value, max_value; with ``cells`` of the means over time of each cell."""
    if cells:
        df = df.groupBy(*keys, *cells).agg(F.avg(value).alias(value))
    return df.groupBy(*keys).agg(F.min(value).alias("min_value"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"))


def overview(stats: DataFrame, target: str | None = None) -> DataFrame:
    """Rows of (file_name, variable, vartype, min_value, mean_value, max_value, unit) without coordinates and repeats, inputs first.

    ``target``: rates are re-based to this time unit.
    """
    rows = stats.filter(~F.col("variable").rlike(COORDINATE_NAMES)).dropDuplicates()
    if target:
        unit = rebase_rate(F.lit(1.0), F.col("unit"), target)[1]
        rows = rows.withColumns({c: rebase_rate(F.col(c), F.col("unit"), target)[0] for c in ("min_value", "mean_value", "max_value")} | {"unit": unit})
    return rows.orderBy(F.when(F.col("vartype") == "input", 0).otherwise(1), "file_name", "variable")


def as_text(value: str) -> F.Column:
    """Eight significant digits."""
    return F.format_string("%.8g", F.col(value))
