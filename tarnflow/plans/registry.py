"""All queries of the grid and gauge engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Digits that sums in any order agree in.  Means of decimal numbers often lie exactly between two
#: rounded ones; a shift that is no decimal fraction takes them off the edge, alike on both sides.
DIGITS, SHIFT = 6, 3.3e-8


def query(name: str, sql: str | None = None, floats: str = ""):
    """Register a query; ``floats``: its double columns, rounded here and in the SQL, since engines add up in different orders."""
    names = floats.split()

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c).cast("double") + SHIFT, DIGITS) + F.lit(0.0) for c in names}) if names else out

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f"round(CAST({c} AS DOUBLE) + {SHIFT}, {DIGITS}) + CAST(0 AS DOUBLE) AS {c}" for c in names)
            SQL[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if names else sql
        return build

    return register


from . import climates, composed, files, forcings, gauges, graphs, grids, maps, metadata, metric_tables, steps  # noqa: E402, F401
