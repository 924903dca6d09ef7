"""Arriving files: daily windows with a watermark, and one-pass statistics kept as mergeable states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.climate import finish_state, merge_states, partial_state


def daily_windows(stream: DataFrame, keys: list[str], value: str, time: str = "t", late: str = "2 days", intensive: bool = True) -> DataFrame:
    """keys, t, value: means (or sums) per day; a day is closed when a stamp ``late`` after it was seen.

    Window state is a row a key and open day, whatever the number of steps.
    """
    agg = F.avg(value) if intensive else F.sum(value)
    days = stream.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late).groupBy(*keys, F.window("__ts", "1 day").alias("w")).agg(agg.alias(value))
    return days.select(*keys, F.col("w.start").cast("timestamp_ntz").alias(time), value)


def keep_states(stream: DataFrame, keys: list[str], value: str, path: str, checkpoint: str, time: str = "t") -> StreamingQuery:
    """Write the partial state of every micro-batch below ``path``; a batch that is repeated replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        partial_state(batch, keys, value, time).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_statistics(spark: SparkSession, path: str, keys: list[str], ddof: int = 1) -> DataFrame:
    """n, mean, std and climatology over everything that has arrived."""
    return finish_state(merge_states(spark.read.parquet(path), keys), keys, ddof)


def first_of_stamp(stream: DataFrame, keys: list[str], time: str = "t", late: str = "2 days") -> DataFrame:
    """The first row of each key and stamp; stamps are forgotten ``late`` after they were passed."""
    return stream.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark([*keys, time]).drop("__ts")
