"""Streams over arriving files give what one batch over all of them gives."""

import pytest
from pyspark.sql import functions as F

from tarnflow.operators.climate import finish_state, partial_state
from tarnflow.streaming import stats


@pytest.fixture
def files(spark, tmp_path):
    rows = [(k, f"2001-{m:02d}-{d:02d} {h:02d}:00:00", float(k * m + d + h)) for k in (1, 2) for m in (1, 2, 3) for d in (1, 2) for h in (0, 6, 18)]
    df = spark.createDataFrame(rows, "k int, t string, v double").withColumn("t", F.to_timestamp_ntz("t"))
    path = str(tmp_path / "in")
    for m in (1, 2, 3):
        df.filter(F.month("t") == m).coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), tmp_path


def test_states_of_batches_merge_to_the_whole(spark, files):
    df, stream, tmp = files
    stats.keep_states(stream, ["k"], "v", str(tmp / "s"), str(tmp / "c")).awaitTermination()
    got = stats.read_statistics(spark, str(tmp / "s"), ["k"]).orderBy("k").collect()
    want = finish_state(partial_state(df, ["k"], "v"), ["k"]).orderBy("k").collect()
    assert spark.read.parquet(str(tmp / "s")).select("batch").distinct().count() == 3
    for a, b in zip(got, want, strict=True):
        assert a.asDict() == pytest.approx(b.asDict())


def test_daily_windows(spark, files):
    df, stream, tmp = files
    q = stats.daily_windows(stream, ["k"], "v").writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.k, r.t): r.v for r in spark.table("days").collect()}
    want = {(r.k, r.d): r.v for r in df.groupBy("k", F.date_trunc("day", "t").cast("timestamp_ntz").alias("d")).agg(F.avg("v").alias("v")).collect()}
    # the last month's days are still open
    assert len(got) >= 8 and all(want[x] == pytest.approx(v) for x, v in got.items())


def test_first_of_stamp(spark, files):
    df, stream, tmp = files
    q = stats.first_of_stamp(stream.unionByName(stream), ["k"]).writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == df.count()
