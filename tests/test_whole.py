"""Queries over whole tables: every gauge or step of the driver tables reaches the operator and its result."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import flow, gauges, resample, skill, workflows
from tarnflow.plans import registry
from tarnflow.plans.views import gauge_ts, grid_ts, map_pair, table
from tarnflow.sources import series

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")


@pytest.mark.parametrize("name", ["w05_forward_fill", "w06_linear_fill", "r01_nearest_fill", "r03_spread_totals", "s08_unpivot_collection"])
def test_every_gauge(spark, name):
    ids = lambda df: {r.id for r in df.select("id").distinct().collect()}
    source = gauge_ts(spark, SF).filter("obs is not null") if name.startswith("r03") else table(spark, SF, "lineitem").select(F.col("l_suppkey").alias("id"))
    want = ids(source)
    assert len(want) > 20
    assert ids(registry.QUERIES[name](spark, SF)) == want


@pytest.mark.parametrize(("name", "view"), [("a23_norm_deviation", map_pair), ("j14_nearest_fill_steps", grid_ts)])
def test_every_step(spark, name, view):
    steps = lambda df: {r.t: r["count"] for r in df.groupBy("t").count().collect()}
    want = steps(view(spark, SF))
    assert len(want) > 50
    assert steps(registry.QUERIES[name](spark, SF)) == want


def _series(spark, n):
    """Series of three stamps; the first gauge lacks one, the second has no simulation."""
    rows = [(i, f"2001-0{m}-01", float(i + m), None if i == 11 else i * 0.1) for i in range(10, 10 + n) for m in (1, 2, 3) if (i, m) != (10, 2)]
    return spark.createDataFrame(rows, "id long, t string, obs double, sim double").withColumn("t", F.to_timestamp_ntz("t"))


def test_plan_does_not_grow_with_gauges(spark):
    """A column a gauge once made plans that the driver could not hold."""
    long = _series(spark, 600)
    blocks = series.wide_blocks(long, 100)
    assert blocks.columns == ["block", "t", "names", "cells"]
    assert max(r.n for r in blocks.select(F.size("names").alias("n")).collect()) < 2 * 200
    got = {(r.id, r.t.month): (r.obs, r.sim) for r in series.unpivot_blocks(blocks).collect()}
    assert got == {(r.id, r.t.month): (r.obs, r.sim) for r in long.collect()} | {(10, 2): (None, None)}
    assert registry.QUERIES["s08_unpivot_collection"](spark, SF)._jdf.queryExecution().analyzed().toString().count("Qobs_") < 10


def test_discharge_text_by_blocks(spark, tmp_path):
    long = _series(spark, 30)
    series.write_discharge_text(series.wide_blocks(long, 10), str(tmp_path / "q"))
    files = sorted((tmp_path / "q").glob("block=*/*.txt"))
    assert len(files) > 1
    for f in files:
        head, *rest = f.read_text().splitlines()
        assert head.startswith("No Day Mon Year Qobs_") and len(rest) == 3 and all(len(x.split()) == len(head.split()) for x in rest)
    got = {(r.id, r.t.month): (r.obs, r.sim) for r in series.read_discharge_text(spark, str(tmp_path / "q")).collect()}
    assert got == {(r.id, r.t.month): (r.obs, r.sim) for r in long.collect()} | {(10, 2): (None, None)}


def test_best_rows_computes_values_once(spark):
    """A value that comes out otherwise when it is computed again once lost its group."""
    noise = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()
    df = spark.range(200).select((F.col("id") % 50).alias("g"), noise(F.col("id").cast("double")).alias("v")).repartition(4)
    assert sorted(r.g for r in skill.best_rows(df, ["g"], "v", "max").collect()) == list(range(50))


@pytest.mark.parametrize("crowd", [1, 400])
def test_nearest_node_of_crowded_places(spark, crowd):
    """Nodes at few places, or in one spot far from most gauges: pairs once grew with nodes times gauges."""
    rng = random.Random(4)
    n = [(i, rng.randrange(7) / 10, rng.randrange(5) / 10) for i in range(crowd)] + [(crowd + i, 50 + rng.random() * 1e-6, rng.random() * 1e-6) for i in range(crowd)]
    g = [(i, rng.uniform(-5, 60), rng.uniform(-5, 5)) for i in range(40)] + [(40, 0.25, 0.25), (41, 0.25, 0.25)]
    found = gauges.nearest_node(spark.createDataFrame(g, "id int, x double, y double"), spark.createDataFrame(n, "node int, x double, y double"), 4)
    assert {r.id: r.node for r in found.collect()} == {i: min(n, key=lambda m: ((x - m[1]) ** 2 + (y - m[2]) ** 2, m[0]))[0] for i, x, y in g}
    levels, leaves = gauges._boxes(spark.createDataFrame(n, "node int, x double, y double").groupBy("x", "y").agg(F.min("node").alias("node")), 4)
    assert leaves.groupBy("box").count().agg(F.max("count")).first()[0] <= 4


def test_discharge_evaluation_reads_series_once(spark):
    """Every filter once made the steps anew, in one task at a time."""
    seen = spark.sparkContext.accumulator(0)

    def told(v):
        seen.add(1)
        return v

    rows = [(i, f"{y}-0{m}-01", float(i + m + y), float(i * m + y)) for i in range(20) for y in range(2001, 2007) for m in (1, 2, 3)]
    ts = spark.createDataFrame(rows, "id long, t string, obs double, sim double").withColumn("t", F.to_timestamp_ntz("t")).withColumn("obs", F.udf(told, "double").asNondeterministic()("obs"))
    assert workflows.evaluate_discharge(ts, "Y", 5, 5).count() == 20
    assert seen.value == len(rows)


def test_gridded_evaluation_reads_its_tables_once(spark):
    """Extents, spans, values and ranks once added up the lines anew for each side."""
    assert "l_quantity" not in registry.QUERIES["a46_gridded_spearman"](spark, SF)._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize(("alias", "hop"), [("D", "1 day"), ("6h", "6 hours"), ("5h", "5 hours"), ("W", "7 days"), ("M", "1 month")])
def test_finer_steps_equal_brute_force(spark, alias, hop):
    """Stamps off the steps, without a value at either end, and at the same place as a step; steps are not ordered, only stamps."""
    rng = random.Random(5)
    rows = [(i, f"2001-0{rng.randrange(1, 5)}-{rng.randrange(10, 28)} {rng.choice(['00:00', '06:00', '13:37'])}:00", rng.random() if rng.random() < 0.7 else None) for i in range(6) for _ in range(9)] + [(9, "2001-01-01 00:00:00", None)]
    rows = list({(i, t): (i, t, v) for i, t, v in rows}.values())
    df = spark.createDataFrame(rows, "id long, t string, v double").withColumn("t", F.to_timestamp_ntz("t"))
    stamps = [(r.id, r.t, r.v) for r in df.collect()]
    for how in ("ffill", "nearest"):
        out = resample.to_finer(df, ["id"], alias, "v", how)
        got = {(r.id, r.t): r.v for r in out.collect()}
        want = {}
        for i, t in ((r.id, r.t) for r in resample.spine(df, ["id"], alias).collect()):
            back, ahead = [(s, v) for j, s, v in stamps if j == i and v is not None and s <= t], [(s, v) for j, s, v in stamps if j == i and v is not None and s >= t]
            b, a = max(back, default=None), min(ahead, default=None)
            want[i, t] = (b and b[1]) if how == "ffill" or a is None or (b is not None and t - b[0] <= a[0] - t) else a[1]
        assert got == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.rindex("Generate") < plan.index("Window ")


@pytest.mark.parametrize("rounds", [flow.basins, flow.accumulate])
def test_rounds_send_no_table_through_the_driver(spark, monkeypatch, rounds):
    """Tables of a round that are small as files were sent to every executor, by way of the driver, once a round."""
    plans, write = [], flow.write_through
    monkeypatch.setattr(flow, "write_through", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    river = spark.range(9).select(F.col("id").alias("cell"), F.when(F.col("id") > 0, F.col("id") - 1).alias("down"))
    assert rounds(river).count() == 9
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
